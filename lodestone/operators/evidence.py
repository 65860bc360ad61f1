"""From hits to what an answer shows: sources, evidence text, actions, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def page_span(refs: Column) -> Column:
    """'3' or '3-5' from references (kind, page_number); null if none is a page."""
    pages = F.array_sort(F.array_distinct(F.transform(F.filter(refs, lambda r: r["kind"] == "pdf_page"), lambda r: r["page_number"])))
    first, last = F.get(pages, F.lit(0)), F.get(pages, F.size(pages) - 1)
    return F.when(F.size(pages) == 1, first.cast("string")).when(F.size(pages) > 1, F.concat_ws("-", first, last))


def locator(kind: Column, titles: Column, label: Column, pages: Column, whole: Column, page_word: str = "p. ") -> Column:
    """Where a chunk stands, by the kind of its locator: headings of processed text, the table's
    heading, a law's article, or an attachment's label and pages."""
    first = F.coalesce(F.get(titles, F.lit(0)), F.lit(""))
    heading = F.when(F.size(titles) > 0, F.array_join(titles, " · ")).otherwise("text")
    attachment = F.when(whole, "whole form").otherwise(F.concat_ws(" · ", F.coalesce(label, F.nullif(tx.squeeze(first), F.lit("")), F.lit("attachment")), F.concat(F.lit(page_word), pages)))
    return (
        F.when(kind == "processed_text", heading)
        .when(kind == "html_table", F.when(first != "", F.concat(first, F.lit(" (table)"))).otherwise("table"))
        .when(kind == "law_api", F.when(whole, F.concat(label, F.lit(" · whole form"))).otherwise(label))
        .otherwise(attachment)
    )


def evidence_text(hits: DataFrame, most: int = 3000, notes: str | None = None, cut: str = " …") -> DataFrame:
    """(qid, n, evidence): the numbered hits of a question (qid, rank, title, locator, date, text) as one
    text; each at most ``most`` characters, without the lines that ``notes`` matches."""
    body = tx.strip(F.array_join(F.filter(tx.lines(F.col("text")), lambda x: ~tx.strip(x).rlike(notes)), "\n")) if notes else tx.strip(F.col("text"))
    body = F.when(F.length(body) <= most, body).otherwise(F.concat(F.substring(body, 1, most), F.lit(cut)))
    date = F.when(tx.known_date(F.col("date")).isNotNull(), F.concat(F.lit(" ("), F.col("date"), F.lit(")"))).otherwise("")
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.concat_ws(" · ", "title", "locator"), date, F.lit("\n"), body)
    rows = hits.select("qid", F.struct("rank", block.alias("block")).alias("b"))  # bounded by k
    return rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("b"))["block"], "\n\n").alias("evidence"))


def cited_contacts(answers: DataFrame, hits: DataFrame, contacts: DataFrame) -> DataFrame:
    """(qid, place, label, phone): the contacts of the documents that an answer cites, in the order of
    citation; of a contact (label and phone) the first.  ``contacts``: key, label, phone, doc_ids."""
    cited = answers.select("qid", F.posexplode(F.array_distinct(tx.citations(F.col("answer")))).alias("place", "rank"))
    docs = cited.join(hits.select("qid", "rank", "doc_id"), ["qid", "rank"])
    known = contacts.select("key", "label", "phone", F.explode("doc_ids").alias("doc_id"))
    found = docs.join(known, "doc_id").groupBy("qid", "label", "phone").agg(F.min(F.struct("place", "key")).alias("f"))
    w = Window.partitionBy("qid").orderBy("f.place", "f.key")
    return found.select("qid", F.row_number().over(w).alias("place"), "label", "phone")


def action_lists(answers: DataFrame, hits: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, place, type, label, url): the buttons of an answer (qid, answer, answer_type, forms, keys).

    Unknown: the row of ``links`` whose key is 'main'.  Clarifying: none.  Else the forms that are
    both chosen and cited (hits: qid, rank, form_title, chunk_kind, source_url, evidence), then the chosen
    links whose word is in the evidence.  ``links``: key, label, url, word."""
    real = answers.filter("answer_type = 'answer'")
    chosen = real.select("qid", F.explode(F.array_intersect("forms", tx.citations(F.col("answer")))).alias("rank"))
    form = hits.filter((F.col("chunk_kind") == "whole_form") & F.col("source_url").startswith("https://"))
    forms = chosen.join(form, ["qid", "rank"]).select("qid", F.lit(0).alias("part"), F.col("rank").alias("ord"), F.lit("download").alias("type"), F.col("form_title").alias("label"), F.col("source_url").alias("url"))
    seen = hits.groupBy("qid").agg(F.lower(F.array_join(F.collect_list("evidence"), " ")).alias("evidence"))
    keyed = real.select("qid", F.posexplode(F.array_distinct("keys")).alias("ord", "key")).join(links, "key").join(seen, "qid")
    linked = keyed.filter(F.contains("evidence", F.lower("word"))).select("qid", F.lit(1).alias("part"), "ord", F.lit("link").alias("type"), "label", "url")
    main = answers.filter("answer_type = 'unknown'").withColumn("key", F.lit("main")).join(links, "key").select("qid", F.lit(2).alias("part"), F.lit(0).alias("ord"), F.lit("contact").alias("type"), "label", "url")
    every = forms.unionByName(linked).unionByName(main)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("part", "ord"))
    return every.select("qid", place.alias("place"), "type", "label", "url")


def localized(actions: DataFrame, labels: DataFrame, language: Column, fallback: str = "en") -> DataFrame:
    """Labels in the asker's language, else in the fallback, else as they are.  ``labels``: label, lang, text."""
    table = lambda name: labels.select(F.col("label").alias(f"_{name}_label"), F.col("lang").alias(f"_{name}_lang"), F.col("text").alias(f"_{name}"))
    rows = actions.withColumn("_lang", language)
    rows = rows.join(table("own"), (F.col("label") == F.col("_own_label")) & (F.col("_lang") == F.col("_own_lang")), "left")
    rows = rows.join(table("other"), (F.col("label") == F.col("_other_label")) & (F.col("_other_lang") == fallback), "left")
    return rows.withColumn("label", F.coalesce("_own", "_other", "label")).drop("_lang", "_own_label", "_own_lang", "_own", "_other_label", "_other_lang", "_other")


def department_contacts(duties: DataFrame, word: str) -> DataFrame:
    """(dept, phone, tasks): the phone of the first duty (dept, pos, task, phone) that has a word, else
    of the first; and the tasks with their phones, in order."""
    lead = F.coalesce(F.min_by("phone", F.when(F.contains("task", F.lit(word)), F.col("pos"))), F.min_by("phone", "pos"))
    by_task = duties.groupBy("dept", "task").agg(F.min("pos").alias("pos"), F.array_distinct(F.array_sort(F.collect_list(F.struct("pos", "phone")))["phone"]).alias("phones"))
    tasks = by_task.groupBy("dept").agg(F.array_sort(F.collect_list(F.struct("pos", "task", "phones"))).alias("t"))
    return duties.groupBy("dept").agg(lead.alias("phone")).join(tasks, "dept").select("dept", "phone", F.transform("t", lambda t: F.concat(t["task"], F.lit(": "), F.array_join(t["phones"], ", "))).alias("tasks"))


def merge_contacts(existing: DataFrame, fresh: DataFrame, prefix: str) -> DataFrame:
    """Contacts whose key begins with a prefix are replaced, others stay."""
    return existing.filter(~F.coalesce(F.col("key").startswith(prefix), F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def only_value(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """The one value of each group; a group with several stops the job."""
    one = F.when(F.countDistinct(value) == 1, F.min(value)).otherwise(F.raise_error(F.lit(f"more than one {value}")))
    return rows.filter(F.col(value).isNotNull()).groupBy(*groups).agg(one.alias(value))


def source(title: Column, url: Column, publisher: Column, date: Column, where: Column, text: Column) -> Column:
    """What is shown of a chunk as a source; texts that are empty are null."""
    known = lambda c: F.nullif(tx.strip(c), F.lit(""))
    return F.struct(known(title).alias("title"), known(url).alias("url"), known(publisher).alias("publisher"), known(date).alias("date"), known(where).alias("locator"), known(text).alias("snippet"))


def form_download(chunk_kind: Column, title: Column, url: Column, pages: Column, source_format: str = "hwp") -> Column:
    """(label, url, format) of a whole form: a PDF if it has pages, else its own format; null of other chunks."""
    return F.when(chunk_kind == "whole_form", F.struct(title.alias("label"), url.alias("url"), F.when(F.size(pages) > 0, "pdf").otherwise(source_format).alias("format")))


def split_actions(actions: DataFrame, contacts: tuple[str, ...] = ("contact",)) -> DataFrame:
    """(qid, links, contacts): the labels of an answer's actions (qid, place, type, label), in order, by what they do."""
    of = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct("place", "label"))))["label"]
    own = F.col("type").isin(*contacts)
    return actions.groupBy("qid").agg(of(~own).alias("links"), of(own).alias("contacts"))


def grouped_contacts(rows: DataFrame) -> DataFrame:
    """(role, region, phone, doc_ids): the documents, sorted, that name a contact (role, region, phone, doc_id)."""
    return rows.groupBy("role", "region", "phone").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
