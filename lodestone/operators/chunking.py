"""Chunks: packing, splitting, headings, spans, and the ids that name them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def chunk_id(doc_id: Column, *identity: Column) -> Column:
    """The document's id and 24 hex digits of a hash over what makes the chunk this one."""
    return F.concat(doc_id.cast("string"), F.lit("-"), F.substring(F.sha2(F.concat_ws("\u001f", *(x.cast("string") for x in identity)), 256), 1, 24))


def pack_lines(text: Column, title: Column, most: int = 2500, more: str = " (cont.)") -> Column:
    """Chunks of whole lines, each under ``most`` characters with its heading: the title, then
    the title and ``more``.  A longer line is cut into pieces first.  No lines, no chunks."""
    room = F.greatest(F.lit(most) - F.length(title) - len(more) - 1, F.lit(1))
    pieces = F.flatten(
        F.transform(
            tx.lines(F.coalesce(text, F.lit(""))),
            lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / room).cast("int") - 1, F.lit(0))), lambda i: F.substring(x, i * room + 1, room)),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("body"), F.lit(0).alias("n"))
    head = lambda s: F.when(F.size(s["done"]) == 0, title).otherwise(F.concat(title, F.lit(more)))

    def put(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & (F.length(head(s)) + F.length(s["body"]) + 1 + F.length(x) > most)
        done = F.when(full, F.array_append(s["done"], F.concat(head(s), s["body"]))).otherwise(s["done"])
        body = F.when(full, F.concat(F.lit("\n"), x)).otherwise(F.concat(s["body"], F.lit("\n"), x))
        return F.struct(done.alias("done"), body.alias("body"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"))

    finish = lambda s: F.when((s["n"] > 0) & (tx.strip(s["body"]) != ""), F.array_append(s["done"], F.concat(head(s), s["body"]))).otherwise(s["done"])
    return F.aggregate(pieces, start, put, finish)


def packed_chunks(documents: DataFrame, most: int = 2500) -> DataFrame:
    """(doc_id, chunk_index, n_chunks, chunk_id, text) of documents with a title."""
    packed = documents.select("doc_id", pack_lines(F.col("text"), F.col("title"), most).alias("parts"))
    rows = packed.select("doc_id", F.size("parts").alias("n_chunks"), F.posexplode("parts").alias("chunk_index", "text"))
    return rows.select("doc_id", "chunk_index", "n_chunks", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "text")


def paragraph_parts(
    chunks: DataFrame, title: str, mark: str = "[①-⑳]", longer: int = 800, least: int = 2, kinds: tuple[str, ...] = ("article",)
) -> DataFrame:
    """The children of long chunks of ``kinds``: one for each marked paragraph, with what ``title``
    matches at the chunk's beginning before it.  Chunks of another kind, short ones and those with fewer than
    ``least`` paragraphs have none.  What stands before the first mark is in no child."""
    pieces = F.split("text", f"(?m)(?:^|(?<=\\s))(?={mark})")
    marked = F.filter(F.transform(pieces, tx.strip), lambda x: x.rlike(f"^{mark}"))
    head = tx.squeeze(F.regexp_extract("text", title, 0))
    rows = chunks.filter(F.col("chunk_kind").isin(*kinds) & (F.length("text") > longer)).withColumn("_parts", marked).filter(F.size("_parts") >= least)
    rows = rows.select("*", F.posexplode("_parts").alias("_n", "_body")).withColumn("_head", head)
    body = F.when(F.col("_head") != "", F.concat("_head", F.lit("\n"), "_body")).otherwise(F.col("_body"))
    out = rows.withColumns(
        {
            "parent_chunk_id": F.col("chunk_id").cast("string"),
            "chunk_id": F.concat(F.col("chunk_id").cast("string"), F.lit("#p"), F.col("_n") + 1),
            "chunk_kind": F.concat("chunk_kind", F.lit("_part")),
            "text": body,
            "chunk_text_sha256": F.sha2(body, 256),
        }
    )
    return out.drop("_parts", "_n", "_body", "_head")


def with_parts(chunks: DataFrame, title: str, **how) -> DataFrame:
    """Parents and their children."""
    return chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")).unionByName(paragraph_parts(chunks, title, **how), allowMissingColumns=True)


def line_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, line, start, end) of each line, in code points; the newline belongs to its line."""
    own = F.split("text", "\n", -1)
    rows = documents.select("doc_id", F.length("text").alias("n"), F.posexplode(own).alias("line", "s"))
    w = Window.partitionBy("doc_id").orderBy("line")
    end = F.least(F.sum(F.length("s") + 1).over(w), F.col("n")).cast("long")
    rows = rows.select("doc_id", "line", (F.sum(F.length("s") + 1).over(w) - F.length("s") - 1).cast("long").alias("start"), end.alias("end"))
    return rows


def overlapping(segments: DataFrame, units: DataFrame, width: int = 4096) -> DataFrame:
    """Each segment with the units of its document that it overlaps, and the common part:
    doc_id, segment, unit, start, end.

    Both (doc_id, id, start, end) are dealt into cells of ``width`` characters, so a document
    with many segments is split and the join has equal keys; a pair is taken in the cell
    where its common part begins."""
    cells = lambda d, name: d.select(
        "doc_id", F.col("id").alias(name), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))).alias("cell"),
    )
    joined = cells(segments, "segment").join(cells(units, "unit"), ["doc_id", "cell"])
    start, end = F.greatest("segment_start", "unit_start"), F.least("segment_end", "unit_end")
    return joined.filter((start < end) & (F.floor(start / width) == F.col("cell"))).select("doc_id", "segment", "unit", start.alias("start"), end.alias("end"))


def coverage(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, covered): whether the spans (doc_id, start, end) of a text tile it exactly; a text without spans only if empty."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    steps = spans.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    own = steps.groupBy("doc_id").agg(F.bool_and(F.col("before") == F.col("start")).alias("tiled"), F.max("end").alias("last"))
    return documents.join(own, "doc_id", "left").select("doc_id", F.coalesce(F.col("tiled") & (F.col("last") == F.length("text")), F.length("text") == 0).alias("covered"))


def with_headings(lines: DataFrame, chapter: str, section: str) -> DataFrame:
    """Lines (doc_id, pos, line) with the chapter and section they stand under; a new chapter ends the section."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.withColumn("_c", F.when(F.col("line").rlike(chapter), F.col("line")))
    rows = rows.withColumn("chapter", F.last("_c", ignorenulls=True).over(w)).withColumn("_n", F.count("_c").over(w))
    inside = Window.partitionBy("doc_id", "_n").orderBy("pos")
    return rows.withColumn("section", F.last(F.when(F.col("line").rlike(section), F.col("line")), ignorenulls=True).over(inside)).drop("_c", "_n")


def rowspan_groups(rows: DataFrame) -> DataFrame:
    """Table rows (table_id, row, row_end: the last row that a cell of it reaches) with the group
    of rows that spans tie together: gaps and islands over a running maximum."""
    w = Window.partitionBy("table_id").orderBy("row")
    before = F.max("row_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("row") > before), 1).otherwise(0))
    return rows.withColumn("row_group", F.sum("_new").over(w)).drop("_new")


def ruled_units(lines: DataFrame, rule: str, border: str) -> DataFrame:
    """Text tables: lines (doc_id, pos, line) between rule lines are one row; (doc_id, unit, text) without
    empty borders, spaces squeezed."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    islands = lines.withColumn("unit", F.sum(F.when(F.col("line").rlike(rule), 1).otherwise(0)).over(w)).filter(~F.col("line").rlike(rule))
    islands = islands.withColumn("clean", tx.squeeze(F.regexp_replace("line", border, " "))).filter("clean <> ''")
    return islands.groupBy("doc_id", "unit").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "clean")))["clean"], "\n").alias("text"))


def citing_articles(forms: DataFrame, articles: DataFrame, citation: str) -> DataFrame:
    """(doc_id, form, articles): the articles whose text cites a form of their document.

    ``citation`` is a pattern whose first group is a form's label, so the join is on
    document and label: label 1 is not found in a citation of 1-2 or 10."""
    labels = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(citation), F.lit(1)), tx.squeeze))
    cited = articles.select("doc_id", "article", F.explode(labels).alias("form"))
    found = forms.select("doc_id", "form").join(cited, ["doc_id", "form"], "left")
    return found.groupBy("doc_id", "form").agg(F.array_sort(F.collect_set("article")).alias("articles"))


def unit_spans(documents: DataFrame, start: str) -> DataFrame:
    """(doc_id, unit, start, end, text): a text cut before each match of ``start``; unit 0 is what comes before the first.

    The units tile the text, so positions are sums of lengths."""
    pieces = documents.select("doc_id", F.posexplode(F.split("text", f"(?m)(?={start})", -1)).alias("unit", "text")).filter("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("unit")
    end = F.sum(F.length("text")).over(w).cast("long")
    rows = pieces.withColumn("end", end)
    number = F.when(F.col("text").rlike(f"^(?m)(?:{start})"), 1).otherwise(0)
    return rows.select("doc_id", F.sum(number).over(w).cast("int").alias("unit"), (F.col("end") - F.length("text")).alias("start"), "end", "text")


def numbered_breaks(text: Column, marks: str = "[①-⑳]", items: str = r"\d{1,2}\.") -> Column:
    """Run-on text with a line break before each paragraph mark, and before item numbers that follow a space."""
    return F.regexp_replace(F.regexp_replace(text, f"(?<=\\S)\\s*(?={marks})", "\n"), f"(?<=[^\\d\\n])\\s+(?={items}\\s)", "\n")


def ranged_ids(ranges: DataFrame, listed: DataFrame) -> DataFrame:
    """The ids in ranges (lo, hi) and in a list, each once; a range is opened row by row."""
    return ranges.select(F.explode(F.sequence("lo", "hi")).alias("id")).unionByName(listed.select("id")).distinct()


def classified_spans(spans: DataFrame, rules: Mapping[str, str], most: int = 1200) -> DataFrame:
    """Spans (doc_id, start, end, text) as pieces of at most ``most`` characters with a status: the first of ``rules``
    (pattern -> status, as 'held' or 'excluded') that the span's text matches, else 'chunk'.  Pieces tile the span."""
    status = F.lit(None).cast("string")
    for pattern, name in reversed(rules.items()):
        status = F.when(F.col("text").rlike(pattern), name).otherwise(status)
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / most).cast("int") - 1, F.lit(0)))
    rows = spans.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.coalesce(status, F.lit("chunk")).alias("status"), F.explode(pieces).alias("i"))
    start = F.col("s") + F.col("i") * most
    return rows.select("doc_id", "status", start.alias("start"), F.least(start + most, "e").alias("end"))


def span_totals(spans: DataFrame) -> DataFrame:
    """(doc_id, status, n, chars) of spans (doc_id, status, start, end)."""
    return spans.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def within_limits(chunks: DataFrame, limits: Mapping[str, int], other: int) -> DataFrame:
    """``chunks`` (chunk_kind, text, ...) with a status: 'held' with a reason if a text is blank or longer than its kind may be."""
    limit = F.lit(other)
    for kind, n in limits.items():
        limit = F.when(F.col("chunk_kind") == kind, n).otherwise(limit)
    n = F.length(F.coalesce("text", F.lit("")))
    reason = F.when(tx.strip(F.coalesce("text", F.lit(""))) == "", "blank").when(n > limit, F.concat(F.lit("longer than "), limit.cast("string")))
    return chunks.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "ready").otherwise("held"))


def emitted(units: DataFrame, limits: Mapping[str, int], other: int, context: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The chunks of a document's units (doc_id, unit, chunk_kind, text), and what became of every unit: (doc_id, unit,
    chunk_kind, status, reason, chunk_id).

    A unit of a ``context`` kind is 'held' as 'context only', a blank one as 'blank', one that is longer than its kind may be
    with its limit; the others are 'chunk'.  A chunk's id is of its document, unit and text."""
    judged = within_limits(units, limits, other)
    reason = F.when(F.col("chunk_kind").isin(*context), "context only").otherwise(F.col("reason")) if context else F.col("reason")
    marked = judged.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "chunk").otherwise("held"))
    marked = marked.withColumn("chunk_id", F.when(reason.isNull(), chunk_id(F.col("doc_id"), F.col("unit"), F.sha2("text", 256))))
    chunks = marked.filter("status = 'chunk'").drop("status", "reason")
    return chunks, marked.select("doc_id", "unit", "chunk_kind", "status", "reason", "chunk_id")


def emit_manifest(coverage: DataFrame) -> DataFrame:
    """(doc_id, chunk_count, held_count, reasons) of what ``emitted`` says became of the units: ``reasons`` counts each."""
    counts = coverage.groupBy("doc_id", "status", "reason").agg(F.count(F.lit(1)).alias("n"))
    of = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0))
    reasons = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
    return counts.groupBy("doc_id").agg(of("chunk").alias("chunk_count"), of("held").alias("held_count"), reasons.alias("reasons"))


def law_chunks(units: DataFrame, laws: DataFrame, most: int = 2500) -> DataFrame:
    """(serial, chunk_id, article, chunk_index, text): the units of an article (serial, article, unit, text), packed under its
    heading: the law's name (``laws``: serial, name) and the article."""
    whole = units.groupBy("serial", "article").agg(F.array_join(F.array_sort(F.collect_list(F.struct("unit", "text")))["text"], "\n").alias("text"))
    titled = whole.join(laws.select("serial", "name"), "serial").withColumn("title", F.concat_ws(" ", "name", "article"))
    rows = titled.select("serial", "article", F.posexplode(pack_lines(F.col("text"), F.col("title"), most)).alias("chunk_index", "text"))
    return rows.select("serial", chunk_id(F.col("serial"), F.col("article"), F.col("chunk_index")).alias("chunk_id"), "article", "chunk_index", "text")


def law_manifest(units: DataFrame, chunks: DataFrame, laws: DataFrame) -> DataFrame:
    """(serial, name, article_count, chunk_count, chars, split_articles) of ``law_chunks``: how many articles have units, and
    which of them are more than one chunk.  A law without units has zeros."""
    articles = units.groupBy("serial").agg(F.count_distinct("article").alias("article_count"))
    by_article = chunks.groupBy("serial", "article").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    own = by_article.groupBy("serial").agg(F.sum("n").alias("chunk_count"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("article")))).alias("split_articles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    none = F.array().cast("array<string>")
    return laws.select("serial", "name").join(articles, "serial", "left").join(own, "serial", "left").select(
        "serial", "name", zero("article_count"), zero("chunk_count"), zero("chars"), F.coalesce("split_articles", none).alias("split_articles")
    )


def flat_fields(text: Column, most: int = 700, cut: str = " …") -> Column:
    """The lines of a form's fields as one text, joined by commas, without ruled borders and blanks; cut at ``most`` characters."""
    fields = F.filter(F.transform(tx.lines(text), lambda x: tx.squeeze(F.regexp_replace(x, r"[│┃|─━┌┐└┘├┤┬┴┼+_]+", " "))), lambda x: x != "")
    flat = F.array_join(F.array_distinct(fields), ", ")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit(cut)))


def page_chunks(pages: DataFrame, blocks: DataFrame, transcribed: DataFrame, deadline: str) -> DataFrame:
    """(doc_id, page, text, flags): the text of an annex's pages (doc_id, page) from its blocks (doc_id, page, pos, text),
    or as it was ``transcribed`` by hand (doc_id, page, text); the flag 'deadline' if it matches that."""
    read = blocks.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "\n").alias("read"))
    hand = transcribed.select("doc_id", "page", F.col("text").alias("hand"))
    rows = pages.select("doc_id", "page").distinct().join(read, ["doc_id", "page"], "left").join(hand, ["doc_id", "page"], "left")
    rows = rows.select("doc_id", "page", F.coalesce("hand", "read", F.lit("")).alias("text"))
    flags = F.array(F.when(F.col("text").rlike(deadline), "deadline"), F.when(tx.strip(F.col("text")) == "", "blank"))
    return rows.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))


def site_chunks(pages: DataFrame, images: DataFrame, apart: tuple[str, ...] = ("notice",)) -> DataFrame:
    """(doc_id, part, text): the text of site pages (doc_id, kind, text) with any Unicode line break as a newline; what was read
    from their images (doc_id, pos, text) is a part of its own for the kinds ``apart``, else at the end of the text."""
    plain = F.regexp_replace("text", "[\u2028\u2029\u000b\u000c\u001c-\u001e\u0085]", "\n")
    shown = images.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "\n").alias("shown"))
    rows = pages.select("doc_id", "kind", plain.alias("text")).join(shown, "doc_id", "left")
    own = F.col("kind").isin(*apart) & F.col("shown").isNotNull()
    text = F.when(own | F.col("shown").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "text", "shown"))
    parts = F.array(F.struct(F.lit(0).alias("part"), text.alias("text")), F.when(own, F.struct(F.lit(1).alias("part"), F.col("shown").alias("text"))))
    return rows.select("doc_id", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("doc_id", "p.part", "p.text")
