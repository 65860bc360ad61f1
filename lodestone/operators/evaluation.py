"""Scoring of retrieval and answers.

A check that does not apply is null and counts nowhere."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.index import numbered
from lodestone.operators.quantiles import exact_quantiles


def first_gold_ranks(hits: DataFrame, gold: DataFrame, by: str, questions: DataFrame | None = None) -> DataFrame:
    """(qid, rank): the first rank of a gold item (qid, ``by``); null if no hit is gold.  Questions
    without gold items are not there: they can't be scored.  With ``questions``, those (qid) that have gold items, ``gold``
    need only have those among the hits."""
    found = hits.join(gold.select("qid", by).distinct(), ["qid", by]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return (gold if questions is None else questions).select("qid").distinct().join(found, "qid", "left")


def retrieval_scores(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 5), cut: int = 5) -> DataFrame:
    """n, hit at each of ``at``, and the mean reciprocal rank within ``cut``."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    mrr = F.avg(F.when(F.col("rank") <= cut, 1.0 / F.col("rank")).otherwise(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("n"), *(hit(k).alias(f"hit_at_{k}") for k in at), mrr.alias(f"mrr_at_{cut}"))


def rates(rows: DataFrame, group: str, checks: str = "checks") -> DataFrame:
    """(group, check, passed, applicable) for each group and in total (null group), from a map of booleans."""
    long = rows.select(F.col(group).alias("grp"), F.explode(checks).alias("check", "ok")).filter("ok is not null")
    sets = long.groupingSets([["grp", "check"], ["check"]], "grp", "check")
    return sets.agg(F.grouping("grp").cast("boolean").alias("total"), F.count_if("ok").alias("passed"), F.count("ok").alias("applicable"))


def latency(rows: DataFrame, seconds: str, within: float, *groups: str) -> DataFrame:
    """n, mean, median, nearest-rank 95th percentile, max and the share within a limit; null times count nowhere."""
    own = exact_quantiles(rows, seconds, list(groups), {"median": ("cont", 0.5), "p95": ("disc", 0.95)})
    s = F.col(seconds).cast("double")
    good = rows.filter(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))).groupBy(*(F.col(g).alias(f"of {g}") for g in groups)).agg(F.avg((s <= within).cast("int")).alias("share_within"))
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"of {g}")) for g in groups), F.lit(True))
    return own.join(good, same).select(*groups, "n", "mean", "median", "p95", "max", "share_within")


def threshold(scores: DataFrame, low: str, high: str) -> DataFrame:
    """From (grp, score): min, median and max of two groups, whether they are apart, and the midpoint between them."""
    medians = exact_quantiles(scores.filter(F.col("grp").isin(low, high)), "score", ["grp"], {"median": ("cont", 0.5)})
    ends = scores.filter(F.col("grp").isin(low, high)).groupBy(F.col("grp").alias("of")).agg(F.min("score").alias("min"))
    facts = medians.join(ends, F.col("grp") == F.col("of"), "left")
    of = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    own = facts.agg(*(of(g, n).alias(f"{name}_{n}") for g, name in ((low, "low"), (high, "high")) for n in ("min", "median", "max")))
    return own.withColumn("apart", F.col("low_max") < F.col("high_min")).withColumn("midpoint", F.when(F.col("apart"), (F.col("low_max") + F.col("high_min")) / 2))


def histogram(rows: DataFrame, group: str, kind: str, values: list[str]) -> DataFrame:
    """How often each answer type occurs in each group."""
    return rows.groupBy(group).pivot(kind, values).agg(F.count(F.lit(1))).na.fill(0)


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-5, top: int = 5) -> DataFrame:
    """Two rankings (qid, rank, chunk_id, score) compared: mismatches by rank, the largest
    and mean difference of scores, and how many questions agree in the first and the first ``top``."""
    x = a.select("qid", "rank", F.col("chunk_id").alias("ca"), F.col("score").alias("sa"))
    y = b.select("qid", "rank", F.col("chunk_id").alias("cb"), F.col("score").alias("sb"))
    both = x.join(y, ["qid", "rank"], "full").withColumn("same", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
    diff = F.abs(F.col("sa") - F.col("sb"))
    per = both.groupBy("qid").agg(
        F.bool_and(F.when(F.col("rank") <= 1, F.col("same"))).alias("top1"), F.bool_and(F.when(F.col("rank") <= top, F.col("same"))).alias("topk"),
        F.count_if(~F.col("same") & (F.coalesce(diff, F.lit(1.0)) > tolerance)).alias("wrong"), F.max(diff).alias("most"), F.sum(diff).alias("total"), F.count(diff).alias("n"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("questions"), F.sum("wrong").alias("mismatches"), F.max("most").alias("max_diff"), (F.sum("total") / F.sum("n")).alias("mean_diff"),
        F.count_if("top1").alias("same_top_1"), F.count_if("topk").alias(f"same_top_{top}"),
    )


def gate_confusion(rows: DataFrame) -> DataFrame:
    """(outcome, n, median_s, max_s) of an answerability gate's verdicts (answerable, allowed, seconds)."""
    outcome = (
        F.when(F.col("answerable") & ~F.col("allowed"), "false_block").when(~F.col("answerable") & ~F.col("allowed"), "true_block")
        .when(~F.col("answerable"), "missed").otherwise("passed")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.median("seconds").alias("median_s"), F.max("seconds").alias("max_s"))


def answer_checks(items: DataFrame) -> DataFrame:
    """The checks of each evaluated answer, as a map without those that don't apply.

    ``items``: id, grp, question, expect_type, expect_docs, must_mention, must_not_mention, must_not_lead,
    must_contact, forms_required, forms_allowed (arrays, null: don't care), answer, answer_type,
    top_docs (ordered), contacts, downloads (arrays)."""
    has = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    lead = F.split("answer", r"\n\s*\n")[0]
    none_in = lambda text, words: ~F.exists(words, lambda w: F.contains(text, w))
    checks = {
        "type": F.when(has("expect_type"), F.array_contains("expect_type", F.col("answer_type"))),
        "retrieval": F.when(has("expect_docs"), F.arrays_overlap("expect_docs", "top_docs")),
        "retrieval_at_1": F.when(has("expect_docs"), F.coalesce(F.array_contains("expect_docs", F.get("top_docs", F.lit(0))), F.lit(False))),
        "mention": F.when(has("must_mention"), tx.mentions_all(F.col("answer"), F.col("must_mention"))),
        "no_mention": F.when(has("must_not_mention"), none_in(F.col("answer"), F.col("must_not_mention"))),
        "no_lead": F.when(has("must_not_lead"), none_in(lead, F.col("must_not_lead"))),
        "contact": F.when(has("must_contact"), F.exists("contacts", lambda c: F.forall("must_contact", lambda w: F.contains(c, w)))),
        "forms": F.when(
            F.col("forms_required").isNotNull() & F.col("forms_allowed").isNotNull(),
            (F.size(F.array_except("forms_required", "downloads")) == 0) & (F.size(F.array_except("downloads", F.array_union("forms_required", "forms_allowed"))) == 0),
        ),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in checks.items()))
    return items.select("id", "grp", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("checks"))


def gold_items(golden: DataFrame) -> DataFrame:
    """(qid, doc_id) from (qid, docs, chunks), texts of ids divided by commas, semicolons or
    newlines: the named documents and those of the named chunks, whose part suffix falls away."""
    ids = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"[\n,;]+"), tx.strip), lambda x: x != "")
    of_chunks = F.transform(ids("chunks"), lambda c: F.regexp_extract(F.substring_index(c, "#", 1), "^(.*?)(?:-[0-9a-f]{24})?$", 1))
    return golden.select("qid", F.explode(F.array_union(ids("docs"), of_chunks)).alias("doc_id"))


def dangling(gold: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """Gold items that the index doesn't have."""
    return gold.select("qid", by).distinct().join(index.select(by).distinct(), by, "left_anti")


def unanswered(golden: DataFrame, answers: DataFrame) -> DataFrame:
    return golden.select("qid").distinct().join(answers.select("qid"), "qid", "left_anti")


def compare_runs(answers: DataFrame, *values: str, most: int = 100) -> DataFrame:
    """Answers (config, id, ...) of two or more configurations side by side, a row for each question.
    More than ``most`` configurations are an error, as each has its columns."""
    configs = [r[0] for r in answers.select("config").distinct().orderBy("config").limit(most + 1).collect()]
    if len(configs) > most:
        raise ValueError(f"more than {most} configurations")
    return answers.groupBy("id").pivot("config", configs).agg(*(F.first(v).alias(v) for v in values))


def every_nth(rows: DataFrame, n: int, group: str, *order: str) -> DataFrame:
    """A systematic sample: of each group the first row of every n.  No task numbers a whole group."""
    return numbered(rows, group, *order).filter(F.col("number") % n == (1 % n)).drop("number")


def with_gold(answers: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers with their gold rows (both by qid), and the ids of questions that have no answer."""
    return answers.join(golden, "qid"), unanswered(golden, answers)


def by_headers(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Sheet rows (sheet, row, cells) as columns, by the texts of each sheet's first row: ``names`` is
    column -> header.  A sheet without one of the headers stops the job."""
    heads = rows.filter("row = 0").select("sheet", F.transform("cells", lambda c: tx.squeeze(F.coalesce(c, F.lit("")))).alias("heads"))

    def cell(header: str) -> Column:
        at = F.array_position("heads", header)
        return F.when(at > 0, F.get("cells", at.cast("int") - 1)).otherwise(F.raise_error(F.lit(f"no column {header}")))

    return rows.filter("row > 0").join(heads, "sheet").select("sheet", "row", *(cell(header).alias(column) for column, header in names.items()))


def report(summary: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One JSON text for each group ``key``: its summary row, and how many rows it has."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    packed = F.to_json(F.struct(F.struct(*(c for c in summary.columns if c != key)).alias("summary"), F.coalesce("_rows", F.lit(0)).alias("rows")))
    return summary.join(counts, key, "left").select(key, packed.alias("report"))
