"""Constrained vector retrieval: one plan for one question or a table of them.

Filters go before ranking; ranking is on narrow columns; the chunk's wide columns
are joined for the k rows that are left.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators.nearest import CHUNKS, QUESTIONS, near_units


@dataclass(frozen=True)
class RetrievalConfig:
    """Caps and thresholds of a retrieval.

    ``kind_caps`` are the most chunks of a kind; a kind that is not named has no cap."""

    k: int = 5
    per_doc: int = 2
    kind_caps: dict[str, int] = field(default_factory=lambda: {"law": 2, "form": 1})
    default_language: str = "ko"
    weak_below: float = 0.48
    rerank_head: int = 15
    rerank_weight: float = 0.5
    #: No table of questions is broadcast any more; kept for callers that set it.
    broadcast_bytes: int = 32 << 20
    #: The most rows of a block of chunks and of one of questions.
    block_chunks: int = CHUNKS
    block_questions: int = QUESTIONS


def _sides(chunks: DataFrame, questions: DataFrame, config: RetrievalConfig) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, unit, doc_id, kind, language, embedding) and questions (qid, q_vector, q_excluded, q_chunks, q_languages).

    ``questions``: qid, vector, and if wanted excluded_docs, excluded_chunks and languages;
    null lists exclude nothing."""
    names = questions.columns
    asked = questions.select(
        "qid",
        F.col("vector").alias("q_vector"),
        (F.col("excluded_docs") if "excluded_docs" in names else F.lit(None)).cast("array<string>").alias("q_excluded"),
        (F.col("excluded_chunks") if "excluded_chunks" in names else F.lit(None)).cast("array<string>").alias("q_chunks"),
        (F.col("languages") if "languages" in names else F.lit(None)).cast("array<string>").alias("q_languages"),
    )
    narrow = chunks.select(
        "chunk_id",
        F.coalesce("parent_chunk_id", "chunk_id").alias("unit"),
        "doc_id",
        "kind",
        F.coalesce("language", F.lit(config.default_language)).alias("language"),
        "embedding",
    )
    return narrow, asked


def _scored(chunks: DataFrame, question: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(qid, chunk_id, unit, doc_id, kind, dist) of the chunks that the one question may see."""
    narrow, asked = _sides(chunks, question, config)
    pairs = narrow.join(F.broadcast(asked), F.lit(True))  # a row of bounded size
    free = lambda listed, own: F.col(listed).isNull() | ~F.array_contains(listed, F.col(own).cast("string"))
    admitted = free("q_excluded", "doc_id") & free("q_chunks", "chunk_id") & (F.col("q_languages").isNull() | F.array_contains("q_languages", F.col("language")))
    dist = F.lit(1.0) - vx.dot(F.col("embedding"), F.col("q_vector"))
    return pairs.filter(admitted).select("qid", "chunk_id", "unit", "doc_id", "kind", dist.alias("dist"))


def _cap(config: RetrievalConfig) -> Column:
    """The cap of a row's kind; null if it has none."""
    cap = F.lit(None).cast("int")
    for kind, n in config.kind_caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return cap


def _unit_caps(pairs: DataFrame, config: RetrievalConfig, capped_kinds: bool) -> DataFrame:
    """The k best units of each question: a unit's best chunk, at most ``per_doc`` units of a document and, in what is left, the caps of the kinds."""
    best = pairs.groupBy("qid", "unit").agg(F.min(F.struct("dist", "chunk_id", "doc_id", "kind")).alias("b")).select("qid", "unit", "b.*")
    return _caps(best, config, capped_kinds)


def _caps(best: DataFrame, config: RetrievalConfig, capped_kinds: bool) -> DataFrame:
    """``_unit_caps`` of units with their best chunks."""
    by = lambda *keys: Window.partitionBy("qid", *keys).orderBy("dist", "unit")
    few = best.withColumn("rn", F.row_number().over(by("doc_id"))).filter(F.col("rn") <= config.per_doc).drop("rn")
    if capped_kinds and config.kind_caps:
        # No kind can have more than k, so that each side of a shuffle keeps k rows of a kind at most.
        few = few.withColumn("rg", F.row_number().over(by("kind"))).filter(F.col("rg") <= config.k).filter(F.col("rg") <= F.coalesce(_cap(config), F.lit(config.k))).drop("rg")
    return few.withColumn("rank", F.row_number().over(by())).filter(F.col("rank") <= config.k)


def _capped(rows: list[Row], config: RetrievalConfig, capped_kinds: bool) -> list[tuple]:
    """What ``_unit_caps`` says, of the nearest chunks of one question in order."""
    units, docs, kinds = set(), Counter(), Counter()
    out: list[tuple] = []
    for r in rows:
        if r.unit in units or len(out) == config.k:
            continue
        units.add(r.unit)
        docs[r.doc_id] += 1
        if docs[r.doc_id] <= config.per_doc:
            kinds[r.kind] += 1
            if not capped_kinds or kinds[r.kind] <= config.kind_caps.get(r.kind, config.k):
                out.append((r.qid, r.unit, r.dist, r.chunk_id, r.doc_id, r.kind, len(out) + 1))
    return out


def top_k(chunks: DataFrame, questions: DataFrame, config: RetrievalConfig | None = None, capped_kinds: bool = True, one: bool = False) -> DataFrame:
    """The best chunks of each question: qid, rank, chunk_id (the unit), part_id, doc_id, kind, score.

    Children stand for their parents with their best distance (``part_id`` is the child that
    won, null if the parent did); then at most ``per_doc`` units of a document and, in what is
    left, the caps of the kinds; then k.  Ties go to the smaller unit, then chunk.  Without
    ``capped_kinds`` the candidates of a later re-ranking come out.  ``one`` says that there is
    only one question, so that it need not be counted.

    Of many questions, each block of chunks meets each block of questions in one task, which keeps for each question the first
    ``per_doc`` units of each document, without those behind k documents of their kind (a document whose chunks are of several kinds
    counts for none); only these cross a shuffle.  The few questions whose k rows reach what was left out are answered again
    without that limit.  What comes of it, k rows a question, is computed here and kept in Spark's cache.
    Of one question the driver gets the nearest chunks, 1,000 rows at most; if the caps leave it short, all chunks are ranked."""
    config = config or RetrievalConfig()
    heap = min(1000, max(64, 4 * config.k * (config.per_doc + len(config.kind_caps))))
    if one:
        spark = chunks.sparkSession
        pairs = _scored(chunks, questions, config)
        nearest = pairs.orderBy("dist", "unit", "chunk_id").limit(heap)
        rows = nearest.collect()
        found = _capped(rows, config, capped_kinds)
        if len(rows) == heap and len(found) < config.k:
            return _hits(_unit_caps(pairs, config, capped_kinds))
        kinds = {f.name: f.dataType for f in nearest.schema}
        schema = StructType([StructField(n, IntegerType() if n == "rank" else kinds[n]) for n in ("qid", "unit", "dist", "chunk_id", "doc_id", "kind", "rank")])
        return _hits(spark.createDataFrame(found, schema))
    sides = _sides(chunks, questions, config)
    near = near_units(*sides, config.per_doc, config.k, capped_kinds, (config.block_chunks, config.block_questions)).repartition("qid")
    near = near.withColumn("cut", F.min("cut").over(Window.partitionBy("qid")))
    first = _caps(near, config, capped_kinds)
    whole = Window.partitionBy("qid")
    first = first.withColumns({"got": F.max("rank").over(whole), "far": F.max("dist").over(whole)})
    first = first.withColumn("run", F.lit(uuid.uuid4().hex)).persist()  # kept for this call, not for later ones
    short = first.filter((F.col("cut") < float("inf")) & ((F.col("got") < config.k) | (F.col("far") > F.col("cut")))).select("qid").distinct()
    ranked = first.drop("cut", "got", "far", "run")
    if not short.isEmpty():
        again = near_units(sides[0], sides[1].join(short, "qid", "left_semi"), config.per_doc, None, capped_kinds, (config.block_chunks, config.block_questions)).drop("cut").repartition("qid")
        ranked = ranked.join(short, "qid", "left_anti").unionByName(_caps(again, config, capped_kinds))
    return _hits(ranked)


def _hits(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "qid",
        "rank",
        F.col("unit").alias("chunk_id"),
        F.when(F.col("chunk_id") != F.col("unit"), F.col("chunk_id")).alias("part_id"),
        "doc_id",
        "kind",
        (1 - F.col("dist")).alias("score"),
    )


def with_chunks(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """The hits with columns of their chunks; a hit whose parent is missing drops out."""
    return chunks.select("chunk_id", *columns).join(hits, "chunk_id")


def kind_of(chunk_kind: Column, doc_id: Column, forms: tuple[str, ...] = ("whole_form",), laws: tuple[str, ...] = ("LAW-",)) -> Column:
    """'form' by the kind of a chunk, else 'law' by the beginning of its document's id, else 'other'."""
    law = F.lit(False)
    for prefix in laws:
        law = law | doc_id.cast("string").startswith(prefix)
    return F.when(chunk_kind.isin(*forms), "form").when(law, "law").otherwise("other")


def scope_exclusions(question: Column, rules: Mapping[str, tuple[str, ...]]) -> Column:
    """The documents that are excluded from a question, sorted: those of ``rules`` (document -> words) of
    whose words it has none.  Rules are configuration; a null question has no words."""
    absent = lambda words: ~F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(question, w)), F.lit(False))
    return F.filter(F.array(*(F.when(absent(words), F.lit(doc)) for doc, words in sorted(rules.items()))), lambda x: x.isNotNull())


def select_capped(hits: DataFrame, key: Column, config: RetrievalConfig | None = None) -> DataFrame:
    """The best k hits of each question by ``key``, under the caps of the kinds."""
    config = config or RetrievalConfig()
    order = Window.partitionBy("qid").orderBy(F.desc("key"), "chunk_id")
    within = Window.partitionBy("qid", "kind").orderBy(F.desc("key"), "chunk_id")
    cap = _cap(config)
    own = hits.withColumn("key", key).withColumn("own", F.row_number().over(within)).filter(F.col("own") <= config.k)  # pushed below the shuffle
    kept = own.filter(F.col("own") <= F.coalesce(cap, F.lit(config.k))).drop("own")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.k)


def rerank(pool: DataFrame, config: RetrievalConfig | None = None) -> DataFrame:
    """Fusion of vector and second scores: pool is qid, rank, chunk_id, kind, score, rerank (nullable).

    The first ``rerank_head`` of a question with a second score count by the weighted
    mean, others come after them by score - 1.  A question without second scores
    keeps its vector order."""
    config = config or RetrievalConfig()
    scored = F.max(F.col("rerank").isNotNull() & (F.col("rank") <= config.rerank_head)).over(Window.partitionBy("qid"))
    w = config.rerank_weight
    fused = F.when(F.col("rerank").isNotNull() & (F.col("rank") <= config.rerank_head), w * F.col("rerank") + (1 - w) * F.col("score")).otherwise(F.col("score") - 1)
    return select_capped(pool.withColumn("scored", scored), F.when(F.col("scored"), fused).otherwise(F.col("score")), config).drop("scored")


def route(questions: DataFrame, hits: DataFrame, config: RetrievalConfig | None = None) -> DataFrame:
    """(qid, top_score, route): 'unknown' if there are no hits, or the best score is below the
    threshold and no Latin term of the question is in the hits' ``evidence``."""
    config = config or RetrievalConfig()
    best = hits.groupBy("qid").agg(F.max("score").alias("top_score"), F.array_join(F.collect_list("evidence"), " ").alias("evidence"))
    weak = F.col("top_score").isNull() | ((F.col("top_score") < config.weak_below) & ~F.coalesce(tx.shares_term(F.col("question"), F.col("evidence")), F.lit(False)))
    return questions.join(best, "qid", "left").select("qid", "top_score", F.when(weak, "unknown").otherwise("answer").alias("route"))


def two_stage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Routes of a question as it is and joined to the one before: the second is taken only
    where the first is weak and it is not."""
    other = second.select("qid", F.col("route").alias("other"), F.col("top_score").alias("other_score"))
    joined = first.join(other, "qid", "left")
    use = (F.col("route") == "unknown") & (F.col("other") == "answer")
    return joined.select("qid", F.when(use, F.col("other_score")).otherwise(F.col("top_score")).alias("top_score"), F.when(use, "answer").otherwise(F.col("route")).alias("route"), F.coalesce(use, F.lit(False)).alias("joined"))
