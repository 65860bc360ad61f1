"""Index versions: input text, reuse of vectors, digests, manifests, and the link graph that feeds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import bitmaps
from lodestone.sources.work import Scratch


def input_text(title: Column, sections: Column, text: Column) -> Column:
    """What an encoder reads: title, section titles, text."""
    return F.concat(title, F.lit("\n"), F.array_join(sections, " > "), F.lit("\n\n"), text)


def token_guard(tokens: Column, most: int, chunk_id: Column) -> Column:
    """The number of tokens; a chunk with too many stops the job instead of being cut."""
    return F.when(tokens <= most, tokens).otherwise(F.raise_error(F.concat(F.lit("too many tokens: "), chunk_id.cast("string"))))


def embed(chunks: DataFrame, known: DataFrame, encode: Callable[[Column], Column], bits: int = bitmaps.BITS) -> DataFrame:
    """(chunk_id, embedding, reused): the vector of each chunk's ``input``, from ``known`` (input_hash,
    embedding) where that has it, else by ``encode``, the column expression of an encoder.  Each new input is encoded once, however many chunks have it.

    A bitmap of the known hashes goes to the scan of the chunks: an input that is not in it is new without a join, and
    only inputs that must be encoded move with their texts."""
    keyed = chunks.select("chunk_id", "input", F.sha2("input", 256).alias("input_hash"))
    old = known.select("input_hash", "embedding").dropDuplicates(["input_hash"])
    place = bitmaps.bucket(F.xxhash64("input_hash"), bits)
    marked = bitmaps.asked(keyed, bitmaps.of_buckets(known.select(place.alias("bucket")), "bucket", bits)).withColumn("maybe", bitmaps.may_hold(place)).drop("bitmap")
    by_chance = marked.filter("maybe").select("input_hash").distinct().join(old.select("input_hash"), "input_hash", "left_anti")
    texts = marked.filter("not maybe").select("input_hash", "input").unionByName(marked.filter("maybe").select("input_hash", "input").join(by_chance, "input_hash", "left_semi"))
    new = texts.groupBy("input_hash").agg(F.min("input").alias("input"))
    made = new.select("input_hash", encode(F.col("input")).alias("embedding"), F.lit(False).alias("reused"))
    every = old.withColumn("reused", F.lit(True)).unionByName(made)
    return keyed.select("chunk_id", "input_hash").join(every, "input_hash").select("chunk_id", "embedding", "reused")


def version_digest(chunks: DataFrame, revision: str, fan_in: int = 4096) -> DataFrame:
    """(n, digest) of a version: a tree of digests over its rows in the order of their ids.

    Rows (chunk_id, chunk_text_sha256) are numbered in order; every ``fan_in`` of them are a leaf, every ``fan_in``
    leaves a node, and so on for three levels; what is left then, one node for 2.8e14 rows, makes the digest.  No task has more
    than ``fan_in`` digests of a level.  It is the same for any partitioning, and another if two ids change places."""
    line = F.concat_ws("\u001f", F.col("chunk_id").cast("string"), F.col("chunk_text_sha256"))
    nodes = numbered(chunks.select("chunk_id", line.alias("d"), F.lit(0).alias("all")), "all", "chunk_id", "d").select((F.col("number") - 1).alias("i"), "d", F.lit(1).cast("long").alias("n"))
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("i", "d")))["d"], "\n")
    for _ in range(3):
        nodes = nodes.groupBy(F.expr(f"i div {fan_in}").alias("up")).agg(F.sha2(joined, 256).alias("d"), F.sum("n").alias("n")).withColumnRenamed("up", "i")
    return nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.substring(F.sha2(F.concat(F.lit(revision), joined), 256), 1, 12).alias("digest"))


def manifest(chunks: DataFrame) -> DataFrame:
    """Counts and sizes of a version, by kind and in total (null kind)."""
    sets = chunks.groupingSets([["chunk_kind"], []], "chunk_kind")
    n = F.length("text")
    return sets.agg(F.grouping("chunk_kind").cast("boolean").alias("total"), F.count(F.lit(1)).alias("chunks"), F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"), F.sum(n).alias("chars"))


def reachable(spark: SparkSession, roots: DataFrame, links: DataFrame, blocked: Column | None = None, most: int | None = None) -> DataFrame:
    """(page, depth) of the pages that links (src, dst) reach from roots (page) in at most ``most`` steps (null: any number), each at its least depth.

    One join of the frontier a step; pages whose ``blocked`` expression (over dst) holds are not
    entered.  Each frontier is a written table, and their union at every eighth step."""
    edges = links.select("src", "dst")
    if blocked is not None:
        edges = edges.filter(~F.coalesce(blocked, F.lit(False)))
    scratch = Scratch(spark, "reachable")
    edges = scratch.cut(edges.distinct())
    seen = scratch.cut(roots.select("page").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        found = edges.join(frontier.select(F.col("page").alias("src")), "src").select(F.col("dst").alias("page")).distinct()
        frontier = found.join(seen, "page", "left_anti").withColumn("depth", F.lit(depth))
        frontier = scratch.cut(frontier)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = scratch.cut(seen)
    return seen


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their ``number`` in the order of a group, from 1, without a task that has a whole group.

    Rows are sorted by ranges; each range's first place of a group is known from counts, of which
    there is one for each group and range.  Rows that are equal in group and order are in any order."""
    placed = Scratch(rows.sparkSession, "numbered").cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_group"), "_part", "_first", before.alias("_before"))
    joined = placed.withColumn("_own", part).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_own") == F.col("_part")))
    return joined.withColumn("number", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_own", "_group", "_part", "_first", "_before")


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks in the one order that does not depend on how they were made: by document, then chunk."""
    return chunks.orderBy("doc_id", "chunk_id")


def stable_ids(existing: DataFrame, paths: DataFrame, prefix: str) -> DataFrame:
    """(lang, path, id): paths that have an id keep it, new ones of a language are numbered on in order."""
    base = existing.groupBy("lang").agg(F.max(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")).alias("base"))
    fresh = numbered(paths.select("lang", "path").distinct().join(existing.select("lang", "path"), ["lang", "path"], "left_anti"), "lang", "path")
    number = F.coalesce("base", F.lit(0)) + F.col("number")
    made = fresh.join(base, "lang", "left").select("lang", "path", F.format_string(f"{prefix}-%s-%04d", F.col("lang"), number).alias("id"))
    return existing.select("lang", "path", "id").unionByName(made)
