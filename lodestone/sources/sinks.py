"""Writing: once-only versions, replaced versions, appends without repeats, feedback.

A version is a folder of Parquet files and a small file, put last, that names it; without it
the version is unfinished.  All paths go through Spark, so they may be remote.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import commits
from lodestone.sources.work import ages, exists, remove


class VersionConflict(Exception):
    """A version exists with other contents."""


class HeldRows(Exception):
    """A batch has rows that were not done."""


def content_digest(rows: DataFrame) -> str:
    """A digest of the rows in any order: their number, sum and exclusive or of their hashes."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(rows.columns)))
    n, total, xor = rows.select(h.alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.expr("bit_xor(h)")).first()
    return f"{n}:{total or 0}:{xor or 0}"


def write_once(rows: DataFrame, path: str, *partitions: str) -> str:
    """'written', or 'existing' if the version is there with the same contents.

    A version with other contents, in its files or its manifest, raises
    VersionConflict and is not touched.  Rows go to a folder of their own, and the manifest that names it is put
    only if there is none: of two writers at once one has written, for the other the version exists."""
    spark, digest = rows.sparkSession, content_digest(rows)
    known = commits.read_json(spark, f"{path}/manifest.json")
    if known is None:
        folder = f"{path}/data/{uuid.uuid4().hex}"
        rows.write.partitionBy(*partitions).parquet(folder)
        if commits.put_if_absent(spark, f"{path}/manifest.json", json.dumps({"digest": digest, "folder": folder})):
            return "written"
        remove(spark, folder)
        known = commits.read_json(spark, f"{path}/manifest.json")
    stored = content_digest(spark.read.parquet(known["folder"]).select(*rows.columns))
    if known["digest"] != digest or stored != digest:
        raise VersionConflict(f"{path} exists with other contents")
    return "existing"


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """A finished version whose files still match its manifest."""
    known = commits.read_json(spark, f"{path}/manifest.json")
    rows = spark.read.parquet(known["folder"]) if known else None
    if rows is None or content_digest(rows) != known["digest"]:
        raise VersionConflict(f"{path} is unfinished or changed")
    return rows


def replace_partitions(rows: DataFrame, path: str, *partitions: str) -> None:
    """The partitions that ``rows`` has are replaced as a whole; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def replace_version(vectors: DataFrame, path: str, dim: int) -> int:
    """The index versions in ``vectors`` (index_version, chunk_id, embedding, ...), after a check of the dimension.

    The rows are written to a folder of their own; then a numbered commit names the folder of each version, so that a
    reader sees all versions as they were or as they are, and a job that fails changes nothing.  Two writers at once
    both end, the later one on top of the other.  Returns the commit's number."""
    spark, folder = vectors.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} components")))
    vectors.withColumn("embedding", checked).write.partitionBy("index_version").parquet(folder)
    written = spark.read.parquet(folder)
    digest = content_digest(written)
    counts = written.groupBy(F.col("index_version").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()  # as many as there are versions
    own = {r["v"]: {"folder": folder, "n": r["n"], "digest": digest} for r in counts}
    return commits.commit(spark, f"{path}/commits", lambda state: state | own)


def read_current(spark: SparkSession, path: str, verify: bool = False) -> DataFrame | None:
    """The rows of all index versions as the last commit has them; ``verify`` compares the folders with their digests."""
    _, state = commits.latest(spark, f"{path}/commits")
    out = None
    folders: dict[tuple[str, str], list[str]] = {}
    for version, of in state.items():
        folders.setdefault((of["folder"], of["digest"]), []).append(version)
    for (folder, digest), versions in sorted(folders.items()):
        rows = spark.read.parquet(folder)
        if verify and content_digest(rows) != digest:
            raise VersionConflict(f"{folder} is unfinished or changed")
        rows = rows.filter(F.col("index_version").cast("string").isin(versions))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def remove_unnamed(spark: SparkSession, path: str, keep: int = 1, hours: float = 24) -> int:
    """Removes all but the last ``keep`` commits, and the data folders that none of these names and that nothing has
    been written to for ``hours``, so that a writer at work keeps its own.  How many folders went."""
    named = {of["folder"].rsplit("/", 1)[-1] for state in commits.forget(spark, f"{path}/commits", keep) for of in state.values()}
    old = [name for name, age in ages(spark, f"{path}/data") if name not in named and age >= 3600 * hours]
    for name in old:
        remove(spark, f"{path}/data/{name}")
    return len(old)


def differences(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, state): rows that are missing, extra or different."""
    columns = sorted(c for c in expected.columns if c != key)
    pack = lambda d, name: d.select(key, F.to_json(F.struct(*columns)).alias(name), F.lit(True).alias(f"has_{name}"))
    both = pack(stored, "stored").join(pack(expected, "expected"), key, "full")
    state = F.when(F.col("has_stored").isNull(), "missing").when(F.col("has_expected").isNull(), "extra").when(~F.col("stored").eqNullSafe(F.col("expected")), "different")
    return both.select(key, state.alias("state")).filter("state is not null")


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Rows whose key the table doesn't have yet are appended, of repeated keys one."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    rows.write.mode("append").parquet(path)


def with_feedback(logs: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs with the last rating of each message, and the feedback of unknown messages.

    ``feedback``: message_id, rating, ts; at equal times the greater rating counts."""
    last = feedback.groupBy("message_id").agg(F.max(F.struct("ts", "rating"))["rating"].alias("rating"))
    return logs.join(last, "message_id", "left"), feedback.join(logs.select("message_id"), "message_id", "left_anti")


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables as one; columns that either lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def held_and_done(rows: DataFrame, path: str, batch: str, status: str = "status", stop: bool = False) -> DataFrame:
    """A batch by status, each in its own partition of the batch, and the number of rows of each.

    A batch that is run again replaces itself and no other.  ``stop`` raises HeldRows, after the
    rows are written, if any have the status 'held'."""
    spark = rows.sparkSession
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", status).parquet(path)
    counts = spark.read.parquet(path).filter(F.col("batch").cast("string") == batch).groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    if stop and (held := counts.filter(F.col(status) == "held").first()):
        raise HeldRows(f"{held['n']} rows of the batch {batch} are held")
    return counts
