"""Reading the inputs and the bounds that several operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.work import Scratch, shared_folder

__all__ = ["SALTS", "Scratch", "bound_batches", "held_out", "labelled", "labelled_sample", "read", "read_rows", "row_of", "shared_folder", "spread_join", "text_or_empty"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by Spark's reader only (the folder may be remote)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch: Spark's default of 10,000 rows, or 64 MB, is there several times, in the JVM and in Python, while a task runs.
BATCH_BYTES = 4 << 20


#: Rows of a batch of the Parquet reader.  Its texts are one array, which doubles as it grows: with Spark's default of 4,096 rows it has tens of MB.
READ_ROWS = 512
_READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession) -> None:
    """Sets for the session how large batches of Arrow and of the Parquet reader grow, unless that has been set; rows and results are the same."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), (_READ_ROWS, READ_ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


@contextlib.contextmanager
def read_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run within reads so many rows at a time from Parquet files: for tables whose rows are large."""
    before = spark.conf.get(_READ_ROWS, None)
    spark.conf.set(_READ_ROWS, most)
    try:
        yield
    finally:
        spark.conf.unset(_READ_ROWS) if before is None else spark.conf.set(_READ_ROWS, before)


def row_of(names: list[str]) -> Column:
    """A struct of columns by their names, whatever characters these have."""
    return F.struct(*(F.col("`" + n.replace("`", "``") + "`") for n in names))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


SALTS = 64


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner", hot: int = 1024, broadcast_keys: int = 500_000) -> DataFrame:
    """``rows`` joined to ``facts`` on ``key``, of which no task gets all rows of a frequent key.

    ``facts`` has one row for each key, with the number ``n`` of its rows, and is cheap to
    read again (a written table).  Keys of more than ``hot`` rows are broadcast if they are counted
    to be at most ``broadcast_keys``; else their rows are dealt by the hash of the column ``by`` as well."""
    frequent = facts.filter(F.col("n") > hot)
    n_frequent = frequent.count()
    if not n_frequent:
        return rows.join(facts, key, how)
    others = facts.filter(F.col("n") <= hot)
    if n_frequent <= broadcast_keys:
        spread, rest = rows.join(F.broadcast(frequent), key), rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    else:
        salt = "salt of " + key
        wide = frequent.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(wide, [key, salt], "left").drop(salt)
        spread, rest = marked.filter("n IS NOT NULL"), marked.filter("n IS NULL").select(rows.columns)
    return spread.unionByName(rest.join(others, key, how))


def _labels_of(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) outside the held-out fold, one row an id: of both labels the least."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )


def labelled(documents: DataFrame, labels: DataFrame, label: str, broadcast_ids: int = 2_000_000) -> DataFrame:
    """doc_id (as a long), 0/1 label and text of all labelled training documents; repeated rows stay.

    Rows whose held-out remainder is 0 never take part, nor null labels.  Of an id with both labels the least
    counts.  Ids are broadcast if they are counted to be at most ``broadcast_ids``, else texts are shuffled."""
    own = _labels_of(labels, label)
    if own.count() <= broadcast_ids:
        own = F.broadcast(own)
    rows = documents.select("doc_id", text_or_empty().alias("text")).join(own, "doc_id")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int, after: int = 0) -> DataFrame:
    """Those of ``labelled`` with at most ``most`` ids, without the first ``after``; of repeated rows with
    one id the least text.

    The choice is by hash of the id, so it is the same at every run; the chosen ids number at
    most ``most``, which is the proven bound of the broadcast."""
    ordered = _labels_of(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (ordered.offset(after) if after else ordered).limit(most)
    rows = documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
