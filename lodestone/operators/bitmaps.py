"""A set of hashes as a bitmap of fixed size: it says no, or perhaps.  Built and asked in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 22


def bucket(h: Column, bits: int = BITS) -> Column:
    return F.pmod(h, F.lit(1 << bits))


def of_buckets(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """One row: the bitmap of a column of buckets, as an array of longs.  What is collected for it are at most 2**(bits - 6) words."""
    spark: SparkSession = rows.sparkSession
    words = rows.groupBy(F.shiftright(column, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("bits"))
    filled = [0] * (1 << (bits - 6))
    for at, word in words.collect():
        filled[at] = word
    return spark.createDataFrame([(0, filled)], "bitmap_key int, bitmap array<long>")


def asked(rows: DataFrame, bitmap: DataFrame) -> DataFrame:
    """``rows`` with a column ``bitmap``; the bitmap is one row, so what is broadcast has its size."""
    return rows.withColumn("bitmap_key", F.lit(0)).join(F.broadcast(bitmap), "bitmap_key").drop("bitmap_key")


def may_hold(place: Column) -> Column:
    """Whether the row's ``bitmap`` may have a bucket."""
    word = F.get(F.col("bitmap"), F.shiftright(place, 6).cast("int"))
    return F.call_function("getbit", word, (place.bitwiseAND(F.lit(63))).cast("int")) == 1
