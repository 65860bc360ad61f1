"""Exact quantiles by refining histograms: no task holds a group's values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.work import Scratch


def _ranks(kind: str, p: float) -> tuple[Column, Column, Column]:
    """The two ranks of ``n`` values that a quantile is between, and how far it is from the first to the second."""
    n = F.col("n").cast("decimal(38,0)")
    if kind == "disc":
        rank = F.greatest(F.ceil(n * F.lit(str(p)).cast("decimal(18,17)")), F.lit(1)).cast("long")
        return rank, rank, F.lit(0.0)
    at = (F.col("n") - 1) * F.lit(float(p))
    return (F.floor(at) + 1).cast("long"), (F.ceil(at) + 1).cast("long"), at - F.floor(at)


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Which of ``bins`` equal parts of low to high has a value; never falling as values rise.  Halves, as the width may be more than a double."""
    width = high / 2 - low / 2
    place = F.least(F.floor((v / 2 - low / 2) / F.when(width > 0, width) * bins), F.lit(bins - 1).cast("long"))
    # The greatest value is in the last part, the least in the first, so each pass makes the range smaller.
    return F.when(v == high, bins - 1).when(v == low, 0).otherwise(F.coalesce(place, F.lit(bins - 1).cast("long"))).cast("int")


def exact_quantiles(rows: DataFrame, value: str, groups: list[str], wanted: Mapping[str, tuple[str, float]], bins: int = 2048) -> DataFrame:
    """Groups with ``n``, ``mean``, ``max`` and a column for each of ``wanted``: ('disc', p) is the value of rank
    ceil(p n), ('cont', p) lies between the two ranks next to p (n - 1) + 1; the median is ('cont', 0.5).

    A pass counts the values of a range in equal parts, summed where they are read, and goes on with the part that has the rank,
    from its least to its greatest value; when these are one, the rank is found.  Usual data take two or three passes.
    Null and non-finite values count nowhere; a group without others has no row.  A null group is a group."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "quantiles")
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    own = rows.filter(finite).select(key.alias("g"), v.alias("v"))
    stats = scratch.cut(own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("max")))
    ranks = F.array_distinct(F.array(*(r for kind, p in wanted.values() for r in _ranks(kind, p)[:2])))
    targets = stats.select("g", F.explode(ranks).alias("rank"), F.col("low"), F.col("max").alias("high")).withColumn("need", F.col("rank"))
    targets = scratch.cut(targets)
    found = targets.filter("low = high")
    while not (open_ := targets.filter("low < high")).isEmpty():
        ranges = open_.groupBy("g", "low", "high").agg(F.collect_list(F.struct("rank", "need")).alias("needs"))
        asked = ranges.select(F.col("g").alias("of"), "low", "high", "needs")
        inside = own.join(asked, F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high")))
        counts = inside.groupBy("g", "low", "high", "needs", _bin(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        summed = counts.withColumn("up_to", F.sum("n").over(Window.partitionBy("g", "low", "high").orderBy("bin")))
        one = summed.select("g", F.explode("needs").alias("t"), (F.col("up_to") - F.col("n")).alias("before"), "up_to", "least", "most").filter("t.need > before AND t.need <= up_to")
        targets = scratch.cut(one.select("g", "t.rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("t.need") - F.col("before")).alias("need")))
        found = found.unionByName(targets.filter("low = high"))
    by_rank = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at")).withColumnRenamed("g", "of")
    out = stats.join(by_rank, F.col("g").eqNullSafe(F.col("of")))

    def quantile(kind: str, p: float) -> Column:
        a, b, part = _ranks(kind, p)
        lower, upper = F.element_at("at", a), F.element_at("at", b)
        return lower if kind == "disc" else F.when(part == 0, lower).otherwise(lower * (1 - part) + upper * part)

    names = [F.col("g").getField(g).alias(g) for g in groups]
    return out.select(*names, "n", "mean", "max", *(quantile(*q).alias(name) for name, q in wanted.items()))
