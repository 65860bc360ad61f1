"""Quantiles against sorting, bitmaps against sets, the digest tree, numbering of hot groups."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bitmaps, evaluation, index, quality, quantiles

WANTED = {"p0": ("disc", 0.0), "p95": ("disc", 0.95), "p100": ("disc", 1.0), "median": ("cont", 0.5), "p10": ("cont", 0.1)}


def by_sorting(values):
    v = sorted(values)
    disc = lambda p: v[max(1, math.ceil(round(p * len(v), 9))) - 1]

    def cont(p):
        at = (len(v) - 1) * p
        a, b = v[math.floor(at)], v[math.ceil(at)]
        return a if at == math.floor(at) else a * (1 - (at - math.floor(at))) + b * (at - math.floor(at))

    return [disc(0.0), disc(0.95), disc(1.0), cont(0.5), cont(0.1)]


@pytest.mark.parametrize("bins", [16, 2048])
def test_quantiles_are_those_of_sorting(spark, bins):
    rng = random.Random(bins)
    data = {
        None: [rng.random() for _ in range(301)],
        "hot": [rng.choice([1.0, 1.0, 1.0, 2.0, -3.5]) for _ in range(3000)] + [7.25],
        "one": [5.0],
        "same": [2.5] * 40,
        "wide": [1.7e308, -1.7e308, 0.0, 5e-324, -5e-324, 1.0] + ([10.0**e for e in range(-20, 20)] if bins > 16 else []),
        "odd": [struct.unpack("d", struct.pack("Q", rng.getrandbits(62)))[0] % 1e9 for _ in range(77)],
    }
    rows = [(g, x) for g, own in data.items() for x in own] + [("none", None), ("hot", float("nan")), ("hot", float("inf")), (None, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in quantiles.exact_quantiles(frame, "v", ["g"], WANTED, bins).collect()}
    assert set(got) == set(data)
    for g, own in data.items():
        assert [got[g][n] for n in WANTED] == by_sorting(own), g
        assert (got[g].n, got[g].max) == (len(own), max(own))
    (whole,) = quantiles.exact_quantiles(frame.filter("g <> 'wide'"), "v", [], {"p95": ("disc", 0.95)}).collect()
    assert whole.p95 == by_sorting([x for g, own in data.items() if g not in (None, "wide") for x in own])[1]
    assert quantiles.exact_quantiles(frame.limit(0), "v", ["g"], WANTED).collect() == []


def test_no_task_buffers_a_group(spark):
    frame = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    plan = evaluation.latency(frame, "v", 5.0, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_bitmaps_never_say_no_to_what_they_hold(spark):
    rows = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    bitmap = bitmaps.of_buckets(rows.select(bitmaps.bucket(F.col("h"), 16).alias("b")), "b", 16)
    found = bitmaps.asked(spark.range(3000), bitmap).select("id", bitmaps.may_hold(bitmaps.bucket(F.xxhash64("id"), 16)).alias("m")).collect()
    assert all(r.m for r in found if r.id % 3 == 0) and 0 < sum(r.m for r in found if r.id % 3) < 200


@pytest.mark.parametrize("bits", [6, 22])
def test_repeated_lines_are_those_of_counting(spark, bits):
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(30)] + ["a | b", "x" * 80]
    docs = [(i, rng.choice(["en", "de", None]), "\n".join(rng.choice(lines) if rng.random() < 0.4 else f"own {rng.random()}" for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(99, "en", None)]
    counts = {}
    for i, lang, text in docs:
        for x in {x for x in (text or "").split("\n") if text is not None}:
            counts.setdefault((lang, x), set()).add(i)
    drop = lambda lang, x: lang is not None and len(x) < 60 and "|" not in x and len(counts[lang, x]) >= 5
    want = {i: None if text is None else "\n".join(x for x in text.split("\n") if not drop(lang, x)) for i, lang, text in docs}
    got = {r.doc_id: r.text for r in quality.without_repeated_lines(spark.createDataFrame(docs, "doc_id int, lang string, text string"), bits=bits).collect()}
    assert {i: t for i, t in got.items() if i != 99} == {i: t for i, t in want.items() if i != 99}


def test_vectors_are_made_once_and_only_for_new_inputs(spark):
    chunks = spark.createDataFrame([(i, f"text {i % 30}") for i in range(100)], "chunk_id int, input string")
    known = chunks.filter("chunk_id < 20").select(F.sha2("input", 256).alias("input_hash"), F.array(F.lit(1.0)).alias("embedding"))
    for bits in (6, 22):  # a full bitmap and a sparse one
        got = index.embed(chunks, known, lambda c: F.array(F.length(c).cast("double")), bits).collect()
        assert len(got) == 100 and all(r.reused == (r.chunk_id % 30 < 20) and r.embedding == ([1.0] if r.reused else [7.0]) for r in got)


def test_the_digest_depends_on_order_and_nothing_else(spark):
    rows = [(i, f"h{i}") for i in range(500)]
    frame = lambda own, n: spark.createDataFrame(own, "chunk_id long, chunk_text_sha256 string").repartition(n)
    digest = lambda d: tuple(index.version_digest(d, "r", 16).first())
    base = digest(frame(rows, 1))
    assert base == digest(frame(rows[::-1], 5)) and base[0] == 500
    swapped = [*rows[:100], (100, "h101"), (101, "h100"), *rows[102:]]
    assert digest(frame(swapped, 3)) != base and digest(frame(rows[:-1], 3)) != base
    assert index.version_digest(frame(rows, 2), "other", 16).first()[1] != base[1]
    assert digest(frame(rows, 1).limit(0))[0] == 0


def test_numbers_of_a_hot_group(spark):
    frame = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("b").alias("g"), F.col("id").alias("o")).repartition(4)
    got = {(r.g, r.o) for r in evaluation.every_nth(frame, 6, "g", "o").collect()}
    want = {(g, o) for g, own in (("hot", [i for i in range(4000) if i % 10 < 9]), ("b", [i for i in range(4000) if i % 10 == 9])) for o in own[::6]}
    assert got == want
