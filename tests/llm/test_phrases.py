"""Phrase mining against counting in dictionaries, and its perfect hash."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import phrases
from lodestone.llm.tables import Scratch
from lodestone.llm.textblocks import mix


def by_counting(docs, least, best, longest=4, share=80):
    f = defaultdict(Counter)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for g, v in counts.items() if len(g) == 1)
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(b) > len(g) and 100 * c >= share * a and any(b[i : i + len(g)] == g for i in range(len(b))) for b, c in candidates.items()):
                kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, left, right, n, -s) for i, (s, a, g, left, right) in enumerate(sorted(kept)[:best])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "über", "É", "new", "york", "a", "ab", "x" * 40, "日本", "b"]
    fixed = ["new York city hall", "of the a", "ab AB ab ab", "é É"]
    docs = []
    for _ in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", ".", ",", "\n", "\x0b", "\t"]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["en", "de", None, ""]), rng.choice([" ", "  "]).join(parts)))
    return docs + [("en", None), ("en", ""), (None, " . ,"), ("de", "new york " * 3000), ("de", "new york " * 3000)]


@pytest.mark.parametrize(("filter_bits", "block_keys", "best"), [(20, 1 << 21, 2000), (6, 37, 2000), (20, 1000, 9)])
def test_phrases_are_those_of_counting(spark, filter_bits, block_keys, best):
    docs = corpus(3)
    frame = spark.createDataFrame([(*d, "w", 3) for d in docs], "lang string, text string, word string, f int").repartition(5)
    scratch = Scratch(spark, "phrases-test")
    got = phrases.collocations(frame, scratch, least=5, best=best, filter_bits=filter_bits, block_keys=block_keys)
    assert sorted(map(tuple, got.collect())) == by_counting(docs, 5, best)
    scratch.clear()


def test_no_candidates_and_no_rows(spark):
    frame = spark.createDataFrame([("en", "one two")], "lang string, text string")
    for rows in (frame, frame.limit(0)):
        assert phrases.collocations(rows, Scratch(spark, "phrases-test")).collect() == []


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(2**61 - 1, 2**61, 2**61 + 7)], "a long, l long, r long")
    got = rows.select(phrases._floor_share(2_000_000, F.col("a"), F.col("l") + F.col("r"))).first()[0]
    assert got == 2_000_000 * (2**61 - 1) // (2**62 + 7)


def test_the_hash_is_perfect_and_minimal():
    keys = mix(np.arange(5000, dtype=np.uint64))
    table = phrases.Hash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert (table.slots(mix(np.arange(9000, 9999, dtype=np.uint64))) < 5000).all()
    assert len(phrases.Hash(keys[:0]).slots(keys)) == 5000


def test_words_of_one_hash_stay_apart():
    data = np.frombuffer(b"onetwoonetwosix", np.uint8)
    starts, size = np.arange(0, 15, 3), np.full(5, 3)
    table = phrases._WordTable(np.zeros(5, np.uint64), np.zeros(5, np.int64), size, np.ones(5, np.int64), data, starts)
    rows = phrases._WordTable.joined([table, table]).rows(["en"]).to_pylist()
    counts = Counter()
    for r in rows:
        counts[r["word"]] += r["f"]
    assert counts == {"one": 4, "two": 4, "six": 2}


def test_a_seed_that_lets_words_meet_is_not_taken(spark, monkeypatch):
    docs = corpus(4)
    frame = spark.createDataFrame(docs, "lang string, text string")
    shared, tried = phrases.Miner._shared, []

    def meet_once(self, entries, matters):
        tried.append(1)
        return len(tried) == 1 or shared(self, entries, matters)

    monkeypatch.setattr(phrases.Miner, "_shared", meet_once)
    got = phrases.collocations(frame, Scratch(spark, "phrases-test"), least=5, filter_bits=16)
    assert sorted(map(tuple, got.collect())) == by_counting(docs, 5, 2000)
    assert len(tried) == 3
