"""Packing along the curve: the curve itself, the ids, and that every id lies in one place."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import curvepack, queries
from lodestone.llm.tables import Scratch

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 1), (2, 5), (3, 3), (4, 2), (6, 2)])
def test_steps_of_the_curve_are_steps_in_space(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = curvepack.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_like_documents_have_like_keys():
    rng = np.random.default_rng(3)
    bases = rng.poisson(rng.gamma(0.05, 20, (40, curvepack.BUCKETS)))
    near = np.concatenate([bases, bases + (rng.random(bases.shape) < 0.002)])
    order = np.argsort(curvepack.curve_keys(near, curvepack.directions()))
    at = np.empty(80, int)
    at[order] = np.arange(80)
    apart = np.abs(at[:40] - at[40:])
    assert np.median(apart) <= 2 < np.median(np.abs(at[:40] - np.roll(at[40:], 7)))


def test_ids_are_those_of_the_library(library):
    rng = random.Random(4)
    coder = curvepack.Tokens(open(FILE, "rb").read(), public_tokenizers.PATTERN)
    alphabet = [*map(chr, range(32, 127)), *" \n\t  ", *"éßñ　 漢字кот\U0001f600"]
    texts = ["", "<|endoftext|> x", " \n\n  x", "a" * 5000, " " * 3000 + "b"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.ids(text).tolist() == want
        assert coder.ids(text, 16).tolist() == want


def held(rows, docs, library, capacity):
    """Every id of every document in one piece, its checksum, no gaps, no padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[i])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    assert sum(sum(n for _, n in own) < capacity for own in sequences.values()) <= capacity.bit_length()


def test_packing_of_odd_documents(spark, library):
    rng = random.Random(9)
    words = ["the", "über", "quick", "42", "—", "naïve", "x" * 50]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 40, 400))))) for i in range(120)]
    docs += [(500 + i, "copy of one text, again and again") for i in range(60)] + [(700, None), (701, ""), (702, "z " * 60_000)]
    frame = spark.createDataFrame([(i, t, i, "n") for i, t in docs], "doc_id long, text string, part long, rest string").repartition(6)
    scratch = Scratch(spark, "curve-test")
    for capacity in (64, 1):
        rows = curvepack.pack(frame.filter("doc_id <> 702") if capacity == 1 else frame, FILE, public_tokenizers.PATTERN, scratch, capacity).collect()
        held(rows, [d for d in docs if capacity > 1 or d[0] != 702], library, capacity)
    scratch.clear()


def test_repeated_rows_null_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (None, "same words here"), (None, None)], "doc_id long, text string")
    rows = curvepack.pack(frame, FILE, public_tokenizers.PATTERN, Scratch(spark, "curve-test"), 8).collect()
    by = Counter()
    for r in rows:
        by[r.doc_id] += r.length
    assert by == {1: 8, None: 5}
    assert curvepack.pack(frame.limit(0), FILE, public_tokenizers.PATTERN, Scratch(spark, "curve-test"), 8).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        curvepack.pack(frame, FILE, public_tokenizers.PATTERN, Scratch(spark, "curve-test"), 1000)


def test_registered_query_holds_every_id(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held(queries.op13_curve_packing(spark, sf_dir).collect(), docs, library, 1024)
