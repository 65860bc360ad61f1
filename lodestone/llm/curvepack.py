"""Operator 13, packing along a space-filling curve.

A document's hashed token counts are projected to a few dimensions and these to a key
on a Hilbert curve, so documents of like content have near keys.  Documents are sorted
by ranges of the key and their tokens laid end to end along it; a sequence is what lies
between two cuts.

Whole sequences of a long document are cut off first, so that only what is left of each
document, less than a sequence, crosses a shuffle with its ids.  Places along the curve
are sums within a partition and the sums of the partitions before, of which the driver
has one number a partition.  The last tokens of all are cut at powers of two, so no
sequence needs padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import Scratch, text_or_empty
from lodestone.llm.textblocks import BASE, mix

DIMENSIONS, BITS, BUCKETS = 6, 10, 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (rows of coordinates below 2**bits) on the Hilbert curve: neighbours
    on the curve are neighbours in space.  By Skilling's transposition of axes."""
    x = cells.astype(np.uint64).copy()
    n = x.shape[1]
    for bit in reversed(range(1, bits)):
        low = np.uint64((1 << bit) - 1)
        for i in range(n):
            turned = (x[:, i] >> np.uint64(bit)) & np.uint64(1) == 1
            swap = np.where(turned, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for bit in reversed(range(1, bits)):
        flip ^= np.where((x[:, n - 1] >> np.uint64(bit)) & np.uint64(1) == 1, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(len(x), np.uint64)
    for bit in reversed(range(bits)):
        for i in range(n):
            key = key << np.uint64(1) | (x[:, i] >> np.uint64(bit)) & np.uint64(1)
    return key.astype(np.int64)


def directions(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signs of a projection, by hash of bucket and dimension."""
    at = np.arange(buckets * dimensions, dtype=np.uint64).reshape(buckets, dimensions)
    return np.where(mix((at + np.uint64(1)) * BASE) & np.uint64(1), np.float32(1), np.float32(-1))


def curve_keys(counts: np.ndarray, signs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of rows of bucket counts: root counts of length 1, projected, and each dimension dealt into 2**bits cells."""
    weights = np.sqrt(counts, dtype=np.float32)
    weights /= np.maximum(np.sqrt(counts.sum(1, keepdims=True, dtype=np.float32)), 1)
    shares = 1 / (1 + np.exp(-1.702 * (weights @ signs)))
    return hilbert_keys(np.minimum((shares * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


class Tokens:
    """The ids of a byte-level BPE file of the tokenizers library, without special tokens.

    Its vocabulary is in the order of its merges, which is checked; then ids are ranks, and the merges
    of the tiktoken library, several times as fast, give the same ids."""

    def __init__(self, file: bytes, pattern: str):
        model = json.loads(file)["model"]
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merged]
        if any(i >= j for i, j in zip(ids, ids[1:])) or ids and ids[0] < 256:
            raise ValueError("the vocabulary is not in the order of the merges")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 or all(c in byte_of for c in token) and i <= ids[-1]}
        self.coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1

    def ids(self, text: str, part: int = 1 << 16) -> np.ndarray:
        """A long text goes in parts that end where white space follows other characters: no match of the
        pattern goes over such a place, so the ids are those of the whole."""
        if len(text) <= part:
            return self.coder.encode_to_numpy(text, disallowed_special=())
        out, at = [], 0
        edge = re.compile(r"(?<=\S)(?=\s)")
        while at < len(text):
            cut = edge.search(text, at + part) if at + part < len(text) else None
            end = cut.start() if cut else len(text)
            out.append(self.coder.encode_to_numpy(text[at:end], disallowed_special=()))
            at = end
        return np.concatenate(out)


_CODERS: dict[tuple[int, str], Tokens] = {}


def _coder(file, pattern: str) -> Tokens:
    """That of a broadcast file, kept for the later tasks of this worker."""
    key = (hash(file.value), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Tokens(file.value, pattern)
    return _CODERS[key]


_TOKENIZED = pa.schema([("own", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("curve_key", pa.int64()), ("first_whole", pa.int64()), ("wholes", pa.list_(pa.int64())), ("rest", pa.binary())])
TOKENIZED = "own long, doc_id long, doc_tokens long, curve_key long, first_whole long, wholes array<long>, rest binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
_SLICE_TOKENS = 1 << 20


def tokenized(documents: DataFrame, vocabulary: str, pattern: str, capacity: int) -> DataFrame:
    """A row for each document: a number of its own, its tokens, the place on the curve, the checksums of its whole
    sequences (numbered on from ``first_whole``), and the ids of the rest.  The text is read and encoded once."""
    spark = documents.sparkSession
    file = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, signs = _coder(file, pattern), directions()
        bucket = (mix((np.arange(coder.size, dtype=np.uint64) + np.uint64(1)) * BASE) % np.uint64(BUCKETS)).astype(np.int64)
        narrow = "<u2" if coder.size <= 1 << 16 else "<u4"
        base = TaskContext.get().partitionId() << 33
        rows = wholes_before = 0
        counts: list[np.ndarray] = []
        columns: list[list] = [[], [], [], [], [], []]

        def made() -> pa.RecordBatch:
            own, doc_id, n, first, wholes, rest = columns
            keys = curve_keys(np.stack(counts), signs) if counts else []
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((own, doc_id, n, keys, first, wholes, rest), _TOKENIZED)], schema=_TOKENIZED)
            for c in (counts, *columns):
                c.clear()
            return batch

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(coder.ids(text.as_py()), np.uint32(0)).astype("<u4")
                whole = len(ids) // capacity
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * capacity * k : 4 * capacity * (k + 1)]) for k in range(whole)]
                counts.append(np.bincount(bucket[ids[:-1]], minlength=BUCKETS))
                for c, v in zip(columns, (base + rows, doc_id, len(ids), base + wholes_before, crcs, ids[whole * capacity :].astype(narrow).tobytes())):
                    c.append(v)
                rows, wholes_before, held = rows + 1, wholes_before + whole, held + len(ids)
                if held >= _SLICE_TOKENS or len(counts) >= 256:
                    yield made()
                    held = 0
        yield made()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, TOKENIZED)


def place(at: int, whole: int, total: int, capacity: int) -> tuple[int, int, int]:
    """Sequence, offset and room of a token's place along the curve: sequences of ``capacity`` tokens,
    at the end of all of the powers of two that make up the rest."""
    if at < whole:
        return at // capacity, at % capacity, capacity - at % capacity
    sequence, begin, left = whole // capacity, whole, total - whole
    while True:
        size = 1 << left.bit_length() - 1
        if at < begin + size:
            return sequence, at - begin, begin + size - at
        sequence, begin, left = sequence + 1, begin + size, left - size


def pack(documents: DataFrame, vocabulary: str, pattern: str, scratch: Scratch, capacity: int = 1024) -> DataFrame:
    """Pack all ``documents`` (doc_id, text) into sequences of at most ``capacity`` tokens, a power of two.

    One row for each piece: the document's ids before it (``start``), its length and the crc32 of its ids as
    little-endian unsigned 32-bit integers, the document's number of ids with the 0 that ends it, and where the piece lies.
    Every id is in one piece; sequences have no gaps, and ``capacity`` or a power of two of ids.  A null text is
    empty and has only the 0.  Rows of one key (copies) are sorted by a number of their own, so they lie
    next to each other over as many partitions as they fill.  Null ids stay null, repeated rows are packed
    each, an empty table has no pieces; other columns are not read.  Sequence numbers are not without holes."""
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    docs = scratch.cut(tokenized(documents, vocabulary, pattern, capacity))
    rests = docs.filter(F.length("rest") > 0).select("own", "doc_id", "doc_tokens", "curve_key", "rest")
    width = F.when(F.length("rest") == 2 * (F.col("doc_tokens") % capacity), 2).otherwise(4)
    rests = rests.withColumn("width", width)
    schema = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("n", pa.int64()), ("rest", pa.binary()), ("width", pa.int32())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy() % capacity
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(ends - n), batch.column(0), batch.column(1), pa.array(n), batch.column(2), batch.column(3)], schema=schema)
            before = int(ends[-1]) if len(n) else before

    along = rests.repartitionByRange("curve_key", "own").sortWithinPartitions("curve_key", "own").select("doc_id", "doc_tokens", "rest", "width")
    along = scratch.cut(along.mapInArrow(summed, "part long, before long, doc_id long, doc_tokens long, n long, rest binary, width int"))
    sums = sorted((r.part, r.n) for r in along.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a number for each partition
    begin, total = {}, 0
    for part, n in sums:
        begin[part], total = total, total + n
    whole = total // capacity * capacity
    begins = documents.sparkSession.sparkContext.broadcast(begin)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, before, doc_id, n_all, n, rest, width in zip(*(batch.column(i).to_pylist() for i in range(7))):
                ids = np.frombuffer(rest, f"<u{width}").astype("<u4").tobytes()
                done, at = 0, begins.value[part] + before
                while done < n:
                    sequence, offset, room = place(at + done, whole, total, capacity)
                    length = min(room, n - done)
                    out.append((doc_id, n_all - n + done, length, zlib.crc32(ids[4 * done : 4 * (done + length)]), n_all, sequence, offset))
                    done += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], schema=_PIECES)

    after = whole // capacity + bin(total - whole).count("1")
    wholes = docs.select("doc_id", "doc_tokens", "first_whole", F.posexplode("wholes").alias("k", "crc")).select(
        "doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        "doc_tokens", (F.lit(after).cast("long") + F.col("first_whole") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return wholes.unionByName(along.mapInArrow(cut, PIECES))
