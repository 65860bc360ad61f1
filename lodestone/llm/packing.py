"""Operator 3, conflict-constrained best-fit packing.

Bins are kept in order of what is left in them.  Each carries a bitmap of the
sources and a bitmap of the duplicate clusters that it has.  A piece goes to the
tightest bin that has room and neither its source nor its cluster: the search
starts at the first bin with room and goes on to its successors until one is
compatible.

Spark deals the pieces into shards by hash and sorts them; a task packs its
shards in windows of a bounded number of pieces, each with bins of its own, so
no task holds an unbounded group.  Only ids, sizes and hashes are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("piece_start", pa.int64()), ("piece_size", pa.int64()), ("bin_id", pa.string()), ("bin_offset", pa.int64())]
)
SCHEMA = "doc_id long, piece int, piece_start long, piece_size long, bin_id string, bin_offset long"


def words(text: str = "text") -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def copy_cluster(text: str = "text") -> Column:
    """One value for texts that are equal but for case and white space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))))


class Packer:
    """Bins of one window."""

    def __init__(self, capacity: int, group: int = 128):
        self.capacity, self.group = capacity, group
        self.have: list[int] = []  # by bin: the bits of its sources and clusters
        self.groups: list[list[tuple[int, int]]] = []  # (left, bin), ordered within and across groups
        self.lasts: list[tuple[int, int]] = []  # of each group
        self.common: list[int | None] = []  # of each group: the bits that all its bins have; None if not known
        self.left: list[int] = []
        self.bits: dict[tuple[str, int], int] = {}  # of what occurred twice
        self.once: dict[tuple[str, int], int] = {}  # the only bin of what occurred once

    def _bit(self, key: tuple[str, int]) -> int:
        """The bit of a source or cluster, exact; 0 if it is new."""
        bit = self.bits.get(key, 0)
        if not bit and key in self.once:
            bit = self.bits[key] = 1 << len(self.bits)
            b = self.once.pop(key)
            self.have[b] |= bit
            self.common[bisect_left(self.lasts, (self.left[b], b))] = None
        return bit

    def _in_all(self, g: int) -> int:
        if self.common[g] is None:
            self.common[g] = reduce(and_, (self.have[b] for _, b in self.groups[g]))
        return self.common[g]

    def _tightest(self, size: int, want: int) -> tuple[int, int] | None:
        """Group and place of the first bin with room and none of the wanted bits."""
        for g in range(bisect_left(self.lasts, (size, -1)), len(self.groups)):
            if want and self._in_all(g) & want:
                continue
            group = self.groups[g]
            for i in range(bisect_left(group, (size, -1)), len(group)):
                if not self.have[group[i][1]] & want:
                    return g, i
        return None

    def _take(self, g: int, i: int) -> int:
        group = self.groups[g]
        _, b = group.pop(i)
        if group:
            self.lasts[g], self.common[g] = group[-1], None
        else:
            del self.groups[g], self.lasts[g], self.common[g]
        return b

    def _put(self, entry: tuple[int, int]) -> None:
        if not self.groups:
            self.groups, self.lasts, self.common = [[entry]], [entry], [None]
            return
        g = min(bisect_left(self.lasts, entry), len(self.groups) - 1)
        group = self.groups[g]
        insort(group, entry)
        self.lasts[g], self.common[g] = group[-1], None
        if len(group) > self.group:
            half = len(group) // 2
            self.groups[g : g + 1], self.lasts[g : g + 1], self.common[g : g + 1] = [group[:half], group[half:]], [group[half - 1], group[-1]], [None, None]

    def place(self, size: int, source: int, cluster: int | None) -> tuple[int, int]:
        """The bin for a piece and its offset there.  A cluster of None conflicts with nothing."""
        keys = [("s", source)] if cluster is None else [("s", source), ("c", cluster)]
        want = 0
        for key in keys:
            want |= self._bit(key)
        at = self._tightest(size, want)
        if at is None:
            b = len(self.have)
            self.have.append(0)
            self.left.append(self.capacity)
        else:
            b = self._take(*at)
        self.have[b] |= want
        self.once |= {key: b for key in keys if key not in self.bits}
        offset = self.capacity - self.left[b]
        self.left[b] -= size
        self._put((self.left[b], b))
        return b, offset


def best_fit_pack(
    documents: DataFrame, capacity: int, size: Column | None = None, cluster: Column | None = None, shard_rows: int = 8192, window_rows: int = 16384
) -> DataFrame:
    """Pack every row of ``documents`` (doc_id, text, source) into bins of ``capacity``.

    One row per piece: a document larger than a bin is cut into full pieces and a
    rest (piece 0, 1, ... with ``piece_start`` in units of ``size``); others are one
    piece.  Full pieces have a bin of their own.  No bin holds two pieces of one
    source or of one cluster; a null source is a source, a null cluster conflicts
    with nothing.  ``size`` is the number of words and ``cluster`` the copies of a
    text unless given; a null or negative size counts as 0.  Texts of size 0 are
    packed as well.  Repeated rows are packed each; null ids stay null; an empty
    table gives no bins.  Only the named columns are read."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("source"), F.lit("\0null"))).alias("source"),
        F.greatest(F.coalesce((size if size is not None else words()).cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        (cluster if cluster is not None else copy_cluster()).cast("long").alias("cluster"),
        F.xxhash64("doc_id", "text").alias("own"),
    )
    shards = max(1, -(-documents.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packer, done, window = None, None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for shard, doc_id, source, whole, cluster_id in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if shard != at or done >= window_rows:
                    window = window + 1 if shard == at else 0
                    at, packer, done = shard, Packer(capacity), 0
                done += 1
                full = whole // capacity
                for piece in range(full):
                    out.append((doc_id, piece, piece * capacity, capacity, f"{shard}-{window}-f{done}-{piece}", 0))
                rest = whole - full * capacity
                if rest or not full:
                    b, offset = packer.place(rest, source, cluster_id)
                    out.append((doc_id, full, full * capacity, rest, f"{shard}-{window}-{b}", offset))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    return (
        rows.withColumn("shard", F.pmod(F.col("own"), F.lit(shards)))
        .repartition("shard")
        .sortWithinPartitions("shard", F.desc(F.pmod(F.col("size"), F.lit(capacity))), "own", "doc_id")
        .select("shard", "doc_id", "source", "size", "cluster")
        .mapInArrow(run, SCHEMA)
    )
