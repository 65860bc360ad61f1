"""Operator 7, exact top-k by inner product with multi-resolution segment statistics.

With a vector cut into segments of length L, the inner product of a segment is
L * mean(q) * mean(x) plus that of the deviations from the means, which is at
most L * dev(q) * dev(x).  Summed over the segments this bounds the score from
above, that is the distance from below.  Each block of candidates is bounded
with few long segments, survivors with more and shorter ones, and only what
remains is scored exactly.

Queries and candidates are packed as 16-bit integers where these hold them and dealt into
blocks of a bounded number of bytes; each pair of blocks is a row of one equi-join, so a
vector is sent once for each block of queries, of which there are few.  A task compares parts
of two blocks at a time and keeps the best k of each query over the candidate blocks
that it meets, so it emits k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOUND = "query_id long, query_hash long, query_copies long, vec_id long, copies long, score long"
_OUT = pa.schema([(x.split()[0], pa.int64()) for x in _FOUND.split(", ")])
#: A bound is a sum of rounded products; integers below 2**53 keep it within this share.
_SLACK = 1e-9


@dataclass(frozen=True)
class Blocks:
    #: Most bytes of 16-bit integers in a block of candidates and of queries.
    candidate_bytes: int = 8 << 20
    query_bytes: int = 4 << 20
    #: Most rows of each that are compared at once; there are blocks of so few only for more tasks.
    candidates: int = 4096
    queries: int = 1024
    #: Segment lengths, coarse to fine.
    segments: tuple[int, ...] = (16, 4)


@dataclass
class Members:
    """Some vectors with their ids, hashes and numbers of equal rows."""

    ids: np.ndarray
    hashes: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray

    def parts(self, size: int) -> Iterator[Members]:
        for i in range(0, len(self.ids), size):
            yield Members(*(x[i : i + size] for x in (self.ids, self.hashes, self.copies, self.vectors)))


def _statistics(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, both times the root of the segment's length."""
    cuts = np.arange(0, x.shape[1], length)
    sizes = np.diff(np.append(cuts, x.shape[1])).astype(float)
    sums = np.add.reduceat(x, cuts, axis=1)
    squares = np.add.reduceat(x * x, cuts, axis=1)
    return sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums * sums / sizes, 0))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows; in doubles while those are exact, else in integers."""
    most = _most(q, x)
    if most >= 2.0**63:
        raise ValueError("components are too large: a score might not fit a long")
    if most < 2.0**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def _most(q: np.ndarray, x: np.ndarray) -> float:
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)


class Best:
    """The best k different candidates so far of each query of a block, ties to the smaller id."""

    def __init__(self, queries: Members, k: int, segments: tuple[int, ...]):
        self.queries, self.k = queries, k
        self.levels = [_statistics(queries.vectors.astype(float), n) for n in segments]
        self.rows = self.scores = np.zeros(0, np.int64)
        self.others = np.zeros((0, 2), np.int64)  # id, copies
        self.floor = np.full(len(queries.ids), -np.inf)

    def meet(self, x: Members, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take a part of the candidates, with its statistics, into account.  A query's own row is
        none of its candidates; other rows that are equal to it are."""
        q = self.queries
        own = np.argwhere(x.ids[None, :] == q.ids[:, None])
        own = own[[bool((q.vectors[i] == x.vectors[j]).all()) for i, j in own]] if len(own) else own
        copies = {(int(i), int(j)): int(x.copies[j]) - 1 for i, j in own}
        alive = np.ones((len(q.ids), len(x.ids)), bool)
        for at, n in copies.items():
            alive[at] = n > 0
        for (mean, deviation), (own_mean, own_deviation) in zip(self.levels, levels):
            bound = mean @ own_mean.T + deviation @ own_deviation.T
            bound += _SLACK * (np.abs(bound) + 1)
            if not np.isfinite(self.floor).all():
                self._seed(x.vectors, np.where(alive, bound, -np.inf))
            alive &= bound >= self.floor[:, None]
        left = np.flatnonzero(alive.any(axis=0))
        if not len(left):
            return
        scores = _exact(q.vectors, x.vectors[left])
        rows, cols = np.nonzero(alive[:, left] & (scores >= self.floor[:, None]))
        number = x.copies[left[cols]].copy()
        for i in np.flatnonzero(x.ids[left[cols]] == q.ids[rows]):
            number[i] = copies.get((int(rows[i]), int(left[cols[i]])), number[i])
        self._add(rows, np.stack([x.ids[left[cols]], number], axis=1), scores[rows, cols])

    def _seed(self, vectors: np.ndarray, bound: np.ndarray) -> None:
        """Lower limits of the k-th score, from the candidates with the highest bounds."""
        n = min(4 * self.k, bound.shape[1])
        if n < self.k or _most(self.queries.vectors, vectors) >= 2.0**53:
            return
        top = np.argpartition(-bound, n - 1, axis=1)[:, :n]
        scores = np.einsum("qd,qnd->qn", self.queries.vectors.astype(float), vectors[top].astype(float))
        scores[~np.isfinite(np.take_along_axis(bound, top, axis=1))] = -np.inf
        self.floor = np.maximum(self.floor, np.partition(scores, -self.k, axis=1)[:, -self.k])

    def _add(self, rows: np.ndarray, others: np.ndarray, values: np.ndarray) -> None:
        rows, others, values = np.concatenate((self.rows, rows)), np.concatenate((self.others, others)), np.concatenate((self.scores, values))
        order = np.lexsort((others[:, 0], -values, rows))
        rows, others, values = rows[order], others[order], values[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], values[last])
        self.rows, self.others, self.scores = rows[keep], others[keep], values[keep]

    def result(self) -> pa.RecordBatch:
        q = self.queries
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (q.ids[self.rows], q.hashes[self.rows], q.copies[self.rows], *self.others.T, self.scores)], schema=_OUT)


def _members(block: pa.ListScalar, dim: int) -> Members:
    """A block, which is a list of (id, hash, copies, packed vector), by id."""
    ids, hashes, copies = (block.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "hash", "copies"))
    packed = block.values.field("v").to_pylist()
    vectors = np.zeros((len(ids), dim), np.int64)
    narrow = np.array([len(v) == 2 * dim for v in packed], bool)
    for rows, kind in ((np.flatnonzero(narrow), "<i2"), (np.flatnonzero(~narrow), "<i8")):
        vectors[rows] = np.frombuffer(b"".join(packed[i] for i in rows), kind).reshape(len(rows), dim)
    order = np.argsort(ids, kind="stable")
    return Members(ids[order], hashes[order], copies[order], vectors[order])


def _packed(scale: float) -> Callable:
    """Rows (id, asks, vector) as (id, asks, dim, v) with v the bytes of floor(scale * x); without those that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            values = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            out = []
            for own in np.split(values, np.cumsum(sizes)[:-1]):
                if not np.isfinite(own).all():  # null is read as nan
                    out.append(None)
                    continue
                most = np.abs(own).max(initial=0)
                if most >= 2.0**62:
                    raise ValueError("components are too large: a score might not fit a long")
                out.append(own.astype("<i2" if most < 2**15 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(out, pa.binary())], names=["id", "asks", "dim", "v"])

    return run


def exact_top_k(
    vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, blocks: Blocks | None = None
) -> DataFrame:
    """The k highest inner products of each query row: query_id, rank, vec_id, score.

    Components become floor(scale * x) first.  Rows with a null id, a null vector or
    a null or non-finite component take no part.  Each row is a candidate of each query but
    itself: repeated rows are candidates each, of each other too, and a repeated query has its
    rows as often.  Only vectors of the query's length are its candidates.  Ties go to the
    smaller id; a query with fewer than k candidates gets all of them, one with none has no
    rows.  Components whose scores might not fit a long are an error.  An empty table
    gives an empty result; other columns are not read."""
    blocks = blocks or Blocks()
    present = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
    rows = (
        vectors.filter(present).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
        .mapInArrow(_packed(scale), "id long, asks boolean, dim int, v binary").filter("v IS NOT NULL")
        .groupBy("id", "dim", "v").agg(F.count(F.lit(1)).alias("copies"), F.max("asks").alias("asks")).withColumn("hash", F.xxhash64("v"))
    )
    sizes = vectors.filter(present).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.size(vector_col)).alias("dim")).first()
    width = 2 * max(sizes["dim"] or 1, 1)
    some = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-sizes["n"] // blocks.candidates))
    n_candidates = max(-(-sizes["n"] * width // blocks.candidate_bytes), some, 1)
    n_queries = max(-(-sizes["q"] * width // blocks.query_bytes), 1)
    member = F.collect_list(F.struct("id", "hash", "copies", "v"))
    candidates = (
        rows.groupBy("dim", F.pmod(F.xxhash64("id", "hash"), F.lit(n_candidates)).alias("xb"))
        .agg(member.alias("candidates"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    )
    queries = (
        rows.filter("asks")
        .groupBy("dim", F.pmod(F.xxhash64("id", "hash", F.lit("q")), F.lit(n_queries)).cast("int").alias("qb"))
        .agg(member.alias("queries"))
        .withColumn("xb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_candidates - 1).cast("long"))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, []
        for batch in batches:
            dims, own = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                key = (dims[i].as_py(), own[i].as_py())
                segments = tuple(n for n in blocks.segments if n < key[0])
                if key != at:
                    for b in best:
                        yield b.result()
                    at, best = key, [Best(q, k, segments) for q in _members(batch.column(2)[i], key[0]).parts(blocks.queries)]
                for x in _members(batch.column(3)[i], key[0]).parts(blocks.candidates):
                    levels = [_statistics(x.vectors.astype(float), n) for n in segments]
                    for b in best:
                        b.meet(x, levels)
        for b in best:
            yield b.result()

    found = (
        queries.join(candidates, ["dim", "qb", "xb"])
        .sortWithinPartitions("dim", "qb", "xb")
        .select("dim", "qb", "queries", "candidates")
        .mapInArrow(run, _FOUND)
    )
    rows_of = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    place = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    ranked = rows_of.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "query_copies"))).select("query_id", "rank", "vec_id", "score")
