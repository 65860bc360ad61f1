"""The nearest chunks of many questions: blocks of both meet in Arrow batches, products are numpy's, and what is near is computed again, exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a block.  Both sides of a pair of blocks are in a task's memory.
CHUNKS, QUESTIONS = 32_768, 16_384
#: Scores that are held at once.
_SCORES, _SURVIVORS = 4_000_000, 65_536


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Each value's place in the order of the different ones, null first, and how many there are."""
    own = column.combine_chunks().dictionary_encode(null_encoding="encode")
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    order = pc.sort_indices(own.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[own.indices.to_numpy()], len(order)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _places(values: list) -> dict[str, np.ndarray]:
    out: dict[str, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            out.setdefault(v, []).append(i)
    return {v: np.array(own) for v, own in out.items()}


def _first(n: int, *keys: np.ndarray) -> np.ndarray:
    """Which of sorted rows are among the first n of their group."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(at, np.diff(np.append(at, len(new)))) < n


def _block(c: pa.Table, q: pa.Table, per_doc: int, docs_of_a_kind: int | None, by_kind: bool) -> tuple[np.ndarray, ...]:
    """(question, chunk, dist, cut) of the best chunks of units that are among the first ``per_doc`` of their document here.
    With ``docs_of_a_kind``, units behind so many documents of their kind may be left out; they are all beyond ``cut``."""
    vectors, asked = _matrix(c["embedding"]), _matrix(q["q_vector"])
    n = len(vectors)
    (unit, n_units), (doc, n_docs), (chunk, _), (kind, n_kinds) = (_codes(c[x]) for x in ("unit", "doc_id", "chunk_id", "kind"))
    held_kind, n_held = (kind, n_kinds) if by_kind else (np.zeros(n, np.int64), 1)
    by_unit = np.argsort(unit, kind="stable")
    count = np.bincount(unit, minlength=n_units)
    begin = np.cumsum(count) - count
    # Units of one document stand for it whichever chunk is their best; a document's units are dealt to per_doc parts, whose least maximum
    # is a bound for its per_doc-th unit.
    own = doc[by_unit]
    sure = (np.minimum.reduceat(own, begin) == np.maximum.reduceat(own, begin))[unit]
    part = np.where(sure, doc * per_doc + unit % per_doc, n_docs * per_doc)
    order = np.argsort(part, kind="stable")
    column = np.empty(n, np.int64)
    column[order] = np.arange(n)
    vt, doc_at, kind_at, part_at = np.ascontiguousarray(vectors[order].T), doc[order], held_kind[order], part[order]
    n_sure = int(sure.sum())
    at = np.flatnonzero(np.append(True, part_at[1:n_sure] != part_at[: n_sure - 1])) if n_sure else np.zeros(0, np.int64)
    # Documents all of whose chunks are of one kind.
    low, high = np.full(n_docs, n_held), np.full(n_docs, -1)
    np.minimum.at(low, doc, held_kind)
    np.maximum.at(high, doc, held_kind)
    docs_of = [np.flatnonzero((low == k) & (high == k)) for k in range(n_held)]
    lists = [q[x].to_pylist() for x in ("q_excluded", "q_chunks", "q_languages")]
    listed = [_places(c[x].cast(pa.string()).to_pylist()) if any(v is not None for v in own) else {} for x, own in zip(("doc_id", "chunk_id", "language"), lists)]
    most = np.sqrt((vectors**2).sum(axis=1).max())
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, _SCORES // n if docs_of_a_kind else min(_SCORES, 8 * _SURVIVORS) // n)
    for begun in range(0, len(asked), step):
        a = asked[begun : begun + step]
        scores = a @ vt
        for names, places, keep in zip(lists, listed, (False, False, True)):
            if not places and not keep:
                continue
            for i, own in enumerate(names[begun : begun + step]):
                if own is None:
                    continue
                found = [places[x] for x in own if x in places]
                hit = column[np.concatenate(found)] if found else np.zeros(0, np.int64)
                if keep:
                    free = np.ones(n, bool)
                    free[hit] = False
                    hit = free
                scores[i, hit] = -np.inf
        slack = (vectors.shape[1] * 4e-16 * np.sqrt((a**2).sum(axis=1)) * most + 1e-15)[:, None]
        parts = np.full((len(a), n_docs * per_doc), -np.inf)
        if n_sure:
            parts[:, part_at[at]] = np.maximum.reduceat(scores[:, :n_sure], at, axis=1)
        parts = parts.reshape(len(a), n_docs, per_doc)
        bound = parts.min(axis=2) - slack
        cut = np.full(len(a), np.inf)
        near = (scores >= bound[:, doc_at]) & (scores > -np.inf)
        if docs_of_a_kind:
            best = parts.max(axis=2)
            least = np.full((len(a), n_held), -np.inf)
            for k, of in enumerate(docs_of):
                if len(of) >= docs_of_a_kind:
                    least[:, k] = np.partition(best[:, of], len(of) - docs_of_a_kind, axis=1)[:, len(of) - docs_of_a_kind]
            # What is left out is beyond the cut, and what holds it out within, also where products were rounded otherwise.
            cut = 1.0 - least.max(axis=1) + 2 * slack[:, 0]
            near &= scores >= (least - 4 * slack)[:, kind_at]
        qi, ci = np.nonzero(near)
        pairs = np.unique(qi * n_units + unit[order[ci]])
        u = pairs % n_units
        many = count[u]
        start = np.cumsum(many) - many
        ci = by_unit[np.arange(many.sum()) - np.repeat(start, many) + np.repeat(begin[u], many)]
        qi = np.repeat(pairs // n_units, many)
        free = scores[qi, column[ci]] > -np.inf
        qi, ci = qi[free], ci[free]
        dist = np.empty(len(qi))
        for s in range(0, len(qi), _SURVIVORS):
            products = vectors[ci[s : s + _SURVIVORS]] * a[qi[s : s + _SURVIVORS]]
            total = np.zeros(len(products))
            for j in range(products.shape[1]):  # in the order of the vector, as the expression does
                total += products[:, j]
            dist[s : s + _SURVIVORS] = 1.0 - total
        by = np.lexsort((kind[ci], doc[ci], chunk[ci], dist, unit[ci], qi))
        by = by[_first(1, qi[by], unit[ci[by]])]
        by = by[np.lexsort((unit[ci[by]], dist[by], doc[ci[by]], qi[by]))]
        by = by[_first(per_doc, qi[by], doc[ci[by]])]
        out.append((qi[by] + begun, ci[by], dist[by], cut[qi[by]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def near_units(chunks: DataFrame, questions: DataFrame, per_doc: int, docs_of_a_kind: int | None, by_kind: bool, sizes: tuple[int, int] = (CHUNKS, QUESTIONS)) -> DataFrame:
    """(qid, chunk_id, unit, doc_id, kind, dist, cut) of the best chunks of units, a superset of the first ``per_doc`` units of
    each document for each question; all units with a distance below ``cut``, if it is not infinite, are considered.

    ``chunks``: chunk_id, unit, doc_id, kind, language, embedding; ``questions``: qid, q_vector, q_excluded, q_chunks,
    q_languages.  A unit's chunks are in one block.  Each block of chunks meets each block of questions once, in one task; a
    task's output is bounded by its questions.  Vectors that are null, empty or have null or non-finite components take no part,
    and vectors of other lengths than the question's."""
    spark = chunks.sparkSession

    def whole(c: str) -> Column:
        return F.size(c) > 0, F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))

    good = lambda rows, c: rows.filter(F.col(c).isNotNull()).filter(whole(c)[0]).filter(whole(c)[1])
    own, asked = good(chunks, "embedding"), good(questions, "q_vector")
    n, m = own.count(), asked.count()
    tasks = spark.sparkContext.defaultParallelism
    # As many blocks as there are tasks, if they are not very small.
    cb, qb = max(-(-n // sizes[0]), min(2 * tasks, -(-n // 2048)), 1), max(-(-m // sizes[1]), 1)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = own.select(block("unit", cb).alias("cb"), each(qb).alias("qb"), F.size("embedding").alias("dim"), "chunk_id", "unit", "doc_id", "kind", "language", "embedding")
    right = asked.select(block("qid", qb).alias("qb"), each(cb).alias("cb"), F.size("q_vector").alias("dim"), *asked.columns)
    kinds = {f.name: f.dataType for f in [*chunks.schema, *questions.schema]}
    names = ("qid", "chunk_id", "unit", "doc_id", "kind")
    schema = StructType([StructField(x, kinds[x]) for x in names] + [StructField("dist", DoubleType()), StructField("cut", DoubleType())])

    def near(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            qi, ci, dist, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        else:
            qi, ci, dist, cut = _block(c, q, per_doc, docs_of_a_kind, by_kind)
        found = c.select(list(names[1:])).take(pa.array(ci))
        return pa.table([q["qid"].take(pa.array(qi)), *found.columns, pa.array(dist), pa.array(cut)], names=[*names, "dist", "cut"])

    # The number is said, as joining small partitions goes by bytes, not by the time of their products.
    parts = max(cb * qb, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ("cb", "qb", "dim")
    return left.repartition(parts, *key).groupBy(*key).cogroup(right.repartition(parts, *key).groupBy(*key)).applyInArrow(near, schema)
