"""Operator 2, n-gram Jaccard join by chosen paths.

Each text is a set of hashed word shingles with a minhash value at each of
COORDINATES.  A run samples one coordinate; texts with the same value there
share a bucket (they share a sampled token of their sets).  A bucket that is too
large is split again on two coordinates that its path chooses, until buckets are
small or most of a bucket stays together, which means that its members are alike.
Runs are repeated until a pair at the threshold is missed with a probability of
at most 1 - recall.

Buckets are then compared by brute force, the large ones in blocks: first on the
minhash values, then what is left exactly on the shingle sets.  A pair is counted
in the first bucket that its texts share, so no pair is ever written down: a bucket
gives each member its number of links and the least member of its component.
Equal texts are one node throughout, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.tables import Scratch, row_of, spread_join
from lodestone.llm.textblocks import Block, blocks, mix, rolling, span_hashes, window_mask

COORDINATES = 32
WORD = r"[^\x20\x09-\x0D]"
_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


@dataclass(frozen=True)
class JoinPlan:
    threshold: float = 0.8
    words: int = 5
    recall: float = 1 - 1e-8
    #: A bucket of at most so many texts is not split, nor one beyond so many splits.
    small: int = 128
    depth: int = 4
    #: A bucket of which a split leaves this share together is not split.
    alike: float = 0.6
    #: A pair whose minhash values agree in fewer coordinates is below the threshold (but for 1 in 10**8 pairs).
    agree: int = 11
    #: Most texts and shingles of one side of a comparison, on average.
    block_rows: int = 1024
    block_shingles: int = 1 << 20
    #: At most so many 8-byte keys are broadcast; more are joined by a shuffle.
    broadcast_keys: int = 500_000
    #: Keys with more rows are not joined in one task.
    hot: int = 1024

    @property
    def runs(self) -> int:
        each = self.threshold * (1 - (1 - self.threshold) ** 2) ** self.depth
        return min(COORDINATES, math.ceil(math.log(1 - self.recall) / math.log(1 - each)))


def shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each document of a block, not sorted, and their number.

    A text with fewer than n words has one shingle, of all its words; one without
    words has none."""
    starts, ends, counts = block.words()
    words = span_hashes(block.data, starts, ends)
    valid = window_mask(counts, n)
    hashes = rolling(words, n)[valid] if len(valid) else np.zeros(0, np.uint64)
    number = np.maximum(counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        own = [np.uint64(mix(rolling(words[first[d] : first[d] + counts[d]], int(counts[d])) + np.uint64(counts[d]))[0]) for d in short]
        hashes = np.insert(hashes, np.cumsum(number)[short], own)
        number[short] = 1
    return hashes, number


def signatures(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Minhash values, documents x COORDINATES, as 32-bit integers; documents without shingles have 0."""
    out = np.zeros((len(number), COORDINATES), np.int32)
    some = np.flatnonzero(number)
    if len(some):
        first = (np.cumsum(number) - number)[some]
        for c in range(COORDINATES):
            out[some, c] = mix(np.minimum.reduceat(hashes * _MULTIPLIERS[c], first)).astype(np.uint32).view(np.int32)
    return out


def _units(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each unit (equal in the first n_keys columns, by which rows are sorted)."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a])
            if key != last and kept:
                yield pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _share_earlier(leaf: int, values: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: the two texts share a leaf that comes before this one."""
    row = np.repeat(np.arange(len(counts)), counts)
    early = values < leaf
    row, values = row[early], values[early]
    own, column, times = np.unique(values, return_inverse=True, return_counts=True)
    if not len(own) or times.max() < 2:
        return np.zeros((len(left), len(right)), bool)
    m = np.zeros((len(counts), len(own)), np.float32)
    m[row, column] = 1
    m = m[:, times > 1]
    return m[left] @ m[right].T > 0


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of the two blocks that a unit compares; the same ones twice on the diagonal."""
    block, i, j = _longs(table, "block"), _longs(table, "bi")[0], _longs(table, "bj")[0]
    return np.flatnonzero(block == i), np.flatnonzero(block == j), i == j


def _worth(plan: JoinPlan) -> Callable:
    """Keeps the rows of a unit that have a partner whose minhash values agree enough, in no earlier leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches, 3):
            left, right, same = _sides(table)
            if not len(left) or not len(right) or same and len(left) < 2:
                continue
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.int32).reshape(-1, COORDINATES)
            agree = np.zeros((len(left), len(right)), np.int8)
            for c in range(COORDINATES):
                agree += sig[left, c][:, None] == sig[right, c][None, :]
            good = agree >= plan.agree
            if same:
                np.fill_diagonal(good, False)
            if good.any():
                good &= ~_share_earlier(_longs(table, "leaf")[0], *_lists(table, "leaves"), left, right)
            keep = np.union1d(left[good.any(axis=1)], right[good.any(axis=0)])
            if len(keep):
                nodes = _longs(table, "node")[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), _longs(table, "leaf")[0])), pa.array(nodes)], names=["leaf", "node"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """left x right: the number of common shingles, by products of 0/1 matrices over some shingles at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    row, values = row[order], values[order]
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    twice = np.bincount(column, minlength=1)[column] > 1 if len(column) else new
    row = row[twice]
    column = np.cumsum(np.append(0, np.diff(column[twice]) > 0)) if len(row) else column[:0]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        m = np.zeros((len(sets), min(width, total - a)), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        out += m[left] @ m[right].T
    return out


def _least_members(linked: np.ndarray, left: np.ndarray, right: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node of each row's component."""
    label = nodes.copy()
    most = np.iinfo(np.int64).max
    while True:
        before = label.copy()
        np.minimum.at(label, left, np.where(linked, label[right][None, :], most).min(axis=1))
        np.minimum.at(label, right, np.where(linked, label[left][:, None], most).min(axis=0))
        if (label == before).all():
            return label


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])


def _verified(plan: JoinPlan) -> Callable:
    """For each row of a unit with links: how many documents it links to here, and its component's least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches, 3):
            left, right, same = _sides(table)
            if not len(left) or not len(right) or same and len(left) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets], float)
            both = sizes[left][:, None] + sizes[right][None, :]
            linked = (1 + plan.threshold) * _overlaps(sets, left, right).astype(float) >= plan.threshold * both - 1e-6
            if same:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            nodes, copies = _longs(table, "node"), _longs(table, "copies")
            fresh = linked & ~_share_earlier(_longs(table, "leaf")[0], *_lists(table, "leaves"), left, right)
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, left, fresh @ copies[right])
            if not same:
                np.add.at(links, right, copies[left] @ fresh)
            label = _least_members(linked, left, right, nodes)
            some = np.flatnonzero((links > 0) | (label != nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(label[some])], schema=_FOUND)

    return run


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _check(text: Column) -> Column:
    """A second hash: from another seed."""
    return F.xxhash64(F.lit("check"), text)


def _in_units(rows: DataFrame, sizes: DataFrame, plan: JoinPlan) -> DataFrame:
    """Each row (leaf, node, ...) once for each pair of blocks of its leaf that has the row's block.

    ``sizes`` has the number of rows and of blocks of each leaf; a text's block is by its hash."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("bi"), F.greatest(b, F.col("block")).alias("bj"))
    )
    return (
        spread_join(rows, sizes, "leaf", "node", hot=plan.hot, broadcast_keys=plan.broadcast_keys)
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("n_blocks")).cast("int"))
        .withColumn("pair", F.explode(pairs))
        .withColumn("bi", F.col("pair.bi")).withColumn("bj", F.col("pair.bj")).drop("pair", "n_blocks", "n")
    )


class _Join:
    """The steps of one join over one table."""

    def __init__(self, documents: DataFrame, plan: JoinPlan):
        self.plan, self.spark = plan, documents.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")
        self.cut = self.scratch.cut
        self.clashes: DataFrame | None = None
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (text, ...) with ``node``, which stands for the text: its hash, or a hash of its second
        hash if different texts have the first.  Texts without words have none."""
        rows = rows.withColumn("node", F.when(F.col("text").rlike(WORD), text_hash(F.col("text"))))
        if self.clashes is None:
            return rows
        side = F.broadcast(self.clashes) if self.clashes.count() <= self.plan.broadcast_keys else self.clashes
        again = F.when(F.col("clash").isNotNull(), F.xxhash64("node", _check(F.col("text")))).otherwise(F.col("node"))
        none = rows.filter(F.col("node").isNull())  # many rows may have none; they must not meet in a task
        return rows.filter(F.col("node").isNotNull()).join(side, F.col("node") == F.col("clash"), "left").withColumn("node", again).drop("clash").unionByName(none)

    def nodes(self) -> DataFrame:
        """node, rep (least id), copies, n_shingles, sig: one row for each different text with words."""
        found = self.cut(self._nodes())
        clashes = found.filter("check_min <> check_max").select(F.col("node").alias("clash"))
        if not clashes.isEmpty():
            self.clashes = Scratch(self.spark, "clashes").cut(clashes)
            found = self.cut(self._nodes())
        return found.drop("check_min", "check_max")

    def _nodes(self) -> DataFrame:
        n = self.plan.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(3)):
                    hashes, number = shingles(block, n)
                    sig = signatures(hashes, number)
                    own = slice(block.first, block.first + block.n)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i)[own] for i in range(3)), pa.array(number.astype(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())],
                        names=["doc_id", "node", "check", "n_shingles", "sig"],
                    )

        rows = self.keyed(self.documents).select("doc_id", "node", _check(F.col("text")).alias("check"), "text")
        signed = rows.mapInArrow(run, "doc_id long, node long, check long, n_shingles long, sig binary")
        return (
            signed.filter("n_shingles > 0").groupBy("node")
            .agg(
                F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
                F.min("check").alias("check_min"), F.max("check").alias("check_max"),
            )
        )

    def spread(self, rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
        return spread_join(rows, facts, key, "doc_id" if key == "node" else "node", how, self.plan.hot, self.plan.broadcast_keys)

    def leaves(self, nodes: DataFrame) -> DataFrame:
        """(leaf, node): the buckets of two texts or more that are compared; of buckets with the same members one."""
        plan = self.plan
        value = lambda c: F.substring(F.col("sig"), c * 4 + 1, 4)
        roots = [F.struct(F.xxhash64(F.lit(r), value(F.lit(r))).alias("path")) for r in range(plan.runs)]
        level = nodes.select("node", F.explode(F.array(*roots)).alias("p")).select(F.col("p.path").alias("path"), "node")
        level = self.cut(self._shared(level))
        done = [level.filter(F.col("n") <= plan.small).select("path", "node")]
        alike = []
        large = level.filter(F.col("n") > plan.small)
        for _ in range(plan.depth):
            if large.isEmpty():
                break
            chosen = [F.pmod(F.xxhash64("path", F.lit(i)), F.lit(COORDINATES)).cast("int") for i in range(2)]
            child = [F.xxhash64("path", F.lit("child"), c, value(c)) for c in chosen]
            signed = large.join(nodes.select("node", "sig"), "node")
            split = (
                signed.select("path", "n", child[0].alias("child")).groupBy("path", "n", "child").agg(F.count(F.lit(1)).alias("m"))
                .groupBy("path").agg((F.max("m") / F.first("n")).alias("together"), F.first("n").alias("n"))
            )
            told = self.cut(self.spread(signed.drop("n"), self.cut(split), "path"))
            children = told.filter(F.col("together") < plan.alike).select("node", F.explode(F.array(*child)).alias("path"))
            alike.append(told.filter(F.col("together") >= plan.alike).select("path", "node"))
            level = self.cut(self._shared(self.cut(children.distinct())))
            done.append(level.filter(F.col("n") <= plan.small).select("path", "node"))
            large = level.filter(F.col("n") > plan.small)
        else:
            done.append(large.select("path", "node"))
        if alike:
            done.append(self._families(reduce(DataFrame.unionByName, alike)))
        rows = reduce(DataFrame.unionByName, done)
        rows = self.cut(rows.select(F.col("path").alias("leaf"), "node").distinct())
        members = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("a"), F.expr("bit_xor(xxhash64(node, 1))").alias("b"))
        first = self.cut(members.groupBy("n", "a", "b").agg(F.min("leaf").alias("leaf")).select("leaf", "n"))
        return self.cut(self.spread(rows, first, "leaf").select("leaf", "node"))

    def _families(self, rows: DataFrame) -> DataFrame:
        """Large buckets of alike texts that share members, as one: the runs find the same texts
        again, so they are compared once.  Buckets that two rounds don't join stay apart."""
        for _ in range(2):
            own = rows.groupBy("node").agg(F.min("path").alias("least"))
            to = self.cut(rows.join(own, "node").groupBy("path").agg(F.min("least").alias("to"), F.count(F.lit(1)).alias("n")))
            rows = self.cut(self.spread(rows, to, "path").select(F.col("to").alias("path"), "node").distinct())
        return rows

    def _shared(self, rows: DataFrame) -> DataFrame:
        """The rows of paths that two texts or more have, with their number n."""
        return self.spread(rows, self.cut(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), "path")

    def compared(self, nodes: DataFrame, leaves: DataFrame) -> DataFrame:
        """(node, links, label) of the comparisons."""
        plan = self.plan
        lists = leaves.groupBy("node").agg(F.collect_list("leaf").alias("leaves"))  # bounded by runs and depth
        known = nodes.join(lists, "node").select("node", "rep", "copies", "n_shingles", "sig", "leaves")
        members = leaves.join(known, "node")
        count = F.count(F.lit(1))
        sizes = self.cut(leaves.groupBy("leaf").agg(F.ceil(count / plan.block_rows).cast("int").alias("n_blocks"), count.alias("n")))
        keys = ["leaf", "bi", "bj"]
        first = _in_units(members.select("leaf", "node", "sig", "leaves"), sizes, plan)
        worth = self.cut(
            first.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "block", "node", "sig", "leaves")
            .mapInArrow(_worth(plan), "leaf long, node long").distinct()
        )
        left = worth.join(known.select("node", "copies", "n_shingles", "leaves"), "node")
        blocks_of = F.greatest(F.ceil(count / plan.block_rows), F.ceil(F.sum("n_shingles") / plan.block_shingles)).cast("int")
        sizes = self.cut(left.groupBy("leaf").agg(blocks_of.alias("n_blocks"), count.alias("n")))
        sets = self._shingles(known.join(worth.select("node").distinct(), "node", "left_semi").select("node", "rep"))
        second = _in_units(left.select("leaf", "node", "copies", "leaves"), sizes, plan).join(sets, "node")
        return (
            second.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "block", "node", "copies", "leaves", "shingles")
            .mapInArrow(_verified(plan), "node long, links long, label long")
        )

    def _shingles(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles): the sorted shingle sets of the wanted nodes, from one of their texts."""
        n = self.plan.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(1)):
                    hashes, number = shingles(block, n)
                    ends = np.cumsum(number)
                    sets = [np.unique(hashes[e - k : e]).tobytes() for e, k in zip(ends, number)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[block.first : block.first + block.n], pa.array(sets, pa.binary())], names=["node", "shingles"])

        wanted = self.cut(wanted.select("node", F.col("rep").alias("doc_id")))
        side = F.broadcast(wanted) if wanted.count() <= self.plan.broadcast_keys else wanted
        rows = self.keyed(self.documents).alias("r").join(side.alias("w"), (F.col("r.node") == F.col("w.node")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")))
        return rows.select("r.node", "r.text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])

    def classes(self) -> DataFrame:
        """node, copies, links, rep_id, rep_node: each different text with words, and its component's representative."""
        nodes = self.nodes()
        found = self.cut(self.compared(nodes, self.leaves(nodes)))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = connected_components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), self.scratch)
        own = self.cut(
            nodes.select("node", "rep", "copies").join(links, "node", "left").join(roots, "node", "left")
            .select("node", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
        )
        last = F.coalesce(F.col("rep"), F.lit(2**63 - 1))
        least = F.min(F.struct(last.alias("order"), F.col("rep").alias("rep_id"), F.col("node").alias("rep_node"))).alias("r")
        reps = self.cut(own.groupBy("root").agg(least, F.count(F.lit(1)).alias("n")))
        out = self.cut(self.spread(own, reps, "root").select("node", "copies", "links", "r.rep_id", "r.rep_node"))
        self.scratch.clear(keep=1)
        return out


def jaccard_join(documents: DataFrame, plan: JoinPlan | None = None) -> DataFrame:
    """doc_id, class_id and n_links for every row of ``documents`` (doc_id, text).

    ``n_links`` is the number of other rows whose word shingles have a Jaccard
    similarity of ``threshold`` or more, copies included.  ``class_id`` is the least id
    of the rows that are connected by links (a null id counts last).  A text of one to four
    words is one shingle.  Null texts and texts without words have no links; their class
    is their own id.  Repeated rows are copies of each other.  An empty table gives an empty
    result; other columns are not read."""
    join = _Join(documents, plan or JoinPlan())
    classes = join.classes().withColumn("n", F.col("copies"))
    rows = join.keyed(join.documents).select("doc_id", "node")
    none = rows.filter(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    some = join.spread(rows.filter(F.col("node").isNotNull()), classes, "node", "left")
    return some.select("doc_id", F.col("rep_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links")).unionByName(none)


def with_class(documents: DataFrame, plan: JoinPlan | None = None, **keep: Column) -> DataFrame:
    """The columns ``keep`` (name -> expression, ``doc_id`` among them) of every row of ``documents`` (doc_id, text), and
    ``class_node``: one value for the rows of a class, null for texts without words.  Texts do not move with it."""
    join = _Join(documents, plan or JoinPlan())
    classes = join.classes().select("node", F.col("copies").alias("n"), F.col("rep_node").alias("class_node"))
    rows = join.keyed(documents.select(*(c.alias(name) for name, c in keep.items()), F.coalesce(F.col("text"), F.lit("")).alias("text"))).drop("text")
    none = rows.filter(F.col("node").isNull()).select(*keep, F.lit(None).cast("long").alias("class_node"))
    return join.spread(rows.filter(F.col("node").isNotNull()), classes, "node", "left").select(*keep, "class_node").unionByName(none)


def one_of_each_class(documents: DataFrame, plan: JoinPlan | None = None) -> DataFrame:
    """The rows of ``documents``, all columns, but of each class only one row: the one with
    the least id.  Texts without words are kept all."""
    join = _Join(documents, plan or JoinPlan())
    kept = join.classes().select(F.col("rep_id").alias("k"), F.col("rep_node").alias("n")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(row_of(documents.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("text"), text.rlike(WORD).alias("words"))
    none = rows.filter(~F.col("words")).select("row.*")
    # Keys are alike only for rows that are alike, so one of them is taken.
    some = join.keyed(rows.filter("words")).drop("text").join(kept, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("k")))
    return some.dropDuplicates(["id", "node"]).select("row.*").unionByName(none)
