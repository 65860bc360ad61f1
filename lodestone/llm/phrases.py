"""Operator 12, phrase collocations by a minimal perfect hash over Apriori-safe candidates.

A phrase of m words is known by the hashes of its first and its last m - 1 words; its own
hash is made of these two.  Candidates of m words are looked for among the places whose
beginning and end may be candidates of m - 1 words: a bitmap of fixed size says so, and
may say yes too often but never no.  What such places hold is counted once a task and
summed; what reaches the least count is a candidate.

The candidates of all lengths are then counted exactly.  They go in blocks of bounded
size; a block's minimal perfect hash and the key of each slot are sent to the mappers, which
verify keys, add up numpy arrays by slot with ``bincount`` and pass pieces of the arrays on, to be summed as
a tree.  A seed is only good if no two words, of which one is frequent, share a hash, and no two
candidates; that is checked, and another one taken otherwise.  What is not checked is that a rare phrase
of two or three words has the hash of a candidate, which happens once in 2**64 pairs of such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import Scratch, text_or_empty
from lodestone.llm.textblocks import BASE, Block, blocks, mix, span_hashes

LONGEST = 4
PIECE = 1024
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_APART = _ENDS.copy()
_APART[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def pair_hash(first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """The hash of what begins and ends with these; it depends on the order."""
    return mix(mix(first * BASE + _U(seed)) + last)


def _place(keys: np.ndarray, array: int, size: int) -> np.ndarray:
    return (mix(keys + mix(np.array([array + 1], np.uint64))) % _U(size)).astype(np.int64)


class Hash:
    """A minimal perfect hash of distinct 64-bit keys: those that are alone in their place of a
    bit array have it, the rest go to the next array; a key's slot is the number of set bits before its own."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.sizes, starts, bits, left, at = [], [0], [], keys, 0
        while len(left):
            size = max(64, int(room * len(left)))
            place = _place(left, at, size)
            alone = np.bincount(place, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            starts.append(starts[-1] + size)
            left, at = left[~alone[place]], at + 1
            if at > 200:
                raise ValueError("keys are not distinct")
        self.starts = starts
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.set, self.before = flat, np.concatenate(([0], np.cumsum(flat)))[:-1].astype(np.int64) if len(flat) else np.zeros(0, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; keys that are not in the set get any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for at, size in enumerate(self.sizes):
            place = _place(keys[left], at, size) + self.starts[at]
            hit = self.set[place]
            out[left[hit]] = self.before[place[hit]]
            left = left[~hit]
        return out


class Words:
    """The words of a slice of documents: hash by language and whether the next word follows in the same piece."""

    def __init__(self, block: Block, langs: np.ndarray, seed: int):
        data = _LOWER[block.data]
        inside = ~_APART[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[block.offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.data, self.starts, self.ends = data, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(block.offsets, self.starts, "right") - 1
        self.hashes = mix(span_hashes(data, self.starts, self.ends) + langs[self.doc] * BASE + _U(seed))
        piece = np.cumsum(_ENDS[data])
        same = (piece[self.starts[1:]] == piece[self.starts[:-1]]) & (self.doc[1:] == self.doc[:-1]) if len(self.starts) else np.zeros(0, bool)
        self.linked = same

    def grams(self, seed: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For m from 2: hashes of the first and the last m - 1 words at each place, and where the m words are in one piece."""
        own, linked = self.hashes, self.linked
        inside = linked
        for m in range(2, longest + 1):
            yield m, own[:-1], own[1:], inside
            own = pair_hash(own[:-1], own[1:], seed)
            inside = inside[:-1] & linked[m - 1 :]


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    """Words and languages of slices; a batch has lang and text."""
    for batch in batches:
        names, codes = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True) if len(batch) else (np.zeros(0, str), np.zeros(0, int))
        raw = [n.encode() for n in names]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends) if raw else np.zeros(0, np.uint64)
        for block in blocks(batch.column(1)):
            own = codes[block.first : block.first + block.n]
            yield Words(block, hashes[own], seed), names[own]


def _table(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v for k, v in columns.items()})


def _spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    ends = np.cumsum(sizes)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class _WordTable:
    """Different words of some slices: hash, language, size, count, and their bytes one after another."""

    def __init__(self, h: np.ndarray, lang: np.ndarray, size: np.ndarray, n: np.ndarray, data: np.ndarray, starts: np.ndarray):
        order = np.argsort(h, kind="stable")
        h, lang, size, starts = h[order], lang[order], size[order], starts[order]
        like = np.flatnonzero((h[1:] == h[:-1]) & (lang[1:] == lang[:-1]) & (size[1:] == size[:-1]))
        # Words of one hash need not be one word: their bytes are compared with those of the one before.
        differ = _spans(data, starts[like], size[like]) != _spans(data, starts[like + 1], size[like])
        new = np.ones(len(h), bool)
        new[like + 1] = np.add.reduceat(differ, np.cumsum(size[like]) - size[like]) if len(like) else False
        at = np.flatnonzero(new)
        self.h, self.lang, self.size = h[at], lang[at], size[at]
        self.n = np.add.reduceat(n[order], at) if len(at) else n[:0]
        self.data = _spans(data, starts[at], self.size)

    @classmethod
    def joined(cls, tables: list[_WordTable]) -> _WordTable:
        h, lang, size, n, data = (np.concatenate([getattr(t, name) for t in tables]) for name in ("h", "lang", "size", "n", "data"))
        return cls(h, lang, size, n, data, np.cumsum(size) - size)

    def rows(self, langs: list[str]) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum(self.size))).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(self.h), pa.py_buffer(ends.tobytes()), pa.py_buffer(self.data.tobytes())).cast(pa.string())
        names = pa.array(langs, pa.string()).take(pa.array(self.lang))
        return pa.RecordBatch.from_pydict({"lang": names, "word": words, "h": pa.array(self.h.view(np.int64)), "f": pa.array(self.n)})


def _word_counts(seed: int, held: int = 1 << 19) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of each language with their hash and count, summed over as many slices as ``held`` different words allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        tables: list[_WordTable] = []
        for words, langs in _slices(batches, seed):
            own = np.array([codes.setdefault(x, len(codes)) for x in langs.tolist()], np.int64)
            size = words.ends - words.starts
            tables.append(_WordTable(words.hashes, own[words.doc], size, np.ones(len(size), np.int64), words.data, words.starts))
            if sum(len(t.h) for t in tables) >= held:
                tables = [_WordTable.joined(tables)]
                if len(tables[0].h) >= held // 2:
                    yield tables.pop().rows(list(codes))
        if tables:
            yield _WordTable.joined(tables).rows(list(codes))

    return run


def _pair_counts(m: int, seed: int, bits, held: int = 1 << 21) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What m words at places, of which both the first and the last m - 1 may be candidates, begin and end with, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(bits.value, np.uint64)
        mask, firsts, lasts, held_now = _U(len(filled) * 64 - 1), [], [], 0

        def may(keys: np.ndarray) -> np.ndarray:
            at = keys & mask
            return filled[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1) == 1

        def out() -> pa.RecordBatch:
            first, last = np.concatenate(firsts or [np.zeros(0, np.uint64)]), np.concatenate(lasts or [np.zeros(0, np.uint64)])
            firsts.clear()
            lasts.clear()
            order = np.argsort(pair_hash(first, last, seed), kind="stable")
            first, last = first[order], last[order]
            new = np.ones(len(order), bool)
            new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
            at = np.flatnonzero(new)
            return _table({"first": first[at], "last": last[at], "f": np.diff(np.append(at, len(order)))})

        for words, _ in _slices(batches, seed):
            for k, first, last, inside in words.grams(seed, m):
                if k == m:
                    where = np.flatnonzero(inside)
                    where = where[may(first[where])]
                    where = where[may(last[where])]
                    firsts.append(first[where])
                    lasts.append(last[where])
                    held_now += len(where)
            if held_now >= held:
                yield out()
                held_now = 0
        yield out()

    return run


def _slot_counts(longest: int, seed: int, sent, branches: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a block's candidates by slot, as pieces of an array a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, want_first, want_last = sent.value
        counts = np.zeros(len(want_first), np.int64)
        for words, _ in _slices(batches, seed):
            for _, first, last, inside in words.grams(seed, longest):
                where = np.flatnonzero(inside)
                slot = table.slots(pair_hash(first[where], last[where], seed))
                where, slot = where[slot >= 0], slot[slot >= 0]
                same = (want_first[slot] == first[where]) & (want_last[slot] == last[where])
                counts += np.bincount(slot[same], minlength=len(counts))
        pieces = [(at // PIECE, counts[at : at + PIECE].tobytes()) for at in range(0, len(counts), PIECE) if counts[at : at + PIECE].any()]
        branch = TaskContext.get().partitionId() % branches
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in pieces], pa.int64()), "branch": pa.array([branch] * len(pieces), pa.int32()), "counts": pa.array([c for _, c in pieces], pa.binary())})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces that met in a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            own = np.frombuffer(counts, np.int64)
            sums[piece] = sums[piece] + own if piece in sums else own
    yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int64()), "branch": pa.array([0] * len(sums), pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})


_ARRAYS = "piece long, branch int, counts binary"


class Miner:
    """The steps over one corpus; ``rows`` has lang and text."""

    def __init__(self, rows: DataFrame, least: int, longest: int, scratch: Scratch, filter_bits: int, block_keys: int):
        self.rows, self.least, self.longest, self.scratch = rows, least, longest, scratch
        self.filter_bits, self.block_keys = filter_bits, block_keys
        self.context = rows.sparkSession.sparkContext

    def words(self, seed: int) -> DataFrame | None:
        """All words (lang, word, h, f), or nothing if a frequent word shares its hash."""
        words = self.rows.mapInArrow(_word_counts(seed), "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))
        words = self.scratch.cut(words)
        return None if self._shared(words, F.max("f") >= self.least) else words

    def _shared(self, entries: DataFrame, matters) -> bool:
        return not entries.groupBy("h").agg(F.count("*").alias("n"), matters.alias("matters")).filter("n > 1 AND matters").isEmpty()

    def filter_of(self, entries: DataFrame):
        """A bitmap of the hashes: 2**filter_bits bits, whatever the number of entries."""
        word = F.col("h").bitwiseAND(F.lit((1 << self.filter_bits) - 1))
        bits = entries.groupBy(F.shiftright(word, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits")).toArrow()
        filled = np.zeros(1 << (self.filter_bits - 6), np.int64)
        filled[bits["at"].to_numpy()] = bits["bits"].to_numpy()
        return self.context.broadcast(filled.tobytes())

    def candidates(self, m: int, seed: int, shorter: DataFrame) -> DataFrame:
        """Phrases of m words that are frequent, by what they begin and end with."""
        bits = self.filter_of(shorter)
        pairs = self.rows.mapInArrow(_pair_counts(m, seed, bits), "first long, last long, f long").groupBy("first", "last").agg(F.sum("f").alias("f")).filter(F.col("f") >= self.least)
        hashed = pairs.mapInArrow(lambda batches: _with_hash(batches, m, seed), "m int, first long, last long, h long")
        out = self.scratch.cut(hashed)
        bits.unpersist()
        return out

    def counted(self, candidates: DataFrame, seed: int) -> DataFrame:
        """Exact counts of candidates (m, first, last, h), block by block."""
        blocks_needed = max(1, -(-candidates.count() // self.block_keys))
        out: DataFrame | None = None
        for b in range(blocks_needed):
            own = candidates.filter(F.pmod(F.xxhash64("h"), F.lit(blocks_needed)) == b) if blocks_needed > 1 else candidates
            keys = own.select("h", "first", "last").toArrow()  # about block_keys rows
            h, first, last = (keys[c].to_numpy().view(np.uint64) for c in ("h", "first", "last"))
            table = Hash(h)
            slot = table.slots(h)
            want_first, want_last = np.empty_like(first), np.empty_like(last)
            want_first[slot], want_last[slot] = first, last
            sent = self.context.broadcast((table, want_first, want_last))
            branches = 16
            arrays = self.rows.mapInArrow(_slot_counts(self.longest, seed, sent, branches), _ARRAYS)
            sums = arrays.repartition("piece", "branch").mapInArrow(_added, _ARRAYS).repartition("piece").mapInArrow(_added, _ARRAYS)

            def by_key(batches: Iterator[pa.RecordBatch], sent=sent, seed=seed) -> Iterator[pa.RecordBatch]:
                _, want_first, want_last = sent.value
                for batch in batches:
                    for piece, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                        own = slice(piece * PIECE, piece * PIECE + len(counts) // 8)
                        first, last = want_first[own], want_last[own]
                        yield _table({"h": pair_hash(first, last, seed), "a": np.frombuffer(counts, np.int64)})

            part = self.scratch.cut(sums.mapInArrow(by_key, "h long, a long"))
            sent.unpersist()
            out = part if out is None else out.unionByName(part)
        return candidates.join(out, "h").filter(F.col("a") >= self.least)


def _with_hash(batches: Iterator[pa.RecordBatch], m: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, last = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
        yield _table({"m": pa.array(np.full(len(batch), m, np.int32)), "first": first, "last": last, "h": pair_hash(first, last, seed)})


def collocations(
    documents: DataFrame, scratch: Scratch, least: int = 30, best: int = 2000, longest: int = LONGEST, scale: int = 2_000_000, share: int = 80, filter_bits: int = 27, block_keys: int = 1 << 21
) -> DataFrame:
    """The ``best`` phrases of 2 to ``longest`` words of each language of ``documents`` (text, lang).

    Texts are lower-cased in A to Z, cut into pieces at ``.,;:!?`` and line ends, and these into words at spaces and
    tabs.  A phrase that occurs ``least`` times, overlaps included, is a candidate.  Cut into two parts it has the score
    floor(scale * a / (l + r)), of the occurrences of the whole and of the parts; the cut with the least score counts,
    then the one after fewer words.  A candidate goes if a longer one around it has ``share`` percent of its occurrences.
    Phrases are ordered by score, occurrences (both falling) and bytes.  A null text is empty, a null language ``und``;
    repeated rows count each; without candidates there are no rows; other columns are not read.  The driver gets one block of
    ``block_keys`` candidates and a bitmap of 2**``filter_bits`` bits at a time, however large the corpus; each block is a pass over it."""
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    miner = Miner(rows, least, longest, scratch, filter_bits, block_keys)
    for seed in range(8):
        words = miner.words(seed)
        if words is None:
            continue
        frequent = words.filter(F.col("f") >= least)
        levels, shorter = [], frequent
        for m in range(2, longest + 1):
            shorter = miner.candidates(m, seed, shorter)
            levels.append(shorter)
        candidates = levels[0]
        for level in levels[1:]:
            candidates = candidates.unionByName(level)
        if not miner._shared(candidates, F.lit(True)):
            break
    else:
        raise ValueError("no seed keeps the hashes of the candidates apart")
    counted = scratch.cut(miner.counted(candidates, seed))
    none = F.expr("cast(array() AS array<long>)")
    level = frequent.select("h", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.col("f").alias("a"), none.alias("heads"), none.alias("tails"))
    scored = []
    for m in range(2, longest + 1):
        head = level.select(F.col("h").alias("first"), "lang", F.col("phrase").alias("head"), F.array_append("heads", F.col("a")).alias("heads"))
        tail = level.select(F.col("h").alias("last"), F.col("tail").alias("tail"), F.array_append("tails", F.col("a")).alias("tails"))
        level = scratch.cut(
            counted.filter(F.col("m") == m).join(head, "first").join(tail, "last")
            .select("h", "first", "last", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail", "a", "heads", "tails")
        )
        scored.append(level)
    around = None
    for level in scored[1:]:
        for side in ("first", "last"):
            own = level.select(F.col(side).alias("h"), F.col("a").alias("longer"))
            around = own if around is None else around.unionByName(own)
    phrases = scored[0]
    for level in scored[1:]:
        phrases = phrases.unionByName(level)
    # heads has the beginnings by length, tails the ends; the end that goes with a beginning of k words has m - k.
    cut = F.transform("heads", lambda l, i: F.struct(_floor_share(scale, F.col("a"), l + F.get("tails", F.size("tails") - 1 - i)).alias("score"), i.alias("k"), l.alias("l"), F.get("tails", F.size("tails") - 1 - i).alias("r")))
    scores = phrases.withColumn("cut", F.array_min(cut)).select("h", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if around is not None:
        held = around.groupBy("h").agg(F.max("longer").alias("longer"))
        scores = scores.join(held, "h", "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share)).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part of a language, then of these the first.
    salted = scores.withColumn("salt", F.pmod("h", F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _floor_share(scale: int, part, whole):
    """floor(scale * part / whole), in decimals as the product may pass 64 bits; at most ``scale`` / 2."""
    wide = part.cast("decimal(28,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", wide, whole.cast("decimal(20,0)"))
