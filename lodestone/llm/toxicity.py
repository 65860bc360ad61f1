"""Operator 10, toxicity: a convolutional text classifier in numpy.

Words and word beginnings are hashed to embeddings; filters of several widths
slide over the words, each keeps its maximum over the text, and a logistic layer
reads the maxima.  As the first layer is linear, a trained model is a table of
each hash's share in each filter, so scoring is lookups, sums and maxima.

Thresholds are calibrated for each language, which is guessed from function words
in the text itself; the score is shifted so that a language's threshold is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import Scratch, bound_batches, labelled, read_rows, row_of
from lodestone.llm.textblocks import Block, blocks, span_hashes

#: Frequent function words by language; a text's language is the one with most of them.
FUNCTION_WORDS = {
    "en": "the of and to in that is for it was with as on be at by this are from or",
    "fr": "le la les des et en un une que qui dans pour pas sur au du est par avec ce",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es",
    "es": "el la de que y en un los se del las por con una para su al lo como es",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
WIDTHS = (1, 2, 3)
PREFIX_CHARS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII characters other than letters and digits become spaces.
_CLEAN = _LOWER.copy()
_CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


@dataclass(frozen=True)
class ConvFit:
    """How the network is trained.  Every labelled document is learnt from; ``sample`` and ``words`` are about how many
    documents, and words of them at 8 bytes each, a task learns from between two exchanges with the others."""

    sample: int = 6_000
    words: int = 4_000_000
    buckets: int = 1 << 19
    dim: int = 8
    filters: int = 8
    epochs: int = 8
    batch: int = 64
    rate: float = 0.08
    seed: int = 7
    #: The thresholds also use scores of each text by a network that has not seen its fold.
    folds: int = 3
    #: A language with so many toxic texts has half the say in its threshold.
    shrink: float = 20.0
    least_texts: int = 4
    dropout: float = 0.4
    #: The most of the clean texts above a threshold, over all and in each language.
    false_share: float = 0.005
    language_share: float = 0.01


def word_ids(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word and of its beginning, and the number of words of each document."""
    clean = Block(block.first, _CLEAN[block.data], block.offsets)
    starts, ends, counts = clean.words()
    mask = np.uint64(buckets - 1)
    whole = (span_hashes(clean.data, starts, ends) & mask).astype(np.int64)
    leads = (clean.data & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(leads), np.full(PREFIX_CHARS, len(clean.data)))
    first = chars[np.cumsum(leads, dtype=np.int32)[starts] - 1 + PREFIX_CHARS]
    longer, begin = np.flatnonzero(first < ends), whole.copy()
    begin[longer] = (span_hashes(clean.data, starts[longer], first[longer]) & mask).astype(np.int64)
    return whole, begin, counts


def _function_tables(buckets: int) -> np.ndarray:
    """For each language, which buckets hold its function words."""
    out = np.zeros((len(FUNCTION_WORDS), buckets), bool)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        data = np.frombuffer(words.encode(), np.uint8)
        out[i, word_ids(Block(0, data, np.array([0, len(data)])), buckets)[0]] = True
    return out


def guess_language(whole: np.ndarray, counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The index in LANGUAGES of each document; without function words it is "other"."""
    doc = np.repeat(np.arange(len(counts)), counts)
    votes = np.stack([np.bincount(doc, weights=t[whole], minlength=len(counts)) for t in tables])
    return np.where(votes.max(axis=0) > 0, votes.argmax(axis=0), len(tables))


@dataclass
class Network:
    """The trained network, as lookup tables.

    ``tables[width]`` has for each place in a window the shares of words and of
    beginnings, a row for each known hash; row 0 is of unknown ones and zero."""

    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    bias: dict[int, np.ndarray]
    rows: tuple[np.ndarray, np.ndarray]  # of words, of beginnings: by hash the row in the tables, 0 if unknown
    out: np.ndarray
    offset: float
    shift: np.ndarray  # by language: the logit of its threshold
    buckets: int

    def maxima(self, whole: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each document's windows, at least 0.

        Beyond a document's end there are no words: windows there lack their shares."""
        whole, begin = self.rows[0].take(whole), self.rows[1].take(begin)
        n, docs = len(whole), np.flatnonzero(counts)
        found = np.zeros((len(counts), len(WIDTHS) * len(self.bias[1])), np.float32)
        if not n:
            return found
        ends = np.cumsum(counts)
        left = np.repeat(ends, counts) - np.arange(n)
        firsts = (ends - counts)[docs]
        for w, width in enumerate(WIDTHS):
            total = np.tile(self.bias[width], (n, 1))
            for place, (words, begins) in enumerate(self.tables[width]):
                inside = slice(None) if place == 0 else np.flatnonzero(left > place)
                at = np.arange(n)[inside] + place
                total[inside] += words.take(whole[at], axis=0) + begins.take(begin[at], axis=0)
            size = total.shape[1]
            found[docs, w * size : (w + 1) * size] = np.maximum(np.maximum.reduceat(total, firsts, axis=0), 0)
        return found

    def scores(self, whole: np.ndarray, begin: np.ndarray, counts: np.ndarray, languages: np.ndarray) -> np.ndarray:
        logit = self.maxima(whole, begin, counts) @ self.out + self.offset - self.shift[languages]
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))


def _constant(how: ConvFit, logit: float) -> Network:
    zero, none = np.zeros((1, 1), np.float32), np.zeros(how.buckets, np.int32)
    return Network(
        {w: [(zero, zero)] * w for w in WIDTHS}, {w: np.zeros(1, np.float32) for w in WIDTHS}, (none, none), np.zeros(len(WIDTHS), np.float32), logit, np.zeros(len(LANGUAGES)), how.buckets
    )


def _sizes(how: ConvFit) -> list[tuple[str, tuple[int, ...]]]:
    """The arrays of a network that are not of a word, and their shapes."""
    filters = [(f"{kind}{w}", shape) for w in WIDTHS for kind, shape in (("w", (w, how.dim, how.filters)), ("b", (how.filters,)))]
    return [*filters, ("out", (len(WIDTHS) * how.filters,)), ("offset", (1,))]


def _views(state: np.ndarray, known: tuple[int, int], how: ConvFit) -> dict[str, np.ndarray]:
    """The arrays of a network within ``state``, whose rows of ``dim`` numbers are those of known words, of known beginnings, and the rest end to end."""
    at, rest = 0, state[sum(known) :].reshape(-1)
    p = {"words": state[: known[0]], "begins": state[known[0] : sum(known)]}
    for name, shape in _sizes(how):
        n = int(np.prod(shape))
        p[name], at = rest[at : at + n].reshape(shape), at + n
    return p


def _first_state(known: tuple[int, int], how: ConvFit) -> np.ndarray:
    rng = np.random.default_rng(how.seed)
    rest = sum(int(np.prod(shape)) for _, shape in _sizes(how))
    state = np.zeros((sum(known) - (-rest // how.dim), how.dim), np.float32)
    p = _views(state, known, how)
    for name in ("words", "begins"):
        p[name][:] = rng.normal(0, 0.05, p[name].shape)
        p[name][0] = 0
    for w in WIDTHS:
        p[f"w{w}"][:] = rng.normal(0, 0.5 / np.sqrt(w), p[f"w{w}"].shape)
    p["out"][:], p["offset"][:] = 0.5, -1.0
    return state


class TrainedNetwork(Network):
    """A network whose tables are products of embeddings and filters.  It is kept, sent and read as these, a sixth of the size."""

    def __init__(self, p: dict, index: tuple[np.ndarray, np.ndarray], how: ConvFit):
        self.p = {name: array.copy() for name, array in p.items()}
        self.bias, self.rows, self.out, self.offset = {w: self.p[f"b{w}"] for w in WIDTHS}, index, self.p["out"], float(p["offset"][0])
        self.shift, self.buckets = np.zeros(len(LANGUAGES)), how.buckets

    @property
    def tables(self) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        return {w: [(self.p["words"] @ own, self.p["begins"] @ own) for own in self.p[f"w{w}"]] for w in WIDTHS}

    def maxima(self, whole: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.maximum(_peaks(self.p, self.rows[0].take(whole), self.rows[1].take(begin), counts)[0], 0)


def _train_on(state: np.ndarray, seen: np.ndarray, known: tuple[int, int], texts: Texts, y: np.ndarray, weight: np.ndarray, how: ConvFit, seed: list[int]) -> np.ndarray:
    """Learns once from each text, in place, and returns how many batches changed each row of ``state``."""
    rng = np.random.default_rng(seed)
    p, s = _views(state, known, how), _views(seen, known, how)
    touched = np.zeros(len(state), np.int64)
    places = {"words": touched[: known[0]], "begins": touched[known[0] : sum(known)]}

    def step(name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            s[name] += grad * grad
            p[name] -= how.rate * grad / np.sqrt(s[name])
            return
        rows, grad = rows[rows > 0], grad[rows > 0]
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
        own, total = ordered[firsts], np.add.reduceat(grad[order], firsts, axis=0)
        s[name][own] += total * total
        p[name][own] -= how.rate * total / np.sqrt(s[name][own])
        places[name][own] += 1

    order = rng.permutation(len(texts))
    for i in range(0, len(order), how.batch):
        now = order[i : i + how.batch]
        whole, begin, counts = _joined([texts[j] for j in now])
        spared = rng.random(len(whole)) >= how.dropout
        _learn(p, step, whole, begin, counts, spared, y[now], weight[now])
        touched[sum(known) :] += 1
    return touched


def _joined(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = [np.zeros(0, np.int64)]
    return np.concatenate([t[0] for t in texts] or none), np.concatenate([t[1] for t in texts] or none), np.array([len(t[0]) for t in texts], np.int64)


def _peaks(p: dict, whole: np.ndarray, begin: np.ndarray, counts: np.ndarray, spared: np.ndarray | None = None, words: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """The maximum of each filter over each text and the word where its window begins, so many words at a time;
    a text without words has -inf.  Words that are not ``spared`` count as unknown."""
    n, ends = len(whole), np.cumsum(counts)
    starts = ends - counts
    if spared is not None:
        spared = spared.astype(p["words"].dtype)[:, None]
    filters = np.concatenate([p[f"w{w}"][j].T for w in WIDTHS for j in range(w)])
    size = len(p["b1"])
    maxima, places = np.full((len(counts), len(WIDTHS) * size), -np.inf, filters.dtype), np.zeros((len(counts), len(WIDTHS) * size), np.int64)
    every = np.arange(len(WIDTHS) * size)
    for a in range(0, n, words):
        b, far = min(a + words, n), min(a + words + max(WIDTHS) - 1, n)
        x = p["words"].take(whole[a:far], axis=0) + p["begins"].take(begin[a:far], axis=0)
        if spared is not None:
            x *= spared[a:far]
        shares, row = filters @ x.T, 0
        total = np.empty((len(every), b - a), filters.dtype)
        for k, w in enumerate(WIDTHS):
            own = total[k * size : (k + 1) * size]
            np.add(shares[row : row + size, : b - a], p[f"b{w}"][:, None], out=own)
            for place in range(1, w):
                part = shares[row + place * size : row + (place + 1) * size]
                for back in range(place):  # no window reaches from before a text into it
                    first = starts + (back - a)
                    part[:, first[(first >= 0) & (first < far - a)]] = 0
                part = part[:, place : place + b - a]
                own[:, : part.shape[1]] += part
            row += w * size
        for d in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))):
            low, high = max(int(starts[d]) - a, 0), min(int(ends[d]) - a, b - a)
            if low < high:
                at = total[:, low:high].argmax(axis=1) + low
                top = total[every, at]
                better = top > maxima[d]
                maxima[d, better], places[d, better] = top[better], at[better] + a
    return maxima, places


def _logits_at(p: dict, texts: Texts) -> np.ndarray:
    """The logit of each text, without shift."""
    return np.maximum(_peaks(p, *_joined(texts))[0], 0) @ p["out"] + p["offset"][0]


def _learn(p: dict, step, whole: np.ndarray, begin: np.ndarray, counts: np.ndarray, spared: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One batch: forward, and the gradient through the places of the maxima only.

    Words that are not ``spared`` count as unknown this time, so that the network
    does not lean on a few of them."""
    ends, size = np.cumsum(counts), len(p["b1"])
    maxima, places = _peaks(p, whole, begin, counts, spared)
    active = np.maximum(maxima, 0)
    logit = active @ p["out"] + p["offset"][0]
    error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)).astype(np.float32)
    down = error[:, None] * p["out"] * (maxima > 0)
    step_out = active.T @ error
    rows, grads = [], []
    filters = []
    for w, width in enumerate(WIDTHS):
        cols = slice(w * size, (w + 1) * size)
        at, g = places[:, cols], down[:, cols]
        grad_w = np.zeros_like(p[f"w{width}"])
        for place in range(width):
            inside = (ends[:, None] - at > place) & (g != 0)
            inside[inside] = spared[at[inside] + place]
            d, f = np.nonzero(inside)
            position, share = at[d, f] + place, g[d, f]
            shares = np.zeros((size, len(f)), g.dtype)
            shares[f, np.arange(len(f))] = share
            grad_w[place] += (shares @ (p["words"][whole[position]] + p["begins"][begin[position]])).T
            rows.append(position)
            grads.append(share[:, None] * p[f"w{width}"][place].T[f])
        filters.append((width, grad_w, g.sum(axis=0)))
    position, grad = np.concatenate(rows), np.concatenate(grads)
    if len(position):
        step("words", grad, whole[position])
        step("begins", grad, begin[position])
    for width, grad_w, grad_b in filters:
        step(f"w{width}", grad_w)
        step(f"b{width}", grad_b)
    step("out", step_out)
    step("offset", np.array([error.sum()], np.float32))


def _best_cut(logit: np.ndarray, y: np.ndarray, false_share: float, times: np.ndarray | None = None) -> float:
    """The logit cut with the best F1 of those above which lies at most ``false_share`` of
    label 0; midway to the next value, above all if there is none.  Each value counts ``times``, else once."""
    order = np.argsort(-logit, kind="stable")
    s, t = logit[order], y[order]
    k = np.ones(len(s), np.int64) if times is None else times[order]
    hits, upto = np.cumsum(t * k), np.cumsum(k)
    f1 = 2 * hits / (upto + hits[-1])
    f1[upto - hits > false_share * (upto[-1] - hits[-1])] = -1
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    if f1[i] <= 0:
        return float(s[0] + 1)
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1)


def _least_cut(clean: np.ndarray, false_share: float, times: np.ndarray | None = None) -> float:
    """A cut that at most ``false_share`` of the values reach, which count ``times``, else once."""
    if not len(clean):
        return -np.inf
    order = np.argsort(-clean, kind="stable")
    upto = np.cumsum(np.ones(len(clean), np.int64) if times is None else times[order])
    return float(np.nextafter(clean[order[np.searchsorted(upto, int(false_share * upto[-1]), "right")]], np.inf)) + 1e-6


#: Logits that thresholds are set by are counted in bins of 1 / GRID.
GRID = 256
#: Bin (its middle), guessed language, label and number of texts.
Counted = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _calibrate(net: Network, own: Counted, crossed: list[Counted], how: ConvFit) -> None:
    """A threshold for each language, from texts that the scoring network was not trained on.

    The cut over all ``own`` texts, which the network itself has scored, is moved towards that of the language's texts: first
    of the crossed ones, whose logits count from the cut of their fold, then of its own, each by how many toxic ones there are.
    At most ``language_share`` of the clean texts of a language that the network itself has scored may lie above."""
    logit, languages, y, times = own
    if not len(y) or y.min() == y.max():
        return
    pooled = _best_cut(logit, y, how.false_share, times)
    over = [(c[0] - _best_cut(c[0], c[2], how.false_share, c[3]) + pooled, *c[1:]) for c in crossed]
    everywhere = [tuple(np.concatenate(x) for x in zip(*over))] if over else []
    for i in range(len(LANGUAGES)):
        cut = pooled
        for values, at, labels, n in (*everywhere, own):
            values, labels, n = (x[at == i] for x in (values, labels, n))
            toxic = (n * labels).sum()
            if 0 < toxic < n.sum():
                cut += (_best_cut(values, labels, how.language_share, n) - cut) * toxic / (toxic + how.shrink)
        clean = (languages == i) & (y == 0)
        net.shift[i] = max(cut, _least_cut(logit[clean] + 0.5 / GRID, how.language_share, times[clean]))


#: Sums of what tasks have learnt are of whole numbers, so that no order of the tasks changes them.
_UNIT = 1 << 18
#: Texts are dealt into so many parts; a fold and the fifth that is kept from training are some of them.
_PARTS = 15
#: About how many bytes of text a word takes; only the number of shards depends on it.
_WORD_BYTES = 6
_HASHED = "shard int, part int, label int, language int, n long, ids binary"
#: How packed texts are written: they are compressed already, and a page that is counted after 100 rows only, as is the default, is a whole file,
#: which the writer and each reader would hold several times.
_WRITTEN = {"compression": "uncompressed", "parquet.page.size": 256 << 10, "parquet.page.size.row.check.min": 1}
#: So many of these rows are read at a time.
_AT_ONCE = 16
#: Texts of one shard: what is of each text (a byte; of ``n``, words, eight) end to end, and their known words and beginnings, compressed.
_PACKED = "shard int, part binary, label binary, language binary, n binary, ids binary"


def _hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (shard, part, label, text) with, for the text, its guessed language, its number of words and the hashes of these and of their beginnings, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _function_tables(buckets)
        for batch in batches:
            for block in blocks(batch.column(3)):
                whole, begin, counts = word_ids(block, buckets)
                cuts = np.cumsum(counts)[:-1]
                ids = [pa.compress(np.concatenate(x).tobytes(), codec="zstd", asbytes=True) for x in zip(*(np.split(x.astype("<u4"), cuts) for x in (whole, begin)))]
                own = [batch.column(k)[block.first : block.first + block.n] for k in range(3)]
                languages = pa.array(guess_language(whole, counts, tables).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*own, languages, pa.array(counts), pa.array(ids, pa.binary())], names=["shard", "part", "label", "language", "n", "ids"])

    return rows.select("shard", "part", "label", "text").mapInArrow(run, _HASHED)


def _ids_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of each text's words and of their beginnings."""
    for n, x in zip(batch.column("n").to_pylist(), batch.column("ids")):
        both = np.frombuffer(pa.decompress(x.as_buffer(), 8 * n, codec="zstd"), "<u4") if n else np.zeros(0, np.uint32)
        yield both[:n], both[n:]


def _packed(rows: DataFrame, index: Broadcast, words: int = 16_384) -> DataFrame:
    """Hashed texts, which come by shard, as rows of about so many words, which are looked up in ``index``: every pass reads them, so
    this is done once and not text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, shard, size = ["part", "label", "language"], [], None, 0

        def packed() -> pa.RecordBatch:
            counts = np.array([len(h[3]) for h in held], "<i8")
            ids = np.concatenate([rows.take(np.concatenate([h[k] for h in held])) for k, rows in enumerate(index.value, 3)]).astype("<i4")
            own = [np.array([h[k] for h in held], np.uint8).tobytes() for k in range(3)]
            columns = [*own, counts.tobytes(), pa.compress(ids.tobytes(), codec="zstd", asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=["shard", *names, "n", "ids"])

        for batch in batches:
            for s, *facts, (whole, begin) in zip(*(batch.column(k).to_pylist() for k in ("shard", *names)), _ids_of(batch)):
                if held and (s != shard or size + len(whole) > words):
                    yield packed()
                    held, size = [], 0
                shard, size = s, size + len(whole)
                held.append((*facts, whole, begin))
        if held:
            yield packed()

    return rows.mapInArrow(run, _PACKED)


#: Texts as rows of known words and beginnings (0: unknown).
Texts = list[tuple[np.ndarray, np.ndarray]]


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Texts]]:
    """Shard, parts, labels, guessed languages and texts of each row of packed texts."""
    for row in batch.to_pylist():
        part, label, language = (np.frombuffer(row[k], np.uint8).astype(np.int64) for k in ("part", "label", "language"))
        counts = np.frombuffer(row["n"], "<i8")
        both = np.frombuffer(pa.decompress(row["ids"], 8 * int(counts.sum()), codec="zstd"), "<i4").reshape(2, -1)
        cuts = np.cumsum(counts)[:-1]
        yield row["shard"], part, label, language, list(zip(np.split(both[0], cuts), np.split(both[1], cuts)))


def _known(rows: DataFrame, how: ConvFit) -> tuple[np.ndarray, np.ndarray]:
    """By hash of a word and of a beginning the row in the tables, from 1; 0 if fewer than ``least_texts`` of the texts have it,
    as what few texts have says nothing about others."""
    buckets = how.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(2 * buckets, np.int32)
        for batch in batches:
            for ids in _ids_of(batch):
                for k, x in enumerate(ids):
                    times[np.unique(x).astype(np.int64) + k * buckets] += 1
        own = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(times[own].astype(np.int64))], names=["at", "n"])

    found = rows.select("n", "ids").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= how.least_texts).select("at").toArrow()
    known = np.zeros(2 * buckets, bool)
    known[found.column("at").to_numpy()] = True
    return tuple((np.cumsum(own) * own).astype(np.int32) for own in (known[:buckets], known[buckets:]))


def _held_by(fit: int, part: np.ndarray, how: ConvFit) -> np.ndarray:
    """Which parts' texts fit ``fit`` does not learn from: its fold or, of the last fit, whose network scores, a fifth."""
    return part % how.folds == fit if fit < how.folds else part % 5 == 4


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Texts]]:
    """Number, parts, labels and texts of each shard; packed texts come by shard."""
    now, held = None, []
    done = lambda: (now, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [t for h in held for t in h[2]])
    for batch in batches:
        for shard, part, label, _, texts in _unpacked(batch):
            if held and shard != now:
                yield done()
                held = []
            now = shard
            held.append((part, label, texts))
    if held:
        yield done()


def _in_slices(texts: Texts, words: int = 200_000) -> Iterator[np.ndarray]:
    """Places of texts in order, of about so many words at a time."""
    slices = np.cumsum([len(t[0]) for t in texts]) // words
    yield from np.split(np.arange(len(texts)), np.flatnonzero(np.diff(slices)) + 1) if texts else ()


def _epoch(rows: DataFrame, states: dict, known: tuple[int, int], how: ConvFit, weights: tuple[float, float], epoch: int) -> dict[int, float]:
    """One pass over the shards for each fit: the loss, mean by label, of the texts that it does not learn from, at its state; then
    (unless this is the last pass) its state is moved to what the shards have learnt from the others, where each shard
    that has changed a row counts by how many of its batches did so."""
    dim, learns = how.dim, epoch < how.epochs
    names = [f"v{i}" for i in range(2 * dim)]
    sent = {fit: rows.sparkSession.sparkContext.broadcast(state) for fit, state in states.items()}  # a worker has that of its fit only

    def runs(fit: int, own: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, seen = own.value
            p = _views(values, known, how)
            for shard, part, y, texts in _shards(batches):
                held, sums = _held_by(fit, part, how), np.zeros((2, 1 + 2 * dim), np.int64)
                unseen = np.flatnonzero(held)
                for at in _in_slices([texts[j] for j in unseen]) if epoch else ():
                    labels = y[unseen[at]]
                    logit = _logits_at(p, [texts[j] for j in unseen[at]])
                    loss = np.rint(np.logaddexp(0, np.where(labels == 1, -logit, logit)) * _UNIT).astype(np.int64)
                    for c in (0, 1):
                        sums[c, 0] += (labels == c).sum()
                        sums[c, 1] += loss[labels == c].sum()
                at, out = np.array([-1, -2]), sums
                if learns:
                    train = [j for j in np.flatnonzero(~held) if len(texts[j][0])]
                    after, beyond = values.copy(), seen.copy()
                    touched = _train_on(after, beyond, known, [texts[j] for j in train], y[train], np.where(y[train] == 1, weights[1], weights[0]), how, [how.seed, epoch, shard])
                    changed = np.flatnonzero(touched)
                    moved = np.hstack([after[changed].astype(float) - values[changed], beyond[changed].astype(float) - seen[changed]])
                    moved = np.rint(moved * touched[changed, None] * _UNIT).astype(np.int64)
                    at, out = np.concatenate([at, changed]), np.vstack([out, np.column_stack([touched[changed], moved])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), fit, np.int32)), pa.array(at), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], names=["fit", "row", "n", *names])

        return run

    schema = "fit int, row long, n long, " + ", ".join(f"{c} long" for c in names)
    learnt = reduce(DataFrame.unionAll, [rows.mapInArrow(runs(fit, own), schema) for fit, own in sent.items()]).filter("n > 0")
    means = [(F.sum(c) / (F.sum("n") * F.lit(float(_UNIT)))).cast("float").alias(c) for c in names]
    found = learnt.groupBy("fit", "row").agg(*means).toArrow()
    for own in sent.values():
        own.destroy()
    fit_of, row, losses = found.column("fit").to_numpy(), found.column("row").to_numpy(), {}
    for fit, state in states.items():
        changed = np.flatnonzero((fit_of == fit) & (row >= 0))
        losses[fit] = float(np.sort(found.column("v0").to_numpy()[(fit_of == fit) & (row < 0)]).sum())
        for k, array in enumerate(state):
            for i in range(dim):
                array[row[changed], i] += found.column(names[k * dim + i]).to_numpy()[changed]
    return losses


def _best_states(rows: DataFrame, fits: list[int], first: np.ndarray, known: tuple[int, int], how: ConvFit, weights: tuple[float, float]) -> dict[int, np.ndarray]:
    """Each fit's state after the epoch with the least loss on the texts that it does not learn from."""
    states, best = {fit: (first.copy(), np.full_like(first, 1e-2)) for fit in fits}, dict.fromkeys(fits, (np.inf, first))
    for epoch in range(how.epochs + 1):
        was = {fit: state[0].copy() for fit, state in states.items()}
        for fit, loss in _epoch(rows, states, known, how, weights, epoch).items():
            if epoch and loss < best[fit][0]:
                best[fit] = (loss, was[fit])
    return {fit: state for fit, (_, state) in best.items()}


def _counted(rows: DataFrame, states: dict[int, np.ndarray], known: tuple[int, int], how: ConvFit) -> dict[int, Counted]:
    """For each fit the texts that it has not learnt from, counted by bin of the logit, guessed language and label."""
    sent = rows.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, label, languages, texts in _unpacked(batch):
                for fit, state in sent.value.items():
                    own = np.flatnonzero(_held_by(fit, part, how))
                    logit = _logits_at(_views(state, known, how), [texts[j] for j in own])
                    bins = np.floor(np.clip(logit, -30, 30) * GRID).astype(np.int32)
                    columns = [np.full(len(own), fit, np.int32), bins, languages[own].astype(np.int32), label[own].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fit", "bin", "language", "label"])

    found = rows.mapInArrow(run, "fit int, bin int, language int, label int").groupBy("fit", "bin", "language", "label").count().toArrow()
    sent.destroy()
    fit_of, bins, languages, label, n = (found.column(k).to_numpy() for k in range(5))
    return {fit: ((bins[fit_of == fit] + 0.5) / GRID, languages[fit_of == fit], label[fit_of == fit], n[fit_of == fit]) for fit in states}


def train_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", how: ConvFit | None = None) -> Network:
    """A network from all labelled rows outside the held-out fold, trained on the executors.

    Texts are hashed, whole, and dealt into shards by their id.  In each epoch a task learns from a shard, beginning with
    the network that the driver has sent; what the shards have changed is averaged by a grouping, row by row of the network.
    A fifth of the texts is kept from training: it tells at which epoch to stop, and sets the thresholds, with
    scores of all texts by networks that have not seen their fold (see ``_calibrate``).  The driver has the networks, whose
    size is bounded by ``buckets``, and counts of logits by bin.  Without both labels the score is constantly near 0."""
    how = how or ConvFit()
    bound_batches(documents.sparkSession)
    texts = labelled(documents, labels, label)
    size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n_shards = max(1, -(-size[0] // how.sample), -(-(size[1] or 0) // (_WORD_BYTES * how.words)))
    place = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "doc_id"), F.lit(n)).cast("int").alias(what)
    dealt = texts.select(place("shard", n_shards), place("part", _PARTS), "doc_id", "label", "text").repartition(4 * n_shards, "shard")
    once = dealt.groupBy("shard", "part", "doc_id", "label").agg(F.min("text").alias("text"))  # of repeated rows with one id the least text
    scratch = Scratch(documents.sparkSession, "toxicity")
    rows = scratch.cut(_hashed(once.sortWithinPartitions("shard", "doc_id"), how.buckets))
    parts = rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).toPandas()
    total = parts.groupby("label")["n"].sum()
    if len(total) < 2:
        scratch.clear()
        return _constant(how, -20.0)
    tables = _known(rows, how)
    known = tuple(int(x.max()) + 1 for x in tables)
    index = documents.sparkSession.sparkContext.broadcast(tables)
    rows = scratch.cut(_packed(rows, index), **_WRITTEN)
    index.destroy()
    scratch.clear(keep=1)
    share = total[1] / total.sum()
    weights, first, fits = (0.5 / max(1 - share, 1e-3), 0.5 / max(share, 1e-3)), _first_state(known, how), []
    for fit in range(how.folds + 1):
        held = _held_by(fit, parts["part"].to_numpy(), how)
        if fit == how.folds or parts["label"][held].nunique() == parts["label"][~held].nunique() == 2:
            fits.append(fit)
    with read_rows(documents.sparkSession, _AT_ONCE):
        states = _best_states(rows, fits, first, known, how, weights)
        counted = _counted(rows, states, known, how)
    scratch.clear()
    net = TrainedNetwork(_views(states[how.folds], known, how), tables, how)
    _calibrate(net, counted[how.folds], [c for fit, c in counted.items() if fit < how.folds], how)
    return net


def _score(spark: SparkSession, net: Network) -> Column:
    """The score of ``text``.  Only texts go to Python, and only scores come back."""
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        tables = _function_tables(model.buckets)
        for texts in columns:
            own = np.empty(len(texts))
            for block in blocks(texts):
                whole, begin, counts = word_ids(block, model.buckets)
                own[block.first : block.first + block.n] = model.scores(whole, begin, counts, guess_language(whole, counts, tables))
            yield pa.array(own)

    return scores(F.col("text"))


def toxicity_scores(documents: DataFrame, net: Network, *keep: str) -> DataFrame:
    """The columns doc_id and ``keep``, score and predicted (score >= 0.5) of each whole text.

    Null and empty texts have no words and get the network's score for that.  Null
    ids stay null, repeated rows give repeated results, an empty table an empty result;
    other columns are not read and their names don't matter."""
    scored = documents.select(row_of(["doc_id", *keep]).alias("row"), _score(documents.sparkSession, net).alias("score"))
    return scored.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, net: Network) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is below 0.5."""
    return documents.filter(_score(documents.sparkSession, net) < 0.5)
