"""Vectorised views of Arrow string columns: words, lines and rolling hashes in numpy.

Everything here works on the UTF-8 bytes of a slice of documents, so a task
holds a few MB at a time however many rows a batch has.  Words are runs of
bytes other than 0x20 and 0x09-0x0D, which are the words of the pattern
``[^\\x20\\x09-\\x0D]+`` because UTF-8 never uses those bytes inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Bytes of some documents: ``data`` (uint8) and ``offsets`` (one more than documents)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and how many words each document has."""
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.diff(np.searchsorted(starts, self.offsets))

    def chars(self) -> np.ndarray:
        """Running count of code points: entry i counts those that begin before byte i."""
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte (without the newline) of each line, and its document."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.union1d(self.offsets[:-1], breaks + 1)
        starts = starts[starts < len(self.data)]
        doc = np.searchsorted(self.offsets, starts, "right") - 1
        ends = np.append(starts[1:], len(self.data))
        ends = np.minimum(ends, self.offsets[doc + 1])
        has_break = (ends > starts) & (self.data[np.maximum(ends - 1, 0)] == 0x0A)
        return starts, ends - has_break, doc


def blocks(column: pa.ChunkedArray | pa.Array) -> Iterator[Block]:
    """Slices of a string column of about SLICE_BYTES each; null counts as empty.

    A longer document is a slice of its own, whole."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for array in arrays:
        array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        n = len(array)
        if not n:
            continue
        offsets = np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8)
        raw = array.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            own = offsets[i : j + 1]
            yield Block(first + i, data[own[0] : own[-1]], own - own[0])
            i = j
        first += n


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are sorted and do not overlap.

    Eight bytes at a time are mixed with a key of their place in the span, and summed.  About
    ``step`` bytes are hashed at once (a longer span alone), so memory does not grow with
    the text.  No pattern of bytes makes sums meet, as a polynomial's would."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        lo = starts[i]
        out[i:j] = _sums(data[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


#: The first bytes of eight, by their number.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _place_keys(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE)


_KEYS = _place_keys(1 << 17)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))  # those from each byte on
    length = ends - starts
    n = -(-length // 8)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    keys = _KEYS if n.max(initial=0) <= len(_KEYS) else _place_keys(int(n.max()))
    left = np.minimum(np.repeat(length, n) - 8 * place, 8)
    mixed = mix((eight[np.repeat(starts, n) + 8 * place] & _FIRST_BYTES[left]) ^ keys[place])
    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(mixed, first[some])
    return out


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive word hashes, over the whole block;
    windows that cross documents are for the caller to leave out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + words[k : k + len(out)]
    return mix(out)


def window_mask(counts: np.ndarray, n: int) -> np.ndarray:
    """True for windows of n words that lie inside one document."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, bool)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(total)
    return left[: total - n + 1] >= n
