"""Operator 5, byte-level BPE: merges by a queue over ranks with a hierarchical bitmap.

A pre-token is a doubly linked list of pieces.  Each merge rank that occurs has
a bucket of list positions; a two-level bitmap over ranks says which buckets
have entries, and find-first-set on it gives the next rank.  A popped position
whose pair has changed meanwhile is stale and skipped.  Each merge therefore
costs a constant number of bit operations, whatever the length of the
pre-token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

WORD_SHIFT = 8
WORD_MASK = (1 << WORD_SHIFT) - 1
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class BytePairs:
    """Encoder and decoder over the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 500_000, longest: int = 64):
        self.ranks, self.remember, self.longest = ranks, remember, longest
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: The rank of two neighbouring tokens joined, by left << 20 | right.
        self.joined = {
            ranks[token[:cut]] << 20 | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(pattern).findall

    def merge(self, piece: bytes) -> list[int]:
        """The token ids of one pre-token.

        ``buckets`` holds positions by rank, ``low`` a bitmap of 256 ranks for
        each word with entries, ``high`` a bitmap of those words."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        single, joined = self.single, self.joined.get
        ids = [single[b] for b in piece]
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        high = 0
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            rank = joined(left << 20 | right)
            left = right
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    word = rank >> WORD_SHIFT
                    low[word] = low.get(word, 0) | 1 << (rank & WORD_MASK)
                    high |= 1 << word
        while high:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            lowest = bits & -bits
            rank = (word << WORD_SHIFT) + lowest.bit_length() - 1
            low[word] = bits = bits ^ lowest
            if not bits:
                high ^= 1 << word
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()  # equal ranks merge from the left
            for i in positions:
                j = after[i]
                if j >= n or ids[i] < 0 or joined(ids[i] << 20 | ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    new = joined(rank << 20 | ids[k])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            word = new >> WORD_SHIFT
                            low[word] = low.get(word, 0) | 1 << (new & WORD_MASK)
                            high |= 1 << word
                h = before[i]
                if h >= 0:
                    new = joined(ids[h] << 20 | rank)
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            word = new >> WORD_SHIFT
                            low[word] = low.get(word, 0) | 1 << (new & WORD_MASK)
                            high |= 1 << word
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a pre-token as unsigned 32-bit little-endian integers.

        Short pre-tokens are remembered; the memory is emptied when it has
        ``remember`` entries, and longer ones are never kept."""
        ids = array("I", self.merge(piece.encode("utf-8", "surrogatepass")))
        if ids.itemsize != 4:
            raise RuntimeError("unsigned int has not 4 bytes here")
        out = ids.tobytes()
        if len(piece) <= self.longest:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        known, encode = self.known, self.encode_piece
        return b"".join([known.get(p) or encode(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; every id must be in the vocabulary."""
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


_CODERS: dict[tuple[int, str], BytePairs] = {}


def coder_of(ranks, pattern: str) -> BytePairs:
    """The coder of a broadcast rank file, kept for the later tasks of this worker."""
    key = (hash(ranks.value), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = BytePairs(load_ranks(ranks.value), pattern)
    return _CODERS[key]


def encode_documents(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode and decode each whole text; digests of the ids and of the decoded bytes.

    ``vocabulary`` is a rank file on the driver, read there and sent along once
    (its size does not depend on the data).  A null text counts as empty: no
    tokens, digests of nothing.  Null ids stay null, repeated rows give repeated
    results, an empty table an empty result; other columns are not read."""
    ranks = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        for batch in batches:
            count, ids_hash, bytes_hash = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                count.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                bytes_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)
