"""Operator 9, quality rules: repetition coverage by rolling hashes in numpy.

Windows of several numbers of words are hashed by rolling over word hashes; a
character counts as covered if its word lies in a window that the text has
twice or more.  Repeated lines are measured the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.textblocks import BASE, Block, blocks, mix, rolling, span_hashes, window_mask

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_chars_5 long, dup_chars_7 long, dup_chars_10 long, dup_line_chars long, base_failed boolean, kept boolean"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_chars_5", "dup_chars_7", "dup_chars_10", "dup_line_chars")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


@dataclass(frozen=True)
class RepetitionLimits:
    """Percent of word characters that may lie in repeated windows or lines."""

    windows: dict[int, int] = field(default_factory=lambda: {5: 20, 7: 18, 10: 15})
    lines: int = 20
    least_words: int = 10
    repeat_words: int = 20


def _twice(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: its hash occurs twice or more in its document; it is not the first."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    keys = hashes ^ mix(doc.astype(np.uint64) * BASE)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    again, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    again[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return again, later


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words that lie in a window of n words beginning at one of ``starts``."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(block: Block, sizes: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The measures of each document of a block."""
    starts, ends, counts = block.words()
    doc = np.repeat(np.arange(block.n), counts)
    chars = block.chars()
    width = chars[ends] - chars[starts]
    per_doc = lambda values, of: np.bincount(of, weights=values, minlength=block.n).astype(np.int64)
    words = span_hashes(block.data, starts, ends)
    out = {"n_words": counts.astype(np.int64), "word_chars": per_doc(width, doc)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[block.data])))
    out["n_symbols"] = symbols[block.offsets[1:]] - symbols[block.offsets[:-1]]
    for n in sorted({5, *sizes}):
        inside = np.flatnonzero(window_mask(counts, n))
        again, _ = _twice(doc[inside], rolling(words, n)[inside])
        covered = _covered(inside[again], n, len(words))
        out[f"dup_chars_{n}"] = per_doc(width * covered, doc)
        if n == 5:
            out["n_repeat_words"] = per_doc(covered, doc)
    first, last, line_doc = block.lines()
    with_word = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, line_doc = first[with_word], last[with_word], line_doc[with_word]
    again, later = _twice(line_doc, span_hashes(block.data, first, last))
    out["n_dup_lines"] = per_doc(later, line_doc)
    sums = np.concatenate(([0], np.cumsum(width)))
    line_chars = sums[np.searchsorted(starts, last)] - sums[np.searchsorted(starts, first)]
    out["dup_line_chars"] = per_doc(line_chars * later, line_doc)
    return out


def repetition_rules(documents: DataFrame, limits: RepetitionLimits | None = None) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text) with its measures and verdict.

    ``kept`` is false if ``base_failed``, or if the percentage of word characters
    in repeated windows of some size, or in repeated lines after the first, is
    above its limit.  Null and empty texts have no words, so they fail the base
    rule.  Null ids stay null, repeated rows give repeated results, an empty table
    an empty result; other columns are not read."""
    limits = limits or RepetitionLimits()
    sizes = tuple(limits.windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                x = measure(block, sizes)
                failed = (x["n_words"] < limits.least_words) | (100 * x["n_repeat_words"] > limits.repeat_words * x["n_words"])
                kept = ~failed & (100 * x["dup_line_chars"] <= limits.lines * x["word_chars"])
                for n, most in limits.windows.items():
                    kept &= 100 * x[f"dup_chars_{n}"] <= most * x["word_chars"]
                cols = [ids.slice(block.first, block.n), *(pa.array(x[f.name]) for f in list(_ARROW)[1:-2]), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)

    if sizes != (5, 7, 10):
        raise ValueError("the result schema names the window sizes 5, 7 and 10")
    return documents.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)
