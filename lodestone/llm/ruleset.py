"""Operator 8, quality classifier: a sparse ensemble of rules.

Shallow trees are boosted over text statistics; every path in them becomes a
conjunctive rule; a lasso logistic regression weighs the rules and leaves most at
zero; the rest are compiled into one Spark expression.  Statistics and scores are
DataFrame functions; only the fit on a bounded sample is numpy, on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import labelled_sample, row_of

#: (statistic, greater, threshold)
Condition = tuple[str, bool, float]


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: Catalyst does not copy it into its uses."""
    return F.transform(F.array(value), body)[0]


def _counts(t: Column) -> Column:
    return F.struct(
        F.length(t).cast("double").alias("chars"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("double").alias("words"),
        F.regexp_count(t, F.lit(r"(?<![^ \n])([^ \n]++)[ \n]\1(?![^ \n])")).cast("double").alias("again"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double").alias("upper"),
        F.size(F.array_distinct(F.split(t, "[ \n]+"))).cast("double").alias("distinct"),
        F.size(F.split(t, "\n")).cast("double").alias("lines"),
        F.size(F.array_distinct(F.split(t, "\n"))).cast("double").alias("distinct_lines"),
        *((F.length(t) - F.length(F.translate(t, chars, ""))).cast("double").alias(name) for name, chars in _CLASSES.items()),
    )


def _shares(c: Column) -> Column:
    per = lambda x, n: c[x] / F.greatest(c[n], F.lit(1.0))
    return F.struct(
        F.log1p(c["words"]).alias("log_words"),
        per("chars", "words").alias("chars_per_word"),
        per("again", "words").alias("repeated_words"),
        per("upper", "chars").alias("upper_share"),
        per("distinct", "words").alias("distinct_words"),
        per("distinct_lines", "lines").alias("distinct_lines"),
        per("n_symbols", "words").alias("symbols"),
        per("n_bars", "words").alias("bars"),
        per("n_marks", "words").alias("marks"),
        per("n_stops", "words").alias("stops"),
        per("n_digits", "chars").alias("digits"),
        per("lines", "words").alias("lines_per_word"),
    )


def statistics(text: Column) -> Column:
    """A struct of the statistics NAMES, doubles, of a text; null counts as empty."""
    return _bind(F.coalesce(text, F.lit("")), lambda t: _bind(_counts(t), _shares))


_CLASSES = {"n_symbols": "#*$%&<>@=~^{}[]\\", "n_bars": "|", "n_marks": "!?", "n_stops": ".,;:", "n_digits": "0123456789"}
NAMES = (
    "log_words", "chars_per_word", "repeated_words", "upper_share", "distinct_words", "distinct_lines",
    "symbols", "bars", "marks", "stops", "digits", "lines_per_word",
)


@dataclass(frozen=True)
class RuleFit:
    """How the rules are made.  ``sample`` is the most labelled documents that the fit sees."""

    sample: int = 20_000
    trees: int = 24
    depth: int = 3
    bins: int = 32
    least: int = 20
    shrink: float = 0.3
    penalties: tuple[float, ...] = (0.02, 0.005, 0.002, 0.0005)
    steps: int = 300


@dataclass(frozen=True)
class Rules:
    """Conjunctions with their weights, and the intercept."""

    weighted: tuple[tuple[tuple[Condition, ...], float], ...]
    intercept: float

    def score(self, s: Column) -> Column:
        """The probability of label 1 as a column expression over a struct of statistics."""
        one = lambda c: s[c[0]] > c[2] if c[1] else s[c[0]] <= c[2]
        total = F.lit(self.intercept)
        for conditions, weight in self.weighted:
            total = total + F.when(reduce(and_, map(one, conditions)), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], how: RuleFit) -> list[tuple[np.ndarray, tuple, float]]:
    """The leaves (rows, conditions, step) and inner nodes of one tree of second-order boosting."""
    nodes, todo = [], [(np.arange(len(x)), ())]
    while todo:
        rows, path = todo.pop()
        g, h = grad[rows], hess[rows]
        best = (1e-6, None)
        if len(path) < how.depth and len(rows) >= 2 * how.least:
            base = g.sum() ** 2 / (h.sum() + 1)
            for j, edges in enumerate(cuts):
                if not len(edges):
                    continue
                at = np.searchsorted(edges, x[rows, j])  # bin i: <= edges[i]
                n = np.cumsum(np.bincount(at, minlength=len(edges) + 1))[:-1]
                gl = np.cumsum(np.bincount(at, g, len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(at, h, len(edges) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
                gain[(n < how.least) | (len(rows) - n < how.least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (j, float(edges[i])))
        if path:
            nodes.append((rows, path, 0.0 if best[1] else -g.sum() / (h.sum() + 1)))
        elif best[1] is None:
            return []
        if best[1]:
            j, cut = best[1]
            low = x[rows, j] <= cut
            todo += [(rows[low], (*path, (NAMES[j], False, cut))), (rows[~low], (*path, (NAMES[j], True, cut)))]
    return nodes


def _rules(x: np.ndarray, y: np.ndarray, how: RuleFit) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, how.bins + 1)[1:-1])) for j in range(x.shape[1])]
    margin, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(how.trees):
        p = _sigmoid(margin)
        for rows, path, step in _grow(x, p - y, p * (1 - p), cuts, how):
            margin[rows] += how.shrink * step
            found.setdefault(tuple(sorted(path)), None)
    return list(found)


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, NAMES.index(n)] > t) == greater for n, greater, t in rule])


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, m = a.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v = np.random.default_rng(0).normal(size=m)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * (float(v @ (a.T @ (a @ v))) / n + 1) + 1e-9)
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        r = (_sigmoid(a @ ahead + ahead_b) - y) / n
        new = ahead - rate * (a.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = ahead_b - rate * r.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, float(b)


def fit_rules(x: np.ndarray, y: np.ndarray, how: RuleFit | None = None) -> Rules:
    """Rules from statistics (columns as NAMES) and 0/1 labels.

    The penalty is the one with the least log loss on a fifth of the rows that the
    weights have not seen; then all rows are used.  With one class only there are no
    rules, and the score is the smoothed share of label 1."""
    how = how or RuleFit()
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(y) < 2 * how.least or y.min() == y.max():
        return Rules((), prior)
    rules = _rules(x, y, how)
    if not rules:
        return Rules((), prior)
    a = np.stack([_holds(x, r) for r in rules], axis=1).astype(float)
    test = np.arange(len(y)) % 5 == 0
    loss = {}
    for penalty in how.penalties:
        w, b = _lasso(a[~test], y[~test], penalty, how.steps)
        p = np.clip(_sigmoid(a[test] @ w + b), 1e-6, 1 - 1e-6)
        loss[penalty] = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
    w, b = _lasso(a, y, min(loss, key=loss.get), how.steps)
    return Rules(tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6), b)


def train_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", how: RuleFit | None = None) -> Rules:
    """Rules from at most ``how.sample`` labelled rows outside the held-out fold."""
    how = how or RuleFit()
    rows = labelled_sample(documents, labels, label, how.sample)
    sample = rows.select("doc_id", "label", statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*").orderBy("doc_id", *NAMES).toPandas()
    return fit_rules(sample[list(NAMES)].to_numpy(float), sample["label"].to_numpy(float), how)


def quality_scores(documents: DataFrame, rules: Rules, *keep: str, accept: float = 0.3) -> DataFrame:
    """doc_id, the columns ``keep``, score and predicted for each row of ``documents``.

    Null and empty texts are scored by the same rules with all counts 0.  Null ids
    stay null, repeated rows give repeated results, an empty table an empty result;
    other columns are not read and their names don't matter."""
    scored = documents.select(row_of(["doc_id", *keep]).alias("row"), _score(rules).alias("score"))
    return scored.select("row.*", "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def _score(rules: Rules) -> Column:
    return _bind(statistics(F.col("text")), rules.score)


def good_documents(documents: DataFrame, rules: Rules, accept: float = 0.3) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is at least ``accept``."""
    return documents.filter(_score(rules) >= accept)
