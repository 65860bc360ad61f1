"""Operator 11, conversation structure repair by a min-plus matrix scan.

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  A turn may be
kept (0), get another role (2) or be deleted (3); empty turns may be inserted
anywhere (2).  Each turn is a 4x4 matrix over the states nothing, after s, after u
and after a; its elements are pairs of cost and audit (one letter an edit), and the
insertions that may come before it are the closure of the insertion matrix.  The
product is taken over (min, +) with audits joined, ties to the least audit.  It is
associative, and so is everything else that is counted along a conversation.

Turns are sorted by ranges and cut into segments of a bounded number of rows, which
are multiplied each for itself; products of one conversation are then multiplied
in groups until one is left.  No task needs a whole conversation for its edits.  Only
ids, flags and digests of texts take part; texts cross a shuffle for the repaired
turns alone, which stream through a task in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import Scratch

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role initial.
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
LONGEST = (1 << 63) - 1

Cell = tuple[int, str] | None
Matrix = tuple[tuple[Cell, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product over (min, +): the cheapest way from state to state, then the least audit.

    Two audits of one cost over the same turns are never a beginning of each other (the rest would be
    insertions, which cost), so taking the least before more is joined loses nothing."""
    return tuple(
        tuple(min(((x[0] + y[0], x[1] + y[1]) for x, y in ((row[k], b[k][j]) for k in range(4)) if x is not None and y is not None), default=None) for j in range(4))
        for row in a
    )


def _matrix(cells: Iterable[tuple[int, int, Cell]]) -> Matrix:
    out: list[list[Cell]] = [[None] * 4 for _ in range(4)]
    for i, j, cell in cells:
        out[i][j] = cell if out[i][j] is None else min(out[i][j], cell)
    return tuple(map(tuple, out))


IDENTITY = _matrix((i, i, (0, "")) for i in range(4))


def _closure() -> Matrix:
    """Any number of insertions: identity and insertion, squared until nothing changes."""
    one = _matrix([*((i, i, (0, "")) for i in range(4)), *((i, _AFTER[i, r], (INSERT, "I")) for i in range(4) for r in "ua" if (i, r) in _AFTER)])
    while (more := times(one, one)) != one:
        one = more
    return one


INSERTS = _closure()


@lru_cache(None)
def turn_matrix(code: str) -> Matrix:
    """A turn: its role initial (x for any other), in capitals if it is truncated; D must be deleted."""
    ways: list[tuple[int, int, Cell]] = [(i, i, (DELETE, "D")) for i in range(4)]
    if code != "D":
        more = int(code.isupper())
        initial = code.lower()
        ways += [(i, _AFTER[i, initial], (KEEP + more, "K")) for i in range(4) if (i, initial) in _AFTER]
        ways += [(i, _AFTER[i, r], (REROLE + more, "R")) for i in range(4) for r in "ua" if (i, r) in _AFTER]
    return times(INSERTS, _matrix(ways))


@lru_cache(1 << 14)
def _short(codes: str) -> Matrix:
    return turn_matrix(codes) if len(codes) == 1 else times(_short(codes[: len(codes) // 2]), _short(codes[len(codes) // 2 :]))


def tree(matrices: list[Matrix]) -> Matrix:
    """The product of neighbours, again and again."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else IDENTITY


def turns_matrix(codes: str) -> Matrix:
    """The product of turns: short runs are remembered, as most conversations are alike."""
    return tree([_short(codes[i : i + 16]) for i in range(0, len(codes), 16)])


def answer(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit from nothing to nothing or to an assistant turn, insertions at the end included."""
    closed = times(matrix, INSERTS)
    return min(closed[START][START], closed[START][ASSISTANT])


@dataclass
class Span:
    """What a run of turns adds up to; ``joined`` with the next run is associative."""

    matrix: Matrix = IDENTITY
    ends: str = ""  # first and last role initial
    turns: tuple[int, int, int] | None = None  # least, greatest and how many distinct
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def facts_with(self, b: Span, matrix: Matrix) -> Span:
        turns = self.turns or b.turns
        if self.turns and b.turns:
            turns = (self.turns[0], b.turns[1], self.turns[2] + b.turns[2] - (self.turns[1] == b.turns[0]))
        broken = bool(self.ends and b.ends) and self.ends[-1] + b.ends[0] not in _LEGAL
        ends = (self.ends[0] if self.ends else b.ends[:1]) + (b.ends[-1] if b.ends else self.ends[-1:])
        return Span(matrix, ends, turns, self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated, self.illegal + b.illegal + broken)

    def row(self) -> dict:
        cells = [x for r in self.matrix for x in r]
        low, high, distinct = self.turns or (None, None, 0)
        return {
            "costs": [None if x is None else x[0] for x in cells], "audits": [None if x is None else x[1] for x in cells], "ends": self.ends, "low": low, "high": high,
            "distinct": distinct, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
        }

    @classmethod
    def of(cls, row: dict) -> Span:
        cells = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
        turns = None if row["low"] is None else (row["low"], row["high"], row["distinct"])
        return cls(tuple(tuple(cells[i : i + 4]) for i in range(0, 16, 4)), row["ends"], turns, row["blank"], row["duplicate"], row["truncated"], row["illegal"])


def joined(spans: list[Span]) -> Span:
    """Spans in order, their matrices as a tree."""
    out, matrix = Span(), tree([s.matrix for s in spans])
    for s in spans:
        out = out.facts_with(s, matrix)
    out.matrix = matrix
    return out


def span_of(turns: list[dict]) -> Span:
    """Turns in order, each with ``copies`` equal rows of which only the first can be no duplicate."""
    spans, codes = Span(), []
    for t in turns:
        n, initial = t["copies"], t["initial"]
        own = Span(ends=initial * 2, turns=None if t["turn"] is None else (t["turn"], t["turn"], 1), illegal=n - 1)
        if t["blank"]:
            own.blank = n
        else:
            own.duplicate, own.truncated = n - t["first"], int(t["first"] and t["truncated"])
        spans = spans.facts_with(own, IDENTITY)
        if t["first"] and not t["blank"]:
            codes.append(initial.upper() if t["truncated"] else initial)
            n -= 1
        codes.append("D" * n)
    spans.matrix = turns_matrix("".join(codes))
    return spans


_SPAN = "costs array<long>, audits array<string>, ends string, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long"
_SPAN_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("ends", pa.string())]
    + [(n, pa.int64()) for n in ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")]
)
_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, segment, turns) to a span each."""
    for batch in batches:
        rows = [{"conv_id": c, "segment": s} | span_of([t for t in turns if t["copies"]]).row() for c, s, turns in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_pylist(rows, _SPAN_ARROW)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, segment, spans in order) to their product."""
    for batch in batches:
        rows = [{"conv_id": r["conv_id"], "segment": r["segment"]} | joined(list(map(Span.of, r["spans"]))).row() for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, _SPAN_ARROW)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in _FACTS), ("audit", pa.string())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cost, audit = answer(Span.of(r).matrix)
            gaps = 0 if r["low"] is None else min(r["high"] - r["low"] + 1 - r["distinct"], LONGEST)
            rows.append({"conv_id": r["conv_id"], "gaps": gaps, "cost": cost, "audit": audit} | {n: r[n] for n in _FACTS[1:5]})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order, the answer of a conversation before its turns, to the answer and the repaired turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), *((n, pa.int64()) for n in _FACTS)])
    now: dict | None = None
    state, at, place = START, 0, 0

    def inserted(until_end: bool = False) -> Iterator[dict]:
        nonlocal state, at, place
        while at < len(now["text"]) and now["text"][at] == "I":
            place, at = place + 1, at + 1
            yield {"conv_id": now["conv_id"], "place": place, "edit": "I", "role": _ROLE[state], "text": ""}
            state = _AFTER[state, _ROLE[state][0]]

    def taken(r: dict) -> Iterator[dict]:
        nonlocal state, at, place
        for _ in range(r["copies"]):
            yield from inserted()
            edit, at = now["text"][at], at + 1
            if edit == "D":
                continue
            role = r["role"] if edit == "K" else _ROLE[state]
            state, place = _AFTER[state, role[0]], place + 1
            yield {"conv_id": now["conv_id"], "place": place, "edit": edit, "turn": r["turn"], "role": role, "text": r["text"]}

    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            if r["cost"] is not None:
                out += inserted() if now else ()
                now, state, at, place = r, START, 0, 0
                out.append({"conv_id": r["conv_id"], "place": 0, "text": r["text"]} | {n: r[n] for n in _FACTS})
            else:
                out += taken(r)
        yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist(list(inserted()), schema)


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string, " + ", ".join(f"{n} long" for n in _FACTS)


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def repair(conversations: DataFrame, scratch: Scratch, segment_rows: int = 4096, fan_in: int = 64) -> DataFrame:
    """Repaired turns of ``conversations`` (conv_id, turn, role, text and perhaps ``copies``, the number of such rows).

    For each conv_id a row of place 0 with its counts of faults, the cost, and the audit in ``text``; after it,
    in the same partition and in order, its repaired turns with places from 1 and the edit that made each (K, R or I).

    Turns come by number, nulls first, then by role and by a digest of role and text.  A turn's first fault counts:
    blank, duplicate (role and text came earlier), truncated (the last character that is no white space is none
    of ``.!?``); blank and duplicate ones must go, a truncated one that stays costs 1 more.  Null role and text
    count as one space.  Rows of 0 copies only say that there is such a conversation.  Rows without an id are one
    conversation.  Equal rows are counted before they are sorted.  An empty table gives no rows; other columns are not read.
    Sums of cost must fit a long; gaps beyond it are the largest long."""
    names = {c.lower() for c in conversations.columns}
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.col("copies").cast("long") if "copies" in names else F.lit(1).cast("long")).alias("copies"),
    )
    trimmed = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    thin = rows.select(
        "conv_id", "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"), "copies",
    )
    order = ["conv_id", "turn", "role", "digest"]
    counted = thin.groupBy(*order, "initial", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    # The id grows along a partition and from one to the next, so it is a turn's place in the sorted whole.
    placed = scratch.cut(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    first = placed.filter("copies > 0 AND NOT blank").groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(1).alias("first"))
    turn = F.struct("at", "turn", "initial", "blank", "truncated", "copies", F.coalesce("first", F.lit(0)).alias("first"))
    segments = (
        placed.join(first, "at", "left").groupBy("conv_id", F.expr(f"at div {segment_rows}").alias("segment"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns")).mapInArrow(_spans, f"conv_id long, segment long, {_SPAN}")
    )
    spans = scratch.cut(segments)
    by_conversation = Window.partitionBy("conv_id")
    several = spans.select("conv_id", "segment").withColumn("n", F.count("*").over(by_conversation)).filter("n > 1")
    ranked = scratch.cut(several.withColumn("rank", F.row_number().over(by_conversation.orderBy("segment")) - 1))
    most = ranked.agg(F.max("n")).first()[0]
    whole = spans
    if most:
        ranks = ranked.select(F.col("conv_id").alias("of"), F.col("segment").alias("rank of"), "rank")
        same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("rank of"))
        level = spans.join(ranks, same).drop("of", "segment", "rank of").withColumnRenamed("rank", "segment")
        whole = spans.join(ranks, same, "left_anti")
        while most > 1:
            parts = F.array_sort(F.collect_list(F.struct("segment", *(n for n in level.columns if n not in ("conv_id", "segment"))))).alias("spans")
            level = scratch.cut(level.groupBy("conv_id", F.expr(f"segment div {fan_in}").alias("segment")).agg(parts).mapInArrow(_products, f"conv_id long, segment long, {_SPAN}"))
            most = -(-most // fan_in)
        whole = whole.unionByName(level)
    answers = whole.mapInArrow(_answers, "conv_id long, " + ", ".join(f"{n} long" for n in _FACTS) + ", audit string")
    turns = rows.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    texts = turns.withColumn("digest", _digest(F.col("role"), F.col("text"))).unionByName(answers.withColumnRenamed("audit", "text"), allowMissingColumns=True)
    answer_first = F.when(F.col("cost").isNotNull(), 0).otherwise(1)
    return (
        texts.repartition("conv_id").sortWithinPartitions("conv_id", answer_first, "turn", "role", "digest")
        .select("conv_id", "turn", "role", "text", "copies", *_FACTS).mapInArrow(_repaired, REPAIRED)
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in _FACTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, digest, some = None, None, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["place"] == 0:
                if now:
                    out.append(now | {"repaired_sha256": digest.hexdigest()})
                now, digest, some = {"conv_id": r["conv_id"], "audit": r["text"]} | {n: r[n] for n in _FACTS}, hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) * some}{r['role']}:{r['text']}".encode())
                some = True
        yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([now | {"repaired_sha256": digest.hexdigest()}], schema)


def repair_digests(repaired: DataFrame) -> DataFrame:
    """What ``repair`` returned, as it returned it, to a row for each conversation: the repaired ``role:text``
    are hashed one after another, joined by newlines, so a conversation of any length needs no memory."""
    return repaired.mapInArrow(_digests, "conv_id long, " + ", ".join(f"{n} long" for n in _FACTS) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (0 copies), 1 empties the text,
    2 takes its ``.!?`` away, 3 repeats the row (2 copies), 4 makes the role user.  Nulls count as one space."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
