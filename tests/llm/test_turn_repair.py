"""Conversation structure repair against a search over states, and its algebra."""

from __future__ import annotations

import hashlib
import random
import re
from heapq import heappop, heappush

import pytest

from lodestone.llm import turnrepair
from lodestone.llm.tables import Scratch
from lodestone.llm.turnrepair import IDENTITY, answer, times, tree, turn_matrix, turns_matrix


def cheapest(turns, most=2):
    """Least (cost, audit) by trying edits in order of cost; turns are (role, text, must go, truncated)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(turns) and state in ("", "a"):
            # a dearer-looking order of equal cost would have been popped first: the heap is ordered by cost, then audit
            return cost, audit, out
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in after[state]:
                heappush(heap, (cost + 2, audit + "I", i, after[state][r], (*out, (name, ""))))
        if i < len(turns):
            role, text, gone, truncated = turns[i]
            heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if not gone:
                if role[:1] in after[state]:
                    heappush(heap, (cost + truncated, audit + "K", i + 1, after[state][role[0]], (*out, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in after[state]:
                        heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, after[state][r], (*out, (name, text))))
    raise AssertionError


def by_loops(rows):
    """Rows (conv, turn, role, text) to what repair_digests returns, by conversation."""
    out, by = {}, {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        by.setdefault(c, []).append((t, r, x))
    for c, own in by.items():
        own.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.sha256(f"{len(y[1])}:{y[1]}{y[2]}".encode()).hexdigest()))
        seen, turns, facts = set(), [], [0, 0, 0]
        for _, r, x in own:
            bare = x.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = 0 if not bare else 1 if (r, x) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                facts[fault] += 1
            turns.append((r, x, fault in (0, 1), int(fault == 2)))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(turns)
        out[c] = (gaps, *facts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def strange_rows(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for _ in range(rng.choice((1, 2, 3, 5, 8, 30))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Ü"])
            text = rng.choice(["Yes.", "No", "What?  ", None, "", " \t\n", "ünd.\x0b", "a\nb!", f"t{rng.random()}."])
            rows += [(c, rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), role, text)] * rng.choice((1, 1, 1, 2))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("segment_rows", "fan_in"), [(4096, 64), (3, 2), (1, 3)])
def test_repair_is_the_cheapest(spark, segment_rows, fan_in):
    rows = strange_rows(5)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, cost int").repartition(3)
    scratch = Scratch(spark, "repair-test")
    got = {r[0]: tuple(r)[1:] for r in turnrepair.repair_digests(turnrepair.repair(frame, scratch, segment_rows, fan_in)).collect()}
    scratch.clear()
    assert got == by_loops(rows)


def test_products_are_associative_and_keep_the_least_audit():
    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(rng.choice("suaxSUAXD") for _ in range(rng.randint(0, 9)))
        turns = [(c.lower() if c != "D" else "u", "x", c == "D", int(c.isupper() and c != "D")) for c in codes]
        one = IDENTITY
        for c in codes:
            one = times(one, turn_matrix(c))
        cut = rng.randint(0, len(codes))
        assert one == turns_matrix(codes) == tree([turn_matrix(c) for c in codes]) == times(turns_matrix(codes[:cut]), turns_matrix(codes[cut:]))
        assert answer(one) == cheapest(turns)[:2]


def test_audits_give_lawful_roles_and_the_turns_themselves(spark):
    frame = spark.createDataFrame(strange_rows(8, 10), SCHEMA)
    repaired = turnrepair.repair(frame, Scratch(spark, "repair-test")).collect()
    audits = {r.conv_id: r.text for r in repaired if r.place == 0}
    for c, audit in audits.items():
        own = sorted((r for r in repaired if r.conv_id == c and r.place), key=lambda r: r.place)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert "".join(r.edit for r in own) == audit.replace("D", "")


def test_a_long_conversation_of_many_segments(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(600)] + [(7, 5, "user", "again.")] * 300
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    (got,) = turnrepair.repair_digests(turnrepair.repair(frame, Scratch(spark, "repair-test"), 64, 4)).collect()
    assert (got.duplicate, got.illegal, got.gaps) == (299, 300, 0)
    assert tuple(got)[1:] == by_loops(rows)[7]


def test_empty_table_dropped_rows_and_damage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turnrepair.repair_digests(turnrepair.repair(turnrepair.damaged(empty), Scratch(spark, "repair-test"))).collect() == []
    gone = spark.createDataFrame([(1, 0, "user", "x.", 0), (None, None, None, None, 0)], SCHEMA + ", copies long")
    got = sorted(map(tuple, turnrepair.repair_digests(turnrepair.repair(gone, Scratch(spark, "repair-test"))).collect()), key=str)
    assert [g[1:] for g in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2
    damaged = turnrepair.damaged(spark.createDataFrame([(None, None, None, None)], SCHEMA)).collect()
    assert damaged[0].text in (" ", "") and damaged[0].role in (" ", "user")
