"""The gate: any interleaving of tokens, verdict, marks and time against what the logs say, and a stream that is run."""

from __future__ import annotations

import time
from collections import namedtuple
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.streaming import gate

Event = namedtuple("Event", "kind seq text allowed", defaults=(None, None, None))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Items(Value):
    def get(self):
        return iter(self.value or ())

    def appendList(self, values):  # noqa: N802
        self.value = [*(self.value or ()), *values]

    def clear(self):
        self.value = None


class Handle:
    """State and timers of one message, in memory."""

    def __init__(self):
        self.timers = set()

    def getListState(self, *_, **__):  # noqa: N802
        return Items()

    def getValueState(self, *_, **__):  # noqa: N802
        return Value()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


def run(batches, within=80, idle=200, end=10_000):
    """What the gate shows of batches (time, events), timers fired when they are due."""
    handle, g, out = Handle(), gate.Gate(within, idle, 10**9), []
    g.init(handle)

    def fire(until):
        while handle.timers and min(handle.timers) <= until:
            at = min(handle.timers)
            handle.timers.discard(at)
            out.extend((r.seq, r.text, r.error) for r in g.handleExpiredTimer(("m",), Clock(at), Clock(at)))

    for at, events in batches:
        fire(at - 1)
        out.extend((r.seq, r.text, r.error) for r in g.handleInputRows(("m",), iter(events), Clock(at)))
    fire(end)
    assert not handle.timers and not g.held.exists()
    return out


def expected(batches, within=80, idle=200):
    """By the rules: the first verdict in time decides; then what comes before the end, in order."""
    first, last, verdict, shown, ending, silent = batches[0][0], None, None, [], None, False
    for at, events in batches:
        if last is not None and at > last + idle:
            silent = True
            break
        last = at
        if verdict is None and at > first + within:  # its time was over before this batch
            verdict = True
            if ending:
                break
        said = [e.allowed for e in events if e.kind == "verdict"]
        if verdict is None and said and at <= first + within:
            verdict = all(a is not False for a in said)
        shown += sorted((e.seq, e.text, None) for e in events if e.kind == "token")
        kinds = {e.kind for e in events}
        ending = "done" if "done" in kinds or ending == "done" else "ended" if "end" in kinds else ending
        if ending and verdict is not None:
            break
    if verdict is False:
        return []
    return shown + ([] if ending == "done" else [(None, None, ending or "idle")])


@st.composite
def interleavings(draw):
    n = draw(st.integers(0, 8))
    events = [Event("token", i, f"t{i}") for i in range(n)]
    times = sorted(draw(st.lists(st.integers(0, 600), min_size=n, max_size=n)))
    marks = draw(st.lists(st.tuples(st.integers(0, 700), st.sampled_from([Event("verdict", allowed=True), Event("verdict", allowed=False), Event("verdict"), Event("done"), Event("end")])), max_size=3))
    batches = {}
    for at, e in [*zip(times, events), *marks]:
        batches.setdefault(at, []).append(e)
    for own in batches.values():
        order = draw(st.permutations(range(len(own))))
        own[:] = [own[i] for i in order]
    return sorted(batches.items()) or [(0, [Event("token", 0, "x")])]


@settings(max_examples=600, deadline=None)
@given(interleavings())
def test_any_interleaving(batches):
    assert run(batches) == expected(batches)


def test_a_refused_message_shows_nothing_however_long():
    tokens = [(i * 100, [Event("token", i, "x")]) for i in range(600)]
    assert run([(0, [Event("verdict", allowed=False)]), *tokens], end=10**6) == []
    assert len(run([(at + 90, e) for at, e in tokens] + [(60_100, [Event("verdict", allowed=False), Event("done")])], end=10**6)) == 600


def test_the_gate_as_a_stream(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    rows = [("a", "token", 0, "x", None), ("b", "token", 0, "y", None), ("a", "verdict", None, None, False), ("c", "token", 0, "z", None), ("b", "verdict", None, None, True), ("d", "token", 0, "w", None), ("d", "verdict", None, None, True), ("d", "done", None, None, None)]
    write = lambda own: spark.createDataFrame(own, gate.EVENTS).coalesce(1).write.mode("append").json(source)
    write(rows)
    stream = spark.readStream.schema(gate.EVENTS).json(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    q = gate.gated(stream, "2 seconds", "20 seconds").writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 120
        while time.time() < until and not spark.table("shown").filter("message_id = 'b' AND text = 'y'").count():
            time.sleep(0.3)
        write([("a", "token", 1, "never", None), ("b", "token", 1, "more", None), ("b", "done", None, None, None)])
        want = {("b", "y", None), ("b", "more", None), ("d", "w", None), ("c", "z", None), ("c", None, "idle")}
        while time.time() < until and {(r.message_id, r.text, r.error) for r in spark.table("shown").collect()} != want:
            time.sleep(0.3)
        assert sorted(map(str, ((r.message_id, r.text, r.error) for r in spark.table("shown").collect()))) == sorted(map(str, want))
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


T0 = datetime(2024, 1, 1)


def test_batch_forms(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    tokens = spark.createDataFrame([(m, i, f"{m}{i}", at(s)) for m in "abcde" for i, s in enumerate((1, 30, 61))], "message_id string, seq int, text string, ts timestamp")
    verdicts = spark.createDataFrame([("a", True, at(2)), ("b", False, at(2)), ("b", True, at(3)), ("c", False, at(20)), ("d", None, at(1)), ("e", True, at(5)), ("e", False, at(5)), ("z", False, at(0))], "message_id string, allowed boolean, ts timestamp")
    assert {r.message_id for r in gate.released(tokens, verdicts).collect()} == {"a", "c", "d"} and gate.released(tokens, verdicts).count() == 9
    rows = tokens.select("message_id", F.lit("token").alias("kind"), "ts").unionByName(spark.createDataFrame([("a", "done", at(62)), ("b", "done", at(20)), ("c", "done", at(300))], "message_id string, kind string, ts timestamp"))
    got = {r.message_id: (r.n_shown, r.ending, r.at) for r in gate.endings(rows).collect()}
    assert got == {"a": (3, "done", at(62)), "b": (1, "done", at(20)), "c": (3, "idle", at(121)), "d": (3, "ended", at(61)), "e": (3, "ended", at(61))}
    assert gate.released(tokens.limit(0), verdicts).count() == gate.endings(rows.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_the_stream_rules_are_the_batch_rules(spark, seed):
    """Logs as batches of one row: the gate shows the tokens that ``released`` lets through, where nothing is silent."""
    import random

    rng = random.Random(seed)
    tokens, verdicts, want = [], [], {}
    for m in range(30):
        times = sorted(rng.sample(range(0, 190), rng.randint(1, 6)))
        own = [(t, [Event("token", i, f"{m}.{i}")]) for i, t in enumerate(times)]
        tokens += [(str(m), i, f"{m}.{i}", T0 + timedelta(milliseconds=t)) for i, t in enumerate(times)]
        if rng.random() < 0.8:
            t, allowed = rng.randrange(times[0], 300), rng.random() < 0.4
            if t in times:
                continue
            own.append((t, [Event("verdict", allowed=allowed)]))
            verdicts.append((str(m), allowed, T0 + timedelta(milliseconds=t)))
        want[str(m)] = [text for _, text, error in run(sorted(own)) if error is None]
    t = spark.createDataFrame(tokens, "message_id string, seq int, text string, ts timestamp")
    v = spark.createDataFrame(verdicts, "message_id string, allowed boolean, ts timestamp")
    got = {}
    for r in gate.released(t, v, "80 milliseconds").orderBy("seq").collect():
        got.setdefault(r.message_id, []).append(r.text)
    assert {m: got.get(m, []) for m in want} == want
