"""A gate that holds a message's tokens until its verdict, as a stateful stream and as a batch.

Generation and judgement run side by side.  Until the verdict nothing of a message is shown; one that
is refused shows nothing ever, however long it goes on; one whose verdict does not come in time is shown.
A message that falls silent, or ends without its closing mark, ends with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.filters import milliseconds

#: Rows of a message: token (seq, text), verdict (allowed), done, or end: the connection has gone.
EVENTS = "message_id string, kind string, seq long, text string, allowed boolean"
SHOWN = "message_id string, seq long, text string, error string"

UNDECIDED, OPEN, REFUSED = "undecided", "open", "refused"
_STATUS = "verdict string, ending string, deadline long, idle long, closed boolean"


class Gate(StatefulProcessor):
    """One message: a list of held tokens, a status that is forgotten some time after the last row, and two timers."""

    def __init__(self, within_ms: int, idle_ms: int, remember_ms: int):
        self.within, self.idle, self.remember = within_ms, idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq long, text string", ttlDurationMs=self.remember)
        self.status = handle.getValueState("status", _STATUS, ttlDurationMs=self.remember)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        verdict, ending, deadline, idle, closed = self.status.get() if self.status.exists() else (UNDECIDED, None, None, None, False)
        rows = list(rows)
        if closed:
            return
        tokens = sorted((r.seq, r.text) for r in rows if r.kind == "token")
        kinds = {r.kind for r in rows}
        said = [r.allowed for r in rows if r.kind == "verdict"]
        ending = "done" if "done" in kinds or ending == "done" else "ended" if "end" in kinds else ending
        if verdict == UNDECIDED and said:
            verdict = OPEN if all(a is not False for a in said) else REFUSED
        if verdict == UNDECIDED:
            self.held.appendList(tokens)
            if deadline is None:
                deadline = now + self.within
                self.handle.registerTimer(deadline)
        else:
            yield from self._decided(key, verdict, tokens)
        if idle is not None:
            self.handle.deleteTimer(idle)
        idle = now + self.idle + (deadline == now + self.idle)  # never the same timer
        if verdict != UNDECIDED and ending:
            yield from self._close(key, verdict, None if ending == "done" else ending, deadline, None)
            return
        self.handle.registerTimer(idle)
        self.status.update((verdict, ending, deadline, idle, False))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.status.exists():
            return
        verdict, ending, deadline, idle, closed = self.status.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if closed or at not in (deadline, idle):
            return
        if verdict == UNDECIDED:
            verdict = OPEN
            yield from self._decided(key, verdict, [])
        if at == idle or ending:
            error = None if ending == "done" else ending or "idle"
            yield from self._close(key, verdict, error, None if at == deadline else deadline, None if at == idle else idle)
        else:
            self.status.update((verdict, ending, None, idle, False))

    def _decided(self, key: Any, verdict: str, tokens: list) -> Iterator[Row]:
        """What was held and what has come, if the verdict lets it through; nothing is held any more."""
        if verdict == OPEN:
            for seq, text in (*sorted(self.held.get() if self.held.exists() else ()), *tokens):
                yield Row(message_id=key[0], seq=seq, text=text, error=None)
        self.held.clear()

    def _close(self, key: Any, verdict: str, error: str | None, *timers: int | None) -> Iterator[Row]:
        for timer in timers:
            if timer is not None:
                self.handle.deleteTimer(timer)
        if error and verdict == OPEN:
            yield Row(message_id=key[0], seq=None, text=None, error=error)
        self.status.update((verdict, None, None, None, True))


def gated(events: DataFrame, within: str = "8 seconds", idle: str = "60 seconds", remember: str = "1 hour") -> DataFrame:
    """What a stream of messages' rows (``EVENTS``) shows: ``SHOWN``, of which ``error`` is for a row that ends a message.

    The verdict that comes first counts, of several in one batch a refusal; one that is null or comes after
    ``within`` lets the message through.  'ended' is a connection that has gone without a done mark, 'idle' one
    that said nothing for ``idle``.  A closed message is remembered for ``remember`` after its last row, so that late
    rows of it show nothing.  State is kept in RocksDB, which the session is set to."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gate = Gate(milliseconds(within), milliseconds(idle), milliseconds(remember))
    return events.groupBy("message_id").transformWithState(gate, SHOWN, "append", "processingTime")


def released(tokens: DataFrame, verdicts: DataFrame, within: str = "8 seconds") -> DataFrame:
    """The batch form over logs: tokens (message_id, seq, text, ts) whose message is not refused by its first verdict
    (message_id, allowed, ts), unless that came more than ``within`` after the message's first token.

    Of verdicts at one time a refusal counts; a null one lets through.  A refused message has none of its tokens."""
    started = tokens.groupBy("message_id").agg(F.min("ts").alias("started"))
    first = verdicts.groupBy("message_id").agg(F.min(F.struct("ts", F.coalesce("allowed", F.lit(True)).alias("allowed"))).alias("first"))
    late = F.col("first.ts") > F.col("started") + F.expr(f"INTERVAL {within}")
    refused = started.join(first.filter("not first.allowed"), "message_id").filter(~late)
    return tokens.join(refused.select("message_id"), "message_id", "left_anti").select("message_id", "seq", "text", "ts")


def endings(rows: DataFrame, idle: str = "60 seconds") -> DataFrame:
    """(message_id, n_shown, ending, at) of logs (message_id, kind, ts): a message ends with its done mark, with 'idle'
    as soon as nothing comes for longer than ``idle``, or with 'ended' at its last row; tokens after the end are not shown."""
    own = Window.partitionBy("message_id").orderBy("ts", F.col("kind") == "done")
    quiet = F.coalesce(F.lag("ts").over(own) + F.expr(f"INTERVAL {idle}") < F.col("ts"), F.lit(False))
    marked = rows.withColumn("quiet", quiet).withColumn("over", (F.col("kind") == "done") | F.col("quiet")).withColumn("before", F.coalesce(F.sum(F.col("over").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    live = marked.filter("before = 0")
    ended = F.max(F.when(F.col("quiet"), "idle").when(F.col("kind") == "done", "done"))
    last = F.max(F.when(~F.col("quiet"), F.col("ts")))
    out = live.groupBy("message_id").agg(F.count_if((F.col("kind") == "token") & ~F.col("quiet")).alias("n_shown"), ended.alias("ending"), last.alias("last"))
    at = F.when(F.col("ending") == "idle", F.col("last") + F.expr(f"INTERVAL {idle}")).otherwise(F.col("last"))
    return out.select("message_id", "n_shown", F.coalesce("ending", F.lit("ended")).alias("ending"), at.alias("at"))
