"""Live traces: budgets of runs as they are spent, and requests matched with their answers.

``live_budgets`` keeps one value a run: its loop, what the loop has left, the
time of its last event.  A new loop starts from the full budget; nothing falls
below zero.  A run that has been idle for a stated time, by the events' own
clock, is closed: a last row says so and its state is gone.  An event that
comes after a later one of its run is charged to the loop that is open, unless
it names a loop, and counted as late; what the watermark has passed is dropped
by Spark and counted in its progress.

``answered`` joins two streams within an interval.  Every request comes out
once: with its answer, or, when the watermark says that none can come in time,
as a timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "loop long, seq long, tokens long, ms long, dollars double, last long, late long"
BUDGETS = "run long, loop long, seq long, tokens_left long, ms_left long, dollars_left double, late long, closed boolean"


class RunBudget(StatefulProcessor):
    """Budget left after each event of a run: reset by a new loop, closed after ``idle_ms`` without an event."""

    def __init__(self, tokens: int, ms: int, dollars: float, idle_ms: int):
        self.limits, self.idle_ms = (tokens, ms, dollars), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts_ms", "event_id"])
        held = self.left.get() if self.left.exists() else None
        loop, seq, tokens, ms, dollars, last, late = held or (None, 0, *self.limits, -1, 0)
        out = []
        for e in events.itertuples():
            if loop is None or e.loop != loop:
                loop, seq, (tokens, ms, dollars) = e.loop, 0, self.limits
            late += e.ts_ms < last
            seq, last = seq + 1, max(last, e.ts_ms)
            tokens, ms, dollars = max(0, tokens - e.tokens), max(0, ms - e.latency_ms), max(0.0, dollars - e.dollars)
            out.append((key[0], loop, seq, tokens, ms, dollars, late, False))
        self.left.update((int(loop), int(seq), int(tokens), int(ms), float(dollars), int(last), int(late)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(last) + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BUDGETS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        loop, seq, tokens, ms, dollars, _, late = self.left.get()
        self.left.clear()
        yield pd.DataFrame([(key[0], loop, seq, tokens, ms, dollars, late, True)], columns=[c.split()[0] for c in BUDGETS.split(", ")])

    def close(self) -> None:
        pass


def live_budgets(events: DataFrame, tokens: int, ms: int, dollars: float = 1.0, idle_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """A row for every event of a stream (run, loop, event_id, ts, tokens, latency_ms, dollars) with what is left after it, and one for every run that is closed."""
    rows = events.withWatermark("ts", late).select(
        "run", "loop", "event_id", "ts", F.unix_millis("ts").alias("ts_ms"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), F.coalesce("dollars", F.lit(0.0)).alias("dollars")
    )
    return rows.groupBy("run").transformWithStateInPandas(RunBudget(tokens, ms, dollars, idle_ms), BUDGETS, "Append", "EventTime")


def answered(requests: DataFrame, answers: DataFrame, within: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """(id, method, asked_at, answered_at, outcome) of every request (id, method, ts) of a stream.

    An answer (id, ts, error, result) belongs to the request of its id that it
    follows within the time.  Outcomes: ``ok``, ``error`` (it names one),
    ``no_result`` (neither), ``timeout``.  A request without an id can have no
    answer; an answer without a request comes out nowhere.  Works on tables too.
    """
    asked = requests.select("id", "method", F.col("ts").alias("asked_at")).withWatermark("asked_at", late)
    given = answers.select(F.col("id").alias("_id"), F.col("ts").alias("answered_at"), "error", "result").withWatermark("answered_at", late)
    match = (F.col("id") == F.col("_id")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    outcome = F.when(F.col("answered_at").isNull(), "timeout").when(F.col("error").isNotNull(), "error").when(F.col("result").isNull(), "no_result").otherwise("ok")
    return asked.join(given, match, "left").select("id", "method", "asked_at", "answered_at", outcome.alias("outcome"))
