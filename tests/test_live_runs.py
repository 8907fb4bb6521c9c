"""Streams of runs and requests against the same rows in a batch, with restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.operators.telemetry import MS, TOKENS, budget_running
from quillspark.sources.tables import trace
from quillspark.streaming import runs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENT = "run long, loop long, event_id long, ts timestamp, tokens long, latency_ms long, dollars double"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(runs.ROCKS[0])
    spark.conf.set(*runs.ROCKS)
    yield
    spark.conf.set(runs.ROCKS[0], old)


def fed(spark, batches, schema, folder, make, restart_after=None):
    """Runs a query over batches of files one by one, in a new query from the checkpoint after some of them."""
    source, sink, mark = f"{folder}/in", f"{folder}/out", f"{folder}/mark"
    (folder / "in").mkdir(exist_ok=True)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if restart_after is None or k in restart_after or k == len(batches) - 1:
            stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
            query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(sink).collect()


def test_live_budgets_equal_the_batch(spark, sf, tmp_path, rocks):
    rows = trace(spark, sf).select("run", "loop", "event_id", F.col("ts").cast("timestamp").alias("ts"), "tokens", "latency_ms", F.lit(0.01).alias("dollars")).orderBy("ts", "event_id").collect()
    rows = [tuple(r) for r in rows]
    cut = len(rows) // 4
    got = fed(spark, [rows[i : i + cut] for i in range(0, len(rows), cut)], EVENT, tmp_path, lambda e: runs.live_budgets(e, TOKENS, MS, idle_ms=10**12), restart_after={0, 2})
    want = {(r.run, r.loop, r.seq): (r.tokens_left, r.ms_left) for r in budget_running(spark, sf).collect()}
    assert {(r.run, r.loop, r.seq): (r.tokens_left, r.ms_left) for r in got} == want and len(got) == len(want)
    assert all(abs(r.dollars_left - (1 - 0.01 * r.seq)) < 1e-9 and r.late == 0 and not r.closed for r in got)


def test_idle_runs_are_closed_and_late_events_counted(spark, tmp_path, rocks):
    at = lambda m: START + timedelta(minutes=m)
    first = [(1, 0, 1, at(0), 10, 1, 0.0), (1, 0, 2, at(1), 200, 1, 2.0), (2, 0, 3, at(1), None, None, None)]
    second = [(1, 0, 5, at(0.5), 5, 1, 0.0), (2, 1, 6, at(30), 1, 1, 0.5)]
    third = [(3, 0, 7, at(300), 1, 1, 0.0)]
    got = fed(spark, [first, second, third, [(3, 0, 8, at(301), 1, 1, 0.0)]], EVENT, tmp_path, lambda e: runs.live_budgets(e, 100, 100, idle_ms=60_000 * 60, late="60 minutes"), restart_after={0, 1, 2})
    rows = [(r.run, r.loop, r.seq, r.tokens_left, r.dollars_left, r.late) for r in got if not r.closed]
    assert sorted(rows) == [(1, 0, 1, 90, 1.0, 0), (1, 0, 2, 0, 0.0, 0), (1, 0, 3, 0, 0.0, 1), (2, 0, 1, 100, 1.0, 0), (2, 1, 1, 99, 0.5, 0), (3, 0, 1, 99, 1.0, 0), (3, 0, 2, 98, 1.0, 0)]
    assert sorted((r.run, r.loop, r.seq) for r in got if r.closed) == [(1, 0, 3), (2, 1, 1)]


CALL = "kind string, id string, method string, ts timestamp, error string, result string"


def test_requests_and_answers_of_a_stream(spark, tmp_path):
    """Shuffled arrival, an answer before its request, doubles of an id far apart, a restart: as the same join over tables."""
    r = random.Random(2)
    calls = []
    for k in range(200):
        t = START + timedelta(seconds=3 * k)
        calls.append(("q", f"i{k}" if k % 17 else None, "callTool", t, None, None))
        if k % 5:
            wait = r.choice([0, 1, 9.9, 10, 10.1, 25])
            calls.append(("a", f"i{k}", None, t + timedelta(seconds=wait), "bad" if k % 7 == 0 else None, None if k % 3 == 0 else "{}"))
    calls += [("a", "unasked", None, START, None, "{}"), ("q", "i3", "callTool", START + timedelta(seconds=900), None, None)]
    calls.sort(key=lambda c: c[3] + timedelta(seconds=r.uniform(0, 20)))
    calls.append(("q", "last", "close", START + timedelta(hours=2), None, None))
    calls.append(("a", "last", None, START + timedelta(hours=2), None, "{}"))
    batches = [calls[:-2][i : i + 90] for i in range(0, len(calls) - 2, 90)] + [calls[-2:], [("q", "end", "close", START + timedelta(hours=4), None, None), ("a", "end", None, START + timedelta(hours=4), None, "{}")]]
    make = lambda c: runs.answered(c.where("kind = 'q'"), c.where("kind = 'a'"))
    got = fed(spark, batches, CALL, tmp_path, make, restart_after={1, 3, len(batches) - 2})
    want = make(spark.createDataFrame(calls, CALL)).collect()
    key = lambda x: (x.id or "", x.asked_at, str(x.answered_at), x.outcome)
    assert sorted(key(x) for x in got if x.id != "end") == sorted(map(key, want))
    assert {x.outcome for x in want} == {"ok", "error", "no_result", "timeout"}
