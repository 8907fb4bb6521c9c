"""Traces scanned in splits, and tables replaced as a whole."""

import json
import random

import pytest

from quillspark.operators import telemetry
from quillspark.sources import traces, versions


@pytest.fixture
def trace_files(tmp_path):
    """Three traces with blank lines, broken lines, ties, missing times and other line ends."""
    r = random.Random(5)
    out = {}
    for name, end in (("a", "\n"), ("b", "\n"), ("c", "\r\n")):
        lines = []
        for k in range({"a": 3000, "b": 40, "c": 700}[name]):
            event = {"phase": r.choice(["plan", "act"]), "method": f"m{k}", "latency_ms": k % 50, "payload": {"results": "x" * r.randint(0, 60)}}
            if r.random() < 0.5:
                event["timestamp"] = float(r.randint(0, 3000))
            lines.append("" if r.random() < 0.1 else " \t" if r.random() < 0.05 else "{broken" if r.random() < 0.02 else json.dumps(event))
        (tmp_path / f"{name}.jsonl").write_bytes(end.join(lines).encode() + (b"" if name == "b" else end.encode()))
        out[name] = lines
    return tmp_path, out


@pytest.mark.parametrize("split", [500, 4096, 1 << 26])
def test_a_split_scan_equals_the_whole_file(spark, trace_files, split):
    folder, files = trace_files
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in old:
        spark.conf.set(c, str(split))
    try:
        lines = traces.numbered_lines(spark, f"{folder}/*.jsonl")
        if split == 500:
            assert lines.rdd.getNumPartitions() > 100
        got = sorted((r.path[-7], r.line_no, r.raw) for r in lines.collect())
        assert got == sorted((n, k, x) for n, ls in files.items() for k, x in enumerate(ls))
        found = traces.read_trace(spark, f"{folder}/*.jsonl").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want = []
    for name, ls in files.items():
        events = []
        for k, x in enumerate(ls):
            if x.strip():
                e = json.loads(x) if x != "{broken" else {}
                events.append((e.get("timestamp", float(k)), k, e.get("method", "unknown")))
        want += [(name, i, *e) for i, e in enumerate(sorted(events))]
    assert sorted((r.path[-7], r.idx, r.timestamp, r.line_no, r.method) for r in found) == sorted(want)


def test_traces_of_runs_are_appended_and_empty_ones_read(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("")
    assert traces.read_trace(spark, f"{tmp_path}/none.jsonl").count() == 0
    event = spark.createDataFrame([("r1", "act", None), ("r2", "act", 5.0), ("r1", "plan", 7.0)], "run_id string, phase string, timestamp double")
    for _ in range(2):
        traces.append_runs(event, f"{tmp_path}/runs")
    assert spark.read.json(traces.rotated(f"{tmp_path}/runs", "r1")).count() == 4
    assert traces.read_trace(spark, traces.rotated(f"{tmp_path}/runs", "r2")).where("timestamp = 5").count() == 2


def test_replay_lines(spark):
    rows = [(1, 0, "plan", "m", "ok", 5, '{"plan": ["a", 1], "other": 2}'), (1, 999, "act", "t", "error", 0, '{"delta": null, "errors": "no"}'), (2, 11, "learn", "x", "ok", 7, None)]
    df = spark.createDataFrame(rows, "trace long, idx long, phase string, method string, status string, latency_ms int, payload string")
    got = {r.idx: r.lines for r in telemetry.replayed(df).collect()}
    assert got == {0: ["[001] plan :: m :: ok :: 5ms", '      plan: ["a",1]'], 999: ["[1000] act :: t :: error :: 0ms", "      errors: no", "      delta: null"], 11: ["[012] learn :: x :: ok :: 7ms"]}


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["stage", "prepare", "publish"])
@pytest.mark.parametrize("after", [False, True])
def test_a_writer_that_dies_leaves_the_old_or_the_new_version(spark, tmp_path, monkeypatch, step, after):
    path = f"file://{tmp_path}/t"
    versions.replace_table(spark.range(3), path, "one")
    table = versions.Versions(spark, path)
    own = getattr(versions.Versions, step)

    def dies(self, *args):
        if after:
            own(self, *args)
        raise Killed

    monkeypatch.setattr(versions.Versions, step, dies)
    with pytest.raises(Killed):
        table.replace(spark.range(8), "two")
    monkeypatch.undo()
    done = step == "publish" and after
    assert versions.read_table(spark, path).count() == (8 if done else 3)
    assert versions.replace_table(spark.range(5), path, "three") == (3 if done else 2)
    assert versions.read_table(spark, path).count() == 5
    assert versions.read_table(spark, path, run_id="one").count() == 3 and versions.read_table(spark, path, version=1).count() == 3
    versions.Versions(spark, path).expire(1)
    assert versions.read_table(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, path, run_id="one")


def test_of_two_writers_one_wins(spark, tmp_path):
    table = versions.Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    first, second = (table.prepare(table.stage(spark.range(n))) for n in (2, 4))
    table.publish(*first)
    with pytest.raises(RuntimeError):
        table.publish(*second)
    assert table.read().count() == 2 and len(table.commits()) == 1
