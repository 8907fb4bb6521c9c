"""JSONL traces: a scan that splits large files and still knows physical lines, appends, and runs as partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.order import numbered

TRACE_SCHEMA = "correlation_id string, loop_id string, phase string, method string, status string, latency_ms int, budget struct<tokens int, ms int, dollars double>, payload string, timestamp double"
#: Rows of the table of splits that may be sent to every task.
SEND_ROWS = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, raw): every line of text files with its number in its file, from 0, blank lines included.

    Spark splits the files (``spark.sql.files.maxPartitionBytes``); a split is
    read in order by one task.  Lines are counted by split, and a split's first
    number is the sum of the counts of those before it in its file: one row a
    split is gathered by file, never lines.  Both passes plan the same splits.
    A compressed file is one split.  No file gives no rows.
    """
    own = F.col("_metadata")
    lines = spark.read.text(path).select(own["file_path"].alias("path"), own["file_block_start"].alias("start"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("m"))
    by = lines.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = by.select("path", "start", (before - F.col("first")).alias("shift"))
    splits = F.broadcast(splits) if splits.count() <= SEND_ROWS else splits
    return lines.join(splits, ["path", "start"]).select("path", (F.col("m") + F.col("shift")).alias("line_no"), "raw")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSONL traces: path, line_no, the event's fields, and ``idx``, its place in its trace by time, from 0.

    Blank lines are skipped but keep their number.  Missing fields get defaults;
    a missing time is the line's number; lines decide ties.  A file is a trace.
    A line that is no JSON object has defaults only.
    """
    rows = numbered_lines(spark, path).where(F.trim(F.regexp_replace("raw", r"\s", " ")) != "").select("path", "line_no", F.from_json("raw", TRACE_SCHEMA).alias("e")).select("path", "line_no", "e.*")
    unknown = {c: F.coalesce(c, F.lit("unknown")) for c in ("correlation_id", "loop_id", "phase", "method", "status")}
    rows = rows.withColumns(unknown | {"latency_ms": F.coalesce("latency_ms", F.lit(0)), "payload": F.coalesce("payload", F.lit("{}")), "timestamp": F.coalesce("timestamp", F.col("line_no").cast("double"))})
    placed = numbered(rows, [F.col("path"), F.col("timestamp"), F.col("line_no")], "_at")
    first = placed.groupBy("path").agg(F.min("_at").alias("_first"))  # a row a file
    first = F.broadcast(first) if first.count() <= SEND_ROWS else first
    return placed.join(first, "path").withColumn("idx", F.col("_at") - F.col("_first")).drop("_at", "_first")


def append_trace(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines, each with the time of writing where it has none."""
    events.withColumn("timestamp", F.coalesce("timestamp", F.unix_micros(F.current_timestamp()) / 1e6)).write.mode("append").json(path)


def append_runs(events: DataFrame, path: str, run: str = "run_id") -> None:
    """Appends events of many runs, each to the folder of its run."""
    events.withColumn("timestamp", F.coalesce("timestamp", F.unix_micros(F.current_timestamp()) / 1e6)).write.mode("append").partitionBy(run).json(path)


def rotated(path: str, run_id: str) -> str:
    """The folder of one run's trace."""
    return f"{path.rstrip('/')}/run_id={run_id}"
