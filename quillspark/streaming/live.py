"""Budgets and counts over a stream of events; batch and stream give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet event files as they arrive; times are read as UTC."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by day and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def running_budgets(events: DataFrame, tokens: int, ms: int) -> DataFrame:
    """(user_id, events, tokens_left, ms_left): what each run has left, kept as state between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, t, m = state.get if state.exists else (0, tokens, ms)
        for f in frames:
            n, t, m = n + len(f), t - int(f.used.sum()), m - int(f.took.sum())
        state.update((n, t, m))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "tokens_left": [max(0, t)], "ms_left": [max(0, m)]})

    rows = events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("used"), F.floor("value").cast("long").alias("took"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, events long, tokens_left long, ms_left long", "n long, t long, m long", "update", GroupStateTimeout.NoTimeout)
