"""Reading tables, and the views that stand for a document study and for an event trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, meeting_id, genre, meeting_date, body: two documents of one meeting share its date."""
    meeting = F.expr("doc_id div 2")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        meeting.alias("meeting_id"),
        F.when(F.col("doc_id") % 2 == 0, "statement").otherwise("minutes").alias("genre"),
        F.date_add(F.lit("2015-01-01").cast("date"), (meeting * 37 % 4000).cast("int")).alias("meeting_date"),
        F.col("text").alias("body"),
    )


DOCS = """docs as (select doc_id, doc_id // 2 as meeting_id, case when doc_id % 2 = 0 then 'statement' else 'minutes' end as genre,
  date '2015-01-01' + ((doc_id // 2) * 37 % 4000)::int as meeting_date, text as body from documents)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, loop, seq (from 1 inside a loop), phase, status, latency_ms, tokens: seven events of a user make a loop."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nth = F.row_number().over(order) - 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        nth.alias("n"),
        "event_id",
        "ts",
        F.col("event_type").alias("phase"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.floor("value").cast("long").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    ).select("*", F.expr("n div 7").alias("loop"), (F.col("n") % 7 + 1).alias("seq")).drop("n")


TRACE = """numbered as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events),
trace as (select user_id as run, n // 7 as loop, n % 7 + 1 as seq, event_id, ts, event_type as phase, case when event_type = 'error' then 'error' else 'ok' end as status,
  floor(value)::bigint as latency_ms, (props->>'$.k')::bigint as tokens from numbered)"""
