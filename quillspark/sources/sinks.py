"""Corpus and trace sources, and sinks that commit as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see; a folder of our own only where a local session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """The rows as a written table, read again."""
    path = f"{shared_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str, expected_sha256: str | None = None) -> DataFrame:
    """Whole files as (path, text, sha256); reading a file with another digest than the stated one fails."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
    if expected_sha256 is None:
        return rows
    ok = F.when(F.col("sha256") == expected_sha256, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("path"))))
    return rows.where(ok)


def read_split(spark: SparkSession, path: str, corpus_sha256: str) -> DataFrame:
    """(id, split) of a split manifest made for one corpus; reading one that was made for another fails."""
    rows = read_manifest(spark, path, "corpus_sha256 string, documents array<struct<id: string, split: string>>")
    ok = F.when(F.col("corpus_sha256") == corpus_sha256, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("made for corpus "), F.coalesce("corpus_sha256", F.lit("?")))))
    return rows.where(ok).select(F.inline("documents"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document over several lines, by a stated schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_results(rows: DataFrame, path: str) -> None:
    """All columns of each row as one JSON text; the write becomes visible as a whole."""
    rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table (a report: at most ``limit`` rows)."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect())])
