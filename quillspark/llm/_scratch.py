"""Written tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own.

    Only a local master may fall back to a machine-local folder; on a cluster
    an unset folder is an error, for executors would not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables under one fresh folder of :func:`shared_dir`.

    A table survives the loss of any executor and its plan starts from files,
    so nothing upstream is computed again.  ``drop`` removes a table that no
    later plan reads; tables that a returned DataFrame reads stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def save(self, df: DataFrame) -> DataFrame:
        return self.table(df)[0]

    def drop(self, *paths: str) -> None:
        for path in paths:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(jpath, True)
