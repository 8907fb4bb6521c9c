"""What a session needs before Python runs on its workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Rows of one Arrow batch; the default of 10,000 long texts would be held by the executor and by its worker.
ARROW, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ready(spark: SparkSession) -> SparkSession:
    """Lets workers import the package, and bounds what they are sent at once.

    Workers that see this machine's files import it from where the driver did.

    On a cluster without such a shared folder the package is installed or sent
    with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    if spark.conf.get(ARROW) == "10000":
        spark.conf.set(ARROW, ROWS)
    return spark
