"""Row numbers over whole tables without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.sinks import shared_table

#: Bits of the place inside a partition in Spark's monotonically increasing ids.
PLACE = 33


def numbered(df: DataFrame, order: list[Column], name: str, save: Callable[[DataFrame], DataFrame] = shared_table) -> DataFrame:
    """``df`` in a written table, with the place of each row in ``order`` from 1.

    Rows are dealt by ranges of the order and sorted there, so a large group
    spreads over many tasks; rows equal in all of ``order`` are dealt by their
    place in the input.  One count a partition gives each its first number.
    """
    tie = F.col("_numbered_tie")
    rows = df.withColumn("_numbered_tie", F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    rows = save(rows.drop("_numbered_tie").withColumn("_numbered_at", F.monotonically_increasing_id()))
    part = F.shiftright("_numbered_at", PLACE)
    counts = rows.groupBy(part.alias("_numbered_part")).agg(F.count("*").alias("n")).orderBy("_numbered_part").collect()  # a row a partition
    first, starts = 1, []
    for r in counts:
        starts.append((r["_numbered_part"], first))
        first += r.n
    starts = df.sparkSession.createDataFrame(starts, "_numbered_part long, _numbered_first long")
    out = rows.withColumn("_numbered_part", part).join(F.broadcast(starts), "_numbered_part")
    return out.withColumn(name, F.col("_numbered_first") + F.col("_numbered_at") % (1 << PLACE)).drop("_numbered_part", "_numbered_first", "_numbered_at")
