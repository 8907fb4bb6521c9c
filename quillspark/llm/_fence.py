"""A mark that keeps costly columns from being computed twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fenced(condition: Column) -> Column:
    """The condition, in a form that the optimiser leaves in its own projection.

    A filter over a computed column is otherwise pushed below the projection by
    copying the column's whole expression into the filter, and nested array
    expressions multiply with each copy.  Partition ids are never negative.
    """
    return condition & (F.spark_partition_id() >= 0)
