"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Parts into which the links of one node are dealt, whatever their number.
SALTS = 16


def with_smallest(links: DataFrame) -> DataFrame:
    """(u, v) links with ``m``, the smallest v of each u; the links of a hub are dealt to ``SALTS`` tasks."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) links to (node, component), the smallest id reachable.

    Each round points every neighbour at the smallest id in reach, so long
    chains shrink geometrically; a round is two aggregations and two joins on
    the links, none of which gathers a node's neighbours in one place.  Nodes
    without a link have no row.
    """
    e, path = scratch.table(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if now.n == 0 or now == before:
            break
        before = now
        both = with_smallest(e.union(e.select("v", "u")))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_smallest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct()
        e, new = scratch.table(small)
        scratch.drop(path)
        path = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
