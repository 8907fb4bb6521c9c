"""Offsets, samples and windows over token sequences, and schedules over steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.splits import MEETINGS, learnt, with_split
from quillspark.plans.registry import query
from quillspark.sources.tables import documents, table

PREFIX, BLOCK = 2, 64


def draw(*parts: Column, n: Column) -> Column:
    """A number below ``n`` from the hash of the parts: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") % n


def offsets(docs: DataFrame, length: Column, block: int) -> DataFrame:
    """Where each document starts in the concatenation of all, and how many windows it holds.

    Sums per block of ids come first, so the running sum over everything only
    sees one row for each block, and the one inside a block stays in its block.
    """
    rows = docs.select("doc_id", length.cast("long").alias("n")).withColumn("_b", F.expr("doc_id div 1024"))
    sums = rows.groupBy("_b").agg(F.sum("n").alias("s"))
    before = sums.select("_b", F.coalesce(F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("_b").orderBy("doc_id")) - F.col("n")
    return rows.withColumn("inner", inner).join(before, "_b").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n", F.greatest(F.col("n") - block, F.lit(0)).alias("n_starts"))


@query("doc_offsets", f"select doc_id, (sum(length(text)) over (order by doc_id) - length(text))::bigint as start, length(text) as n, greatest(length(text) - {BLOCK}, 0) as n_starts from documents")
def doc_offsets(spark, sf):
    return offsets(table(spark, sf, "documents"), F.length("text"), BLOCK)


@query(
    "sample_windows",
    f"""with o as (select doc_id, (sum(length(text)) over (order by doc_id) - length(text))::bigint as start, length(text) as n from documents where length(text) > {BLOCK}),
    t as (select sum(n)::bigint as total from o), d as (select i as draw, ('0x' || substr(md5('doc|' || i), 1, 8))::bigint % total as u from range(0, 500) r(i), t)
    select draw, doc_id, ('0x' || substr(md5('start|' || draw), 1, 8))::bigint % (n - {BLOCK}) as first from d join o on u >= start and u < start + n""",
)
def sample_windows(spark, sf):
    return sampled(table(spark, sf, "documents"), F.length("text"), BLOCK, 500)


def sampled(docs: DataFrame, length: Column, block: int, draws: int) -> DataFrame:
    """Windows of documents drawn with replacement in proportion to their length.

    A draw falls on a place of the concatenation.  Places and documents meet on
    a coarse grid cell, every document being listed in the cells that it covers,
    so the range condition is an equi-join with a filter.
    """
    spark = docs.sparkSession
    o = offsets(learnt(docs).where(length > block), length, block)
    total = o.agg(F.sum("n").alias("total"))
    at = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total))
    at = at.withColumn("u", draw(F.lit("doc"), F.col("draw"), n=F.col("total")))
    cell = 1 << 16
    cells = o.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {cell}"), F.expr(f"(start + n - 1) div {cell}"))))
    met = at.withColumn("cell", F.expr(f"u div {cell}")).join(cells, "cell").where("u >= start and u < start + n")
    return met.select("draw", "doc_id", draw(F.lit("start"), F.col("draw"), n=F.col("n") - block).alias("first"))


def stop_of(start: Column, n: str, stride: int) -> Column:
    return F.least(start + stride, F.col(n))


def plan(rows: DataFrame, n: str, block: int, stride: int | None = None, first: int = PREFIX) -> DataFrame:
    """Windows that score every target from ``first`` on exactly once, each with as much context as fits."""
    stride = stride or max(1, block // 2)
    if not 1 <= stride <= block or first < 1:
        raise ValueError("the stride must be in 1..block and the first target at least 1")
    rows = rows.where(F.col(n) > first).withColumn("start", F.explode(F.sequence(F.lit(first), F.col(n) - 1, F.lit(stride))))
    return rows.withColumn("stop", stop_of(F.col("start"), n, stride)).withColumn("context", F.greatest(F.lit(0), F.col("stop") - 1 - block))


PLAN = f"""plan as (select doc_id, n, start::int as start, least(start + {BLOCK // 2}, n)::int as stop, greatest(0, least(start + {BLOCK // 2}, n) - 1 - {BLOCK})::int as context
  from (select doc_id, (length(text) + 2)::int as n, unnest(range(2, length(text) + 2, {BLOCK // 2})) as start from documents where length(text) > 0))"""


def _plan(spark, sf):
    return plan(table(spark, sf, "documents").select("doc_id", (F.length("text") + 2).alias("n")), "n", BLOCK)


@query("window_plan", f"with {PLAN} select doc_id, start, stop, context from plan")
def window_plan(spark, sf):
    return _plan(spark, sf).select("doc_id", "start", "stop", "context")


@query("window_coverage", f"with {PLAN} select doc_id, sum(stop - start)::bigint as targets, n - 2 as wanted, min(start) as first_target, max(stop) as end_target, true as is_complete from plan group by doc_id, n")
def window_coverage(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.length("text") + 2).alias("n"))
    return coverage(rows, "doc_id", "n", BLOCK).withColumnRenamed("n", "wanted").withColumn("wanted", F.col("wanted") - PREFIX)


def coverage(rows: DataFrame, id: str, n: str, block: int, stride: int | None = None, first: int = PREFIX) -> DataFrame:
    """(id, targets, n, first_target, end_target, is_complete): whether a plan's windows meet every target exactly once.

    The windows of a row are added up inside it: each has to begin where the one
    before ends.  Rows of one id and length count together, and are not complete.
    """
    stride = stride or max(1, block // 2)
    rows = rows.where(F.col(n) > first).select(id, n, F.sequence(F.lit(first), F.col(n) - 1, F.lit(stride)).alias("_starts"))
    rows = rows.withColumn("_stops", F.transform("_starts", lambda s: stop_of(s, n, stride)))
    sizes = F.zip_with("_stops", "_starts", lambda a, b: (a - b).cast("long"))
    joined = F.slice("_starts", 2, F.size("_starts")) == F.slice("_stops", 1, F.size("_stops") - 1)
    by = rows.select(id, n, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("t"), F.array_min("_starts").alias("a"), F.array_max("_stops").alias("b"), joined.alias("ok"))
    by = by.groupBy(id, n).agg(F.sum("t").alias("targets"), F.min("a").alias("first_target"), F.max("b").alias("end_target"), F.bool_and("ok").alias("ok"))
    full = (F.col("targets") == F.col(n) - first) & (F.col("first_target") == first) & (F.col("end_target") == F.col(n)) & F.col("ok")
    return by.select(id, "targets", n, "first_target", "end_target", full.alias("is_complete"))


@query(
    "moving_average",
    "select run, seq, avg from (select user_id as run, row_number() over w as seq, avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as avg from events window w as (partition by user_id order by ts, event_id)) where seq >= 5",
)
def moving_average(spark, sf):
    return averaged(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select(F.col("user_id").alias("run"), "seq", "avg")


def averaged(rows: DataFrame, by: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Mean of each full window of ``width`` rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("avg", F.avg(value).over(w.rowsBetween(1 - width, 0))).where(F.col("seq") >= width)


@query("monitor_steps", "select i::int as i, round_even(3696 * (i + 1) / 25.0, 0)::bigint as step from range(0, 25) r(i)")
def monitor_steps(spark, sf):
    return monitored(spark, 3696, 25)


def monitored(spark, steps: int, evals: int) -> DataFrame:
    """Steps after which to look, spread evenly, half to even."""
    return spark.range(evals).select(F.col("id").cast("int").alias("i"), F.bround(F.lit(steps) * (F.col("id") + 1) / evals).cast("long").alias("step"))


@query(
    "lr_schedule",
    """select s as step, case when s < 100 then 3e-4 * (s + 1) / 100 else 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * (s - 100) / greatest(1, 3696 - 1 - 100))) end as lr from range(0, 3696) r(s)""",
)
def lr_schedule(spark, sf):
    return schedule(spark, 3696, 100, 3e-4, 3e-5)


def schedule(spark, steps: int, warmup: int, peak: float, final: float) -> DataFrame:
    """Linear warm-up, then half a cosine down to the final rate."""
    if steps < warmup + 2:
        raise ValueError("too few steps after the warm-up")
    s = F.col("id")
    down = F.lit(final) + 0.5 * (peak - final) * (1 + F.cos(F.pi() * (s - warmup) / max(1, steps - 1 - warmup)))
    return spark.range(steps).select(s.alias("step"), F.when(s < warmup, F.lit(peak) * (s + 1) / warmup).otherwise(down).alias("lr"))
