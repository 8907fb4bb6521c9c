"""Ranks, rank correlation, paired comparisons and cluster bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.models import PROB, scores
from quillspark.operators.splits import MEETINGS, with_split
from quillspark.operators.windows import draw
from quillspark.plans.registry import query
from quillspark.sources.sinks import shared_table
from quillspark.sources.tables import documents, table

RESAMPLES = 2000  # fixed value
#: Clusters, or rows of clusters, up to which they are sent to the tasks that draw; beyond, draws are joined with them.
SEND_CLUSTERS = 1_000_000
#: Partitions of resamples, and draws that one row stands for before they are made.
DRAW_PARTS, DRAW_BLOCK = 256, 1 << 16


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """Adds the rank of a value among its group's, ties at their mean rank.

    Equal values are counted first, so a window sees distinct values only.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    c = rows.groupBy(*by, value).agg(n.alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(c.withColumn(name, before + (F.col("_c") + 1) / 2).drop("_c"), [*by, value])


def spearman_of(rows: DataFrame, x: str, y: str, by: list[str], weight: Column | None = None) -> DataFrame:
    """Rank correlation in each group; null where either side is constant or fewer than two rows remain."""
    ranked = average_ranks(average_ranks(rows, x, by, "_rx", weight), y, by, "_ry", weight)
    w = F.lit(1) if weight is None else weight
    n = F.sum(w)
    sx, sy, sxx, syy, sxy = (F.sum(w * c) for c in (F.col("_rx"), F.col("_ry"), F.col("_rx") ** 2, F.col("_ry") ** 2, F.col("_rx") * F.col("_ry")))
    g = ranked.groupBy(*by).agg(n.alias("n"), (n * sxy - sx * sy).alias("c"), (n * sxx - sx * sx).alias("vx"), (n * syy - sy * sy).alias("vy"))
    return g.select(*by, "n", F.when((F.col("n") > 1) & (F.col("vx") > 1e-9) & (F.col("vy") > 1e-9), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("rho"))


def spearman_in(rows: DataFrame, x: str, y: str, by: str, weight: str) -> DataFrame:
    """As :func:`spearman_of` for many groups of weighted rows, which are dealt by group once.

    The mean rank of a value is half of (weight up to it + weight before it + 1).
    """
    def mean_rank(c):
        upto, from_ = (F.sum(weight).over(Window.partitionBy(by).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.asc(c), F.desc(c)))
        return (upto + F.sum(weight).over(Window.partitionBy(by)) - from_ + 1) / 2
    ranked = rows.select(by, x, y, weight).withColumn("_rx", mean_rank(x)).withColumn("_ry", mean_rank(y))
    w, n = F.col(weight), F.sum(weight)
    sx, sy, sxx, syy, sxy = (F.sum(w * c) for c in (F.col("_rx"), F.col("_ry"), F.col("_rx") ** 2, F.col("_ry") ** 2, F.col("_rx") * F.col("_ry")))
    g = ranked.groupBy(by).agg(n.alias("n"), (n * sxy - sx * sy).alias("c"), (n * sxx - sx * sx).alias("vx"), (n * syy - sy * sy).alias("vy"))
    return g.select(by, "n", F.when((F.col("n") > 1) & (F.col("vx") > 1e-9) & (F.col("vy") > 1e-9), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("rho"))


def spearman_sent(rows: DataFrame, x: str, y: str, stat: str, resamples: int) -> DataFrame:
    """(resample, rho) with the rows at hand in every task: they are sorted once, a resample is sums over how often each was drawn.

    The mean rank of a value is half of (times drawn up to it + times before it + 1).
    """
    known = shared_table(numbered(rows, "stratum", "cluster"))
    held = rows.join(known, ["stratum", "cluster"]).select("stratum", "_i", x, y).toPandas()  # SEND_CLUSTERS rows at most
    sizes = {r.stratum: r["_n"] for r in known.select("stratum", "_n").distinct().collect()}
    base = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
    own = held["_i"].to_numpy() + held["stratum"].map(base).to_numpy()
    sides = []
    for c in (x, y):
        v = held[c].to_numpy()
        order = np.argsort(v, kind="stable")
        first = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])
        sides.append((order, first, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))))
    sent = rows.sparkSession.sparkContext.broadcast((own, sum(sizes.values()), sides))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n_clusters, sides = sent.value
        for batch in batches:
            rhos = []
            for drawn in batch.column("drawn"):
                w = np.bincount(drawn.values.to_numpy(), minlength=n_clusters)[own]
                ranks = []
                for order, first, value in sides:
                    total = np.add.reduceat(w[order], first)
                    upto = np.cumsum(total)
                    r = np.empty(len(w))
                    r[order] = ((2 * upto - total + 1) / 2)[value]
                    ranks.append(r)
                a, b, n = *ranks, int(w.sum())
                sa, sb = float((w * a).sum()), float((w * b).sum())
                va, vb = n * float((w * a * a).sum()) - sa * sa, n * float((w * b * b).sum()) - sb * sb
                rhos.append((n * float((w * a * b).sum()) - sa * sb) / math.sqrt(va * vb) if n > 1 and va > 1e-9 and vb > 1e-9 else None)
            yield pa.RecordBatch.from_arrays([batch.column("resample"), pa.array(rhos, pa.float64())], ["resample", "rho"])

    base = rows.sparkSession.createDataFrame(list(base.items()), "stratum string, _base long")
    drawn = single_draws(known, stat, resamples, "stratum").join(F.broadcast(base), "stratum")
    return drawn.groupBy("resample").agg(F.collect_list((F.col("_base") + F.col("_i")).cast("int")).alias("drawn")).mapInArrow(run, "resample int, rho double")


def percentile_interval(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact percentiles at 2.5 and 97.5 with linear interpolation."""
    return rows.groupBy(*by).agg(F.percentile(value, 0.025).alias("ci_low"), F.percentile(value, 0.975).alias("ci_high"))


def delta_label(point: Column, low: Column) -> Column:
    return F.when(point <= 0, "contradicted").when(low > 0, "supported").otherwise("inconclusive")


def rho_label(rho: Column, least: float = 0.7) -> Column:
    return F.when(rho >= least, "supported").otherwise("contradicted")


def numbered(clusters: DataFrame, stratum: str, id: str) -> DataFrame:
    """(stratum, id, _i, _n): clusters numbered from 0 inside their stratum, and how many it has.

    Numbers run through 256 parts by hash, so a window sees one part, and only
    the parts' sizes are summed up in one place.
    """
    keyed = clusters.select(stratum, id).distinct().withColumn("_b", F.substring(F.md5(F.col(id).cast("string")), 1, 2))
    parts = keyed.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(stratum, "_b", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy(stratum)).alias("_n"))
    nth = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy(id)) - 1
    return keyed.withColumn("_r", nth).join(parts, [stratum, "_b"]).select(stratum, id, (F.col("_base") + F.col("_r")).alias("_i"), "_n")


def single_draws(clusters: DataFrame, stat: str, resamples: int, stratum: str) -> DataFrame:
    """(resample, stratum, _i): one row a draw.

    Resamples are dealt over the tasks and a resample's draws are made in one,
    so what gathers them by resample moves no draw.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {DRAW_BLOCK}"))
    sizes = clusters.select(stratum, "_n").distinct().select(stratum, "_n", F.explode(blocks).alias("_block"))
    seeds = clusters.sparkSession.range(resamples).select(F.col("id").cast("int").alias("resample")).repartition(min(resamples, DRAW_PARTS), "resample")
    start = F.col("_block") * DRAW_BLOCK
    each = seeds.crossJoin(F.broadcast(sizes)).select("resample", stratum, "_n", F.explode(F.sequence(start, F.least(start + DRAW_BLOCK, F.col("_n")) - 1)).alias("draw"))
    return each.select("resample", stratum, draw(F.lit(stat), F.col("resample"), F.col("draw"), F.col(stratum), n=F.col("_n")).alias("_i"))


def draws(clusters: DataFrame, stat: str, resamples: int, stratum: str = "stratum", id: str = "cluster") -> DataFrame:
    """(resample, stratum, cluster, times): clusters drawn with replacement inside their stratum, as often as it has clusters.

    Indices come from hashes of (statistic, resample, draw, stratum), so the
    draws do not depend on order, partitions or engine.
    """
    known = shared_table(numbered(clusters, stratum, id))
    times = single_draws(known, stat, resamples, stratum).groupBy("resample", stratum, "_i").agg(F.count("*").alias("times"))
    of = known.drop("_n")
    of = F.broadcast(of) if known.count() <= SEND_CLUSTERS else of
    return times.join(of, [stratum, "_i"]).select("resample", stratum, id, "times")


def drawn_sums(rows: DataFrame, stat: str, resamples: int, values: list[str], stratum: str = "stratum", id: str = "cluster") -> DataFrame:
    """(resample, stratum, values): sums of the drawn clusters' values, a cluster drawn twice counting twice."""
    known = shared_table(numbered(rows, stratum, id))
    of = known.join(rows.select(stratum, id, *values), [stratum, id]).select(stratum, "_i", *values)
    # where the sums of all clusters are at hand, a task adds up its draws and sends on a row a resample
    of = F.broadcast(of) if known.count() <= SEND_CLUSTERS else of
    drawn = single_draws(known, stat, resamples, stratum).join(of, [stratum, "_i"])
    return drawn.groupBy("resample", stratum).agg(*[F.sum(v).alias(v) for v in values])


def DRAWS(stat: str, clusters: str) -> str:
    return f"""num as materialized (select stratum, cluster, row_number() over (partition by stratum order by substr(md5(cluster::varchar), 1, 2), cluster) - 1 as i, count(*) over (partition by stratum) as n from (select distinct stratum, cluster from {clusters})),
    tries as (select stratum, n, i as draw, unnest(range(0, {RESAMPLES}))::int as resample from num),
    drawn as (select resample, stratum, ('0x' || substr(md5('{stat}|' || resample || '|' || draw || '|' || stratum), 1, 8))::bigint % n as i from tries),
    draws as materialized (select resample, stratum, cluster, count(*) as times from drawn join num using (stratum, i) group by all)"""


LENGTHS = f"""{MEETINGS}, sc as (select doc_id, genre, meeting_id as cluster, split as stratum, length(body)::double as x from split_docs where split in ('N', 'F'))"""


def _lengths(spark, sf) -> DataFrame:
    """Scores that need no model: text lengths of the scored splits."""
    docs = with_split(documents(spark, sf)).where("split in ('N', 'F')")
    return docs.select("doc_id", "genre", F.col("meeting_id").alias("cluster"), F.col("split").alias("stratum"), F.length("body").cast("double").alias("x"))


BPC = f"""{PROB}, sc as (select n.doc_id, d.genre, d.meeting_id as cluster, d.meeting_date, n.split as stratum, round(total_nll / (body_tokens * ln(2)), 6) as x from nll n join docs d using (doc_id))"""


def _bpc(spark, sf) -> DataFrame:
    s = shared_table(scores(spark, sf).select("doc_id", F.col("split").alias("stratum"), F.round("bpc", 6).alias("x")))  # one narrow row a document
    return s.join(documents(spark, sf).select("doc_id", "genre", F.col("meeting_id").alias("cluster"), "meeting_date"), "doc_id")


@query("average_rank", "select c_custkey, rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2.0::double as r from customer")
def average_rank(spark, sf):
    return average_ranks(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", [], "r").select("c_custkey", "r")


@query(
    "spearman",
    """with r as (select c_mktsegment, rank() over (partition by c_mktsegment order by c_nationkey) + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2.0 as a,
    rank() over (partition by c_mktsegment order by c_acctbal) + (count(*) over (partition by c_mktsegment, c_acctbal) - 1) / 2.0 as b from customer)
    select c_mktsegment, count(*) as n, round(corr(a, b), 9) as rho from r group by 1""",
)
def spearman(spark, sf):
    return spearman_of(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", ["c_mktsegment"]).withColumn("rho", F.round("rho", 9))


@query("percentile_ci", "select c_mktsegment, round(quantile_cont(c_acctbal, 0.025), 6) as ci_low, round(quantile_cont(c_acctbal, 0.975), 6) as ci_high from customer group by 1")
def percentile_ci(spark, sf):
    return percentile_interval(table(spark, sf, "customer"), "c_acctbal", ("c_mktsegment",)).select("c_mktsegment", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@query("bootstrap_draws", f"with {LENGTHS}, {DRAWS('draws', 'sc')} select * from draws")
def bootstrap_draws(spark, sf):
    return draws(_lengths(spark, sf), "draws", RESAMPLES)


def drift(rows: DataFrame, stat: str, resamples: int) -> DataFrame:
    """Mean over documents of F less that of N, its interval over meetings drawn inside each split, and the label."""
    def mean(s):
        return F.sum(F.when(F.col("stratum") == s, F.col("s"))) / F.sum(F.when(F.col("stratum") == s, F.col("c")))
    sums = rows.groupBy("stratum", "cluster").agg(F.sum("x").alias("s"), F.count("*").alias("c"))
    point = sums.agg((mean("F") - mean("N")).alias("point"), F.count("*").alias("n_meetings"), F.sum("c").alias("n_documents"))
    each = drawn_sums(sums, stat, resamples, ["s", "c"]).groupBy("resample").agg((mean("F") - mean("N")).alias("d"))
    return point.crossJoin(percentile_interval(each, "d")).withColumn("label", delta_label(F.col("point"), F.col("ci_low")))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in names})


@query(
    "h1_drift",
    f"""with {BPC}, sums as (select stratum, cluster, sum(x) as s, count(*) as c from sc group by all), {DRAWS('h1', 'sums')},
    p as (select sum(s) filter (stratum = 'F') / sum(c) filter (stratum = 'F') - sum(s) filter (stratum = 'N') / sum(c) filter (stratum = 'N') as point, count(*) as n_meetings, sum(c)::bigint as n_documents from sums),
    e as (select resample, sum(s * times) filter (stratum = 'F') / sum(c * times) filter (stratum = 'F') - sum(s * times) filter (stratum = 'N') / sum(c * times) filter (stratum = 'N') as d from draws join sums using (stratum, cluster) group by resample),
    q as (select quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from e)
    select round(point, 4) as point, n_meetings, n_documents, round(lo, 4) as ci_low, round(hi, 4) as ci_high, case when point <= 0 then 'contradicted' when lo > 0 then 'supported' else 'inconclusive' end as label from p, q""",
)
def h1_drift(spark, sf):
    return _rounded(drift(_bpc(spark, sf), "h1", RESAMPLES), "point", "ci_low", "ci_high")


def pairs(rows: DataFrame, stratum: str = "F") -> DataFrame:
    """Meetings of a split with the scores of both genres, and their difference."""
    one = rows.where(F.col("stratum") == stratum).groupBy("stratum", "cluster")
    both = one.agg(F.max(F.when(F.col("genre") == "minutes", F.col("x"))).alias("minutes"), F.max(F.when(F.col("genre") == "statement", F.col("x"))).alias("statement"))
    return both.withColumn("d", F.col("minutes") - F.col("statement"))


PAIRED = """prs as (select stratum, cluster, max(x) filter (genre = 'minutes') as minutes, max(x) filter (genre = 'statement') as statement from sc where stratum = 'F' group by all)"""


@query("genre_pairs", f"with {LENGTHS}, {PAIRED} select cluster as meeting_id, minutes, statement, minutes - statement as d from prs where minutes is not null and statement is not null")
def genre_pairs(spark, sf):
    return pairs(_lengths(spark, sf)).where("d is not null").select(F.col("cluster").alias("meeting_id"), "minutes", "statement", "d")


@query(
    "h2_genre",
    f"""with {BPC}, {PAIRED}, ok as (select stratum, cluster, minutes - statement as d from prs where minutes is not null and statement is not null), {DRAWS('h2', 'ok')},
    e as (select resample, sum(d * times) / sum(times) as d from draws join ok using (stratum, cluster) group by resample), q as (select quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from e),
    p as (select avg(d) as point, count(*) as n_meetings, (select count(*) from prs where minutes is null or statement is null) as excluded_meetings from ok)
    select round(point, 4) as point, n_meetings, excluded_meetings, round(lo, 4) as ci_low, round(hi, 4) as ci_high, case when point <= 0 then 'contradicted' when lo > 0 then 'supported' else 'inconclusive' end as label from p, q""",
)
def h2_genre(spark, sf):
    return _rounded(paired(_bpc(spark, sf), "h2", RESAMPLES), "point", "ci_low", "ci_high")


def paired(rows: DataFrame, stat: str, resamples: int) -> DataFrame:
    """Mean difference between genres over matched meetings, bootstrapped over the pairs."""
    p = pairs(rows)
    ok = p.where("d is not null")
    point = p.agg(F.avg("d").alias("point"), F.count("d").alias("n_meetings"), F.count_if(F.col("d").isNull()).alias("excluded_meetings"))
    each = drawn_sums(ok.withColumn("c", F.lit(1)), stat, resamples, ["d", "c"]).groupBy("resample").agg((F.sum("d") / F.sum("c")).alias("d"))
    return point.crossJoin(percentile_interval(each, "d")).withColumn("label", delta_label(F.col("point"), F.col("ci_low")))


def rho_bootstrap(rows: DataFrame, x: str, y: str, stat: str, resamples: int) -> DataFrame:
    """Rank correlation of two instruments over documents, ranks made anew in each resample of meetings.

    A meeting drawn twice counts twice: weights stand for repeated rows.
    Resamples without a defined value are counted and left out.
    """
    rows = shared_table(rows.select("stratum", "cluster", x, y))
    point = spearman_of(rows.withColumn("_all", F.lit(1)), x, y, ["_all"]).select(F.col("rho").alias("point"), F.col("n").alias("n_documents"))
    if rows.count() <= SEND_CLUSTERS:
        each = spearman_sent(rows, x, y, stat, resamples)
    else:
        each = spearman_in(draws(rows, stat, resamples).join(rows, ["stratum", "cluster"]), x, y, "resample", "times")
    ci = each.agg(F.percentile("rho", 0.025).alias("ci_low"), F.percentile("rho", 0.975).alias("ci_high"), F.count_if(F.col("rho").isNull()).alias("undefined_resamples"))
    return point.crossJoin(ci)


INSTRUMENTS = f"""{MEETINGS}, sc as (select doc_id, meeting_id as cluster, split as stratum, length(body)::double as x, (length(body) - length(regexp_replace(body, '\\s', '', 'g')))::double as y from split_docs where split = 'F')"""


def RHO(stat: str) -> str:
    return f"""{INSTRUMENTS}, {DRAWS(stat, 'sc')}, rep as (select resample, doc_id, x, y, unnest(range(0, times)) as t from draws join sc using (stratum, cluster)),
    rk as (select resample, rank() over (partition by resample order by x) + (count(*) over (partition by resample, x) - 1) / 2.0 as a, rank() over (partition by resample order by y) + (count(*) over (partition by resample, y) - 1) / 2.0 as b from rep),
    e as (select resample, corr(a, b) as rho from rk group by resample), q as (select quantile_cont(rho, 0.025) as lo, quantile_cont(rho, 0.975) as hi, 0::bigint as u from e),
    pk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as a, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as b from sc), p as (select corr(a, b) as point, count(*) as n from pk)"""


def _instruments(spark, sf) -> DataFrame:
    docs = with_split(documents(spark, sf)).where("split = 'F'")
    return docs.select("doc_id", F.col("meeting_id").alias("cluster"), F.col("split").alias("stratum"), F.length("body").cast("double").alias("x"), (F.length("body") - F.length(F.regexp_replace("body", "\\s", ""))).cast("double").alias("y"))


@query("rho_by_meeting", f"with {RHO('rho')} select round(point, 6) as point, n as n_documents, round(lo, 6) as ci_low, round(hi, 6) as ci_high, u as undefined_resamples from p, q")
def rho_by_meeting(spark, sf):
    return rho_bootstrap(_instruments(spark, sf), "x", "y", "rho", RESAMPLES).withColumns({c: F.round(c, 6) for c in ("point", "ci_low", "ci_high")})


@query("h3_instruments", f"with {RHO('h3')} select round(point, 6) as point, round(lo, 6) as ci_low, round(hi, 6) as ci_high, case when point >= 0.7 then 'supported' else 'contradicted' end as label from p, q")
def h3_instruments(spark, sf):
    found = rho_bootstrap(_instruments(spark, sf), "x", "y", "h3", RESAMPLES)
    return found.withColumn("label", rho_label(F.col("point"))).select(*(F.round(c, 6).alias(c) for c in ("point", "ci_low", "ci_high")), "label")


@query("e1_top", f"with {BPC} select doc_id, x as bpc from sc where stratum = 'F' order by x desc, cluster, genre limit 5")
def e1_top(spark, sf):
    return _bpc(spark, sf).where("stratum = 'F'").orderBy(F.desc("x"), "cluster", "genre").limit(5).select("doc_id", F.col("x").alias("bpc"))


@query("labels", "select p as point, l as low, case when p <= 0 then 'contradicted' when l > 0 then 'supported' else 'inconclusive' end as delta, case when p >= 0.7 then 'supported' else 'contradicted' end as rho from (values (0.0::double, 0.0::double), (0.8, 0.1), (0.5, 0.0), (-0.1, -0.2)) v(p, l)")
def labels(spark, sf):
    v = spark.createDataFrame([(0.0, 0.0), (0.8, 0.1), (0.5, 0.0), (-0.1, -0.2)], "point double, low double")
    return v.select("point", "low", delta_label(F.col("point"), F.col("low")).alias("delta"), rho_label(F.col("point")).alias("rho"))


@query("mean_table", f"with {BPC} select stratum as split, year(meeting_date)::int as year, genre, round(avg(x), 5) as mean, count(*) as n from sc group by grouping sets ((stratum, genre), (year(meeting_date)::int, genre), (stratum))")
def mean_table(spark, sf):
    rows = _bpc(spark, sf).select(F.col("stratum").alias("split"), F.year("meeting_date").alias("year"), "genre", "x")
    sets = [["split", "genre"], ["year", "genre"], ["split"]]
    return means(rows, sets, "x").withColumn("mean", F.round("mean", 5))


def means(rows: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Mean and count over several sets of keys in one pass; keys outside a set are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


@query("projection", f"with {MEETINGS}, c as (select split, sum(length(body)) as n from split_docs group by split) select split, 12.5 * n / (select n from c where split = 'N') as seconds from c")
def projection(spark, sf):
    by = with_split(documents(spark, sf)).groupBy("split").agg(F.sum(F.length("body")).alias("n"))
    measured = by.where("split = 'N'").select(F.col("n").alias("base"))
    return by.crossJoin(F.broadcast(measured)).select("split", (F.lit(12.5) * F.col("n") / F.col("base")).alias("seconds"))
