"""Numeric recurrences on grids of starting points, and small-network arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.sources.tables import table

# The grids of the experiments.
STARTS, RATES, STEPS = (-1.0, 0.5, 2.0), (0.05, 0.1, 0.15, 0.2), 200
SEEDS, NOISE, GAMMAS, SGD_RATES, SGD_STEPS = 20, 0.5, (None, 0.02, 0.05), (0.2, 0.1), 200
OPTIMUM = 1 - 2 / math.sqrt(3)  # where the slope of the left branch vanishes


def objective(x: Column) -> Column:
    return F.abs(0.5 * x**3 - 1.5 * x**2) + 0.5 * x


def slope(x: Column) -> Column:
    """Derivative of either branch; at the kink x = 3 it is taken as zero."""
    inner = 1.5 * x**2 - 3 * x
    return F.when(x == 3, 0.0).when(x < 3, -inner + 0.5).otherwise(inner + 0.5)


SLOPE = "case when {x} = 3 then 0 when {x} < 3 then -(1.5 * {x} * {x} - 3 * {x}) + 0.5 else (1.5 * {x} * {x} - 3 * {x}) + 0.5 end"
VALUE = "abs(0.5 * {x} * {x} * {x} - 1.5 * {x} * {x}) + 0.5 * {x}"


def grid(spark, low: float, step: float, n: int) -> DataFrame:
    return spark.range(n).select((F.lit(low) + F.col("id") * step).alias("x"))


@query("objective_eval", f"select round(x, 9) as x, round({VALUE.format(x='x')}, 9) as f, round({SLOPE.format(x='x')}, 9) as g from (select -1.0::double + i * 0.25 as x from range(0, 21) r(i))")
def objective_eval(spark, sf):
    return grid(spark, -1.0, 0.25, 21).select(*(F.round(c, 9).alias(n) for n, c in (("x", F.col("x")), ("f", objective(F.col("x"))), ("g", slope(F.col("x"))))))


@query(
    "gradient_check",
    f"with p as (select -0.9::double + i * 0.25 as x from range(0, 18) r(i)) select round(x, 9) as x, abs((({VALUE.format(x='(x + 1e-6)')}) - ({VALUE.format(x='(x - 1e-6)')})) / 2e-6 - ({SLOPE.format(x='x')})) < 1e-5 or abs(x) < 1e-6 as is_equal from p",
)
def gradient_check(spark, sf):
    x, h = F.col("x"), 1e-6
    numeric = (objective(x + h) - objective(x - h)) / (2 * h)
    return grid(spark, -0.9, 0.25, 18).select(F.round("x", 9).alias("x"), ((F.abs(numeric - slope(x)) < 1e-5) | (F.abs(x) < 1e-6)).alias("is_equal"))


def descents(rows: DataFrame, start: str, rate: Column, steps: int) -> DataFrame:
    """(.., k, x): the path of gradient descent from each row's start, made inside the row."""
    rows = rows.withColumn("_r", rate).withColumn("_s", F.col(start))
    p = "element_at(a, -1)"
    step = f"(case when {p} = 3 then 0D when {p} < 3 then -(1.5 * {p} * {p} - 3 * {p}) + 0.5 else (1.5 * {p} * {p} - 3 * {p}) + 0.5 end)"
    path = F.expr(f"aggregate(sequence(1, {steps}), array(_s), (a, k) -> concat(a, array({p} - _r * {step})))")
    return rows.withColumn("_path", path).select(*[c for c in rows.columns if c[0] != "_"], F.posexplode("_path").alias("k", "x"))


GD = f"""with recursive g(x0, eta) as (select a, b from (values {", ".join(f"({x}::double)" for x in STARTS)}) s(a), (values {", ".join(f"({r}::double)" for r in RATES)}) t(b)),
path as (select x0, eta, 0 as k, x0 as x from g union all select x0, eta, k + 1, x - eta * ({SLOPE.format(x="x")}) from path where k < {STEPS})"""


def _grid(spark) -> DataFrame:
    return spark.createDataFrame([(x, r) for x in STARTS for r in RATES], "x0 double, eta double")


@query("gd_trajectory", f"{GD} select x0, eta, k::int as k, round(x, 6) as x from path")
def gd_trajectory(spark, sf):
    return descents(_grid(spark), "x0", F.col("eta"), STEPS).withColumn("x", F.round("x", 6))


def metrics(paths: DataFrame, by: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Last gap, smallest gap, and the first step within tolerance, null if there is none."""
    best = objective(F.lit(OPTIMUM))
    rows = paths.withColumn("gap", objective(F.col("x")) - best)
    return rows.groupBy(*by).agg(F.max_by("gap", "k").alias("final_gap"), F.min("gap").alias("min_gap"), F.min(F.when(F.col("gap") <= tolerance, F.col("k"))).alias("first_hit"))


GAP = f"({VALUE.format(x='x')}) - ({VALUE.format(x=f'{OPTIMUM!r}::double')})"


@query("gd_metrics", f"{GD}, m as (select x0, eta, k, {GAP} as gap from path) select x0, eta, round(arg_max(gap, k), 6) as final_gap, round(min(gap), 6) as min_gap, (min(k) filter (gap <= 1e-3))::int as first_hit from m group by all")
def gd_metrics(spark, sf):
    found = metrics(descents(_grid(spark), "x0", F.col("eta"), STEPS), ["x0", "eta"])
    return found.withColumn("final_gap", F.round("final_gap", 6)).withColumn("min_gap", F.round("min_gap", 6))


def noise(seed: Column, k: Column) -> Column:
    """A standard normal number from hashes of seed and step (Box-Muller)."""
    def u(tag):
        return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), seed, k)), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * F.pi() * u("b"))


def noisy_descents(rows: DataFrame, start: str, rate: Column, gamma: str, seed: str, steps: int, sigma: float) -> DataFrame:
    """Paths with noisy slopes and rates that shrink as rate / (1 + gamma k) where gamma is given."""
    rows = rows.withColumns({"_r": rate, "_s": F.col(start), "_g": F.coalesce(F.col(gamma), F.lit(0.0))})
    rows = rows.withColumn("_z", F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: noise(F.col(seed), k)))
    p = "element_at(a, -1)"
    step = f"(case when {p} = 3 then 0D when {p} < 3 then -(1.5 * {p} * {p} - 3 * {p}) + 0.5 else (1.5 * {p} * {p} - 3 * {p}) + 0.5 end)"
    # iterating over the noise evaluates it once; a lambda that looks it up would make it anew at each step
    path = F.expr(f"aggregate(transform(_z, (z, k) -> struct(z, k)), array(_s), (a, e) -> concat(a, array({p} - _r / (1 + _g * e.k) * ({step} + {sigma}D * e.z))))")
    return rows.withColumn("_path", path).select(*[c for c in rows.columns if c[0] != "_"], F.posexplode("_path").alias("k", "x"))


SGD = f"""with recursive g as (select a as x0, b as eta, c as gamma, s::int as seed from (values {", ".join(f"({x}::double)" for x in STARTS)}) r(a), (values {", ".join(f"({r}::double)" for r in SGD_RATES)}) t(b), (values (null::double), {", ".join(f"({g}::double)" for g in GAMMAS[1:])}) u(c), range(0, {SEEDS}) v(s)),
u as (select s, k, (('0x' || substr(md5('a|' || s || '|' || k), 1, 8))::bigint + 0.5) / 4294967296.0::double as a, (('0x' || substr(md5('b|' || s || '|' || k), 1, 8))::bigint + 0.5) / 4294967296.0::double as b from range(0, {SEEDS}) x(s), range(0, {SGD_STEPS}) y(k)),
z as (select s, k, sqrt(-2 * ln(a)) * cos(2 * pi() * b) as z from u),
path as (select x0, eta, gamma, seed, 0 as k, x0 as x from g union all
  select x0, eta, gamma, seed, path.k + 1, x - eta / (1 + coalesce(gamma, 0) * path.k) * (({SLOPE.format(x="x")}) + {NOISE} * z) from path join z on z.s = seed and z.k = path.k where path.k < {SGD_STEPS})"""


def _noisy(spark) -> DataFrame:
    rows = [(x, r, g, s) for x in STARTS for r in SGD_RATES for g in GAMMAS for s in range(SEEDS)]
    return noisy_descents(spark.createDataFrame(rows, "x0 double, eta double, gamma double, seed int"), "x0", F.col("eta"), "gamma", "seed", SGD_STEPS, NOISE)


@query("sgd_trajectory", f"{SGD} select x0, eta, gamma, seed, k::int as k, round(x, 5) as x from path")
def sgd_trajectory(spark, sf):
    return _noisy(spark).withColumn("x", F.round("x", 5))


@query("sgd_quantiles", f"{SGD} select x0, eta, gamma, k::int as k, round(quantile_cont({GAP}, 0.25), 5) as q25, round(quantile_cont({GAP}, 0.5), 5) as q50, round(quantile_cont({GAP}, 0.75), 5) as q75 from path group by all")
def sgd_quantiles(spark, sf):
    gap = objective(F.col("x")) - objective(F.lit(OPTIMUM))
    return _noisy(spark).groupBy("x0", "eta", "gamma", "k").agg(*(F.round(F.percentile(gap, q), 5).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)))


def hit_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Over the runs of a configuration: quartiles of last and best gap, hits, misses, and quartiles of the first hit of those that hit."""
    def quartiles(c):
        return [F.percentile(c, q).alias(f"{c}_q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return runs.groupBy(*by).agg(F.count("first_hit").alias("hits"), (F.count("*") - F.count("first_hit")).alias("non_hits"), *quartiles("final_gap"), *quartiles("min_gap"), *quartiles("first_hit"))


HIT_QUARTILES = ", ".join(f"round(quantile_cont({c}, {q}), 5) as {c}_q{int(100 * q)}" for c in ("final_gap", "min_gap", "first_hit") for q in (0.25, 0.5, 0.75))


@query(
    "sgd_hits",
    f"""{SGD}, r as (select x0, eta, gamma, seed, arg_max({GAP}, k) as final_gap, min({GAP}) as min_gap, (min(k) filter ({GAP} <= 1e-3))::int as first_hit from path group by all)
    select x0, eta, gamma, count(first_hit) as hits, count(*) - count(first_hit) as non_hits, {HIT_QUARTILES} from r group by all""",
)
def sgd_hits(spark, sf):
    by = ["x0", "eta", "gamma"]
    found = hit_summary(metrics(_noisy(spark), [*by, "seed"]), by)
    return found.select(*by, "hits", "non_hits", *(F.round(c, 5).alias(c) for c in found.columns if "_q" in c))


@query(
    "paired_wins",
    f"""{SGD}, e as (select x0, eta, gamma, seed, {GAP} as gap from path where k = {SGD_STEPS})
    select a.x0, a.eta, a.gamma, count(*) filter (a.gap < b.gap) as wins, round(median(a.gap / greatest(b.gap, 2.220446049250313e-16)), 5) as median_ratio
    from e a join e b on a.x0 = b.x0 and a.eta = b.eta and a.seed = b.seed and b.gamma is null where a.gamma is not null group by all""",
)
def paired_wins(spark, sf):
    gap = objective(F.col("x")) - objective(F.lit(OPTIMUM))
    ends = _noisy(spark).where(F.col("k") == SGD_STEPS).withColumn("gap", gap)
    base = ends.where("gamma is null").select("x0", "eta", "seed", F.col("gap").alias("base"))
    both = ends.where("gamma is not null").join(base, ["x0", "eta", "seed"])
    ratio = F.col("gap") / F.greatest("base", F.lit(2.220446049250313e-16))
    return both.groupBy("x0", "eta", "gamma").agg(F.count_if(F.col("gap") < F.col("base")).alias("wins"), F.round(F.percentile(ratio, 0.5), 5).alias("median_ratio"))


@query("mc_standard_error", "select event_type, round(avg(value), 6) as mean, round(stddev_samp(value) / sqrt(count(*)), 6) as standard_error, count(*) as n from events group by event_type")
def mc_standard_error(spark, sf):
    by = table(spark, sf, "events").groupBy("event_type")
    return by.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(F.count("*")), 6).alias("standard_error"), F.count("*").alias("n"))


@query(
    "quadratic_contraction",
    """with recursive p as (select eta, 0 as k, 1.0::double as x, null::double as ratio from (values (0.1::double), (0.5), (1.5), (1.9), (2.5)) t(eta) union all
    select eta, k + 1, x - eta * x, abs(x - eta * x) / abs(x) from p where k < 30 and abs(x) <= 1e6) select eta, k::int as k, round(x, 6) as x, round(ratio, 6) as ratio from p""",
)
def quadratic_contraction(spark, sf):
    return contractions(spark.createDataFrame([(e,) for e in (0.1, 0.5, 1.5, 1.9, 2.5)], "eta double"), 30, 1e6).withColumns({c: F.round(c, 6) for c in ("x", "ratio")})


def contractions(rows: DataFrame, steps: int, bound: float) -> DataFrame:
    """Descent on x²/2 until it leaves the bound, by a recursive query with that predicate."""
    rows.createOrReplaceTempView("contraction_rates")
    sql = f"""with recursive p(eta, k, x, ratio) as (select eta, 0, 1.0D, cast(null as double) from contraction_rates union all
    select eta, k + 1, x - eta * x, abs(x - eta * x) / abs(x) from p where k < {steps} and abs(x) <= {bound}D) select * from p"""
    return rows.sparkSession.sql(sql)


# A network of two inputs, two hidden units and one output, over points made from the events table.
W1, B1, W2, B2 = ((1.0, -1.0), (0.5, 0.25)), (0.1, -0.2), (3.0, -1.5), 0.05


def points(spark, sf) -> DataFrame:
    """(event_id, x1, x2, y): y tells whether the coordinates have different signs."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf, "events").select("event_id", ((k - 50) / 50).alias("x1"), ((F.col("value") - 10) / 10).alias("x2"))
    return e.withColumn("y", (F.col("x1") * F.col("x2") < 0).cast("double"))


POINTS = "pts as (select event_id, x1, x2, (x1 * x2 < 0)::int::double as y from (select event_id, ((props->>'$.k')::double - 50) / 50 as x1, (value - 10) / 10 as x2 from events))"


def forward(rows: DataFrame, w1=W1, b1=B1, w2=W2, b2=B2) -> DataFrame:
    """Hidden sums a, their rectified values h, output f and half squared error."""
    for i in (0, 1):
        rows = rows.withColumn(f"a{i + 1}", F.lit(w1[i][0]) * F.col("x1") + F.lit(w1[i][1]) * F.col("x2") + F.lit(b1[i]))
    rows = rows.withColumns({f"h{i}": F.greatest(F.col(f"a{i}"), F.lit(0.0)) for i in (1, 2)})
    rows = rows.withColumn("f", F.lit(w2[0]) * F.col("h1") + F.lit(w2[1]) * F.col("h2") + F.lit(b2))
    return rows.withColumn("loss", 0.5 * (F.col("f") - F.col("y")) * (F.col("f") - F.col("y")))


NET = f"""{POINTS}, net as (select *, greatest(a1, 0) as h1, greatest(a2, 0) as h2 from (select *, {W1[0][0]} * x1 + {W1[0][1]} * x2 + {B1[0]} as a1, {W1[1][0]} * x1 + {W1[1][1]} * x2 + ({B1[1]}) as a2 from pts)),
out as (select *, {W2[0]} * h1 + ({W2[1]}) * h2 + {B2} as f from net)"""


@query("xor_label", f"with {POINTS} select y, count(*) as n, round(avg(x1), 6) as mean_x1 from pts group by y")
def xor_label(spark, sf):
    return points(spark, sf).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("x1"), 6).alias("mean_x1"))


@query("mlp_forward", f"with {NET} select event_id, f, 0.5 * (f - y) * (f - y) as loss from out")
def mlp_forward(spark, sf):
    return forward(points(spark, sf)).select("event_id", "f", "loss")  # unrounded: many values are halves of the last place


def gradient_columns(w2=W2) -> dict[str, Column]:
    """Each point's gradient of the loss by parameter; a unit at or below zero passes none on."""
    d = F.col("f") - F.col("y")
    g = {"b2": d, "w2_1": d * F.col("h1"), "w2_2": d * F.col("h2")}
    for i in (1, 2):
        up = F.when(F.col(f"a{i}") > 0, d * w2[i - 1]).otherwise(0.0)
        g |= {f"b1_{i}": up, f"w1_{i}1": up * F.col("x1"), f"w1_{i}2": up * F.col("x2")}
    return g


def gradients(rows: DataFrame, w2=W2) -> DataFrame:
    """Mean gradient of the loss by parameter."""
    return rows.agg(*[F.avg(c).alias(n) for n, c in gradient_columns(w2).items()])


GRADIENT = ", ".join(
    ["avg(f - y) as b2", "avg((f - y) * h1) as w2_1", "avg((f - y) * h2) as w2_2"]
    + [f"avg(case when a{i} > 0 then (f - y) * ({W2[i - 1]}){m} else 0 end) as {n}" for i in (1, 2) for n, m in ((f"b1_{i}", ""), (f"w1_{i}1", " * x1"), (f"w1_{i}2", " * x2"))]
)
NAMES = ("b2", "w2_1", "w2_2", "b1_1", "w1_11", "w1_12", "b1_2", "w1_21", "w1_22")


@query("mlp_gradient", f"with {NET}, g as (select {GRADIENT} from out) select " + ", ".join(f"round({n}, 6) as {n}" for n in NAMES) + " from g")
def mlp_gradient(spark, sf):
    return gradients(forward(points(spark, sf))).select(*(F.round(n, 6).alias(n) for n in NAMES))


def loss_at(rows: DataFrame, which: str, eps: float) -> Column:
    """Mean loss as an expression over the points, with one parameter moved."""
    move = lambda n, v: v + eps if n == which else v
    a = [move(f"w1_{i}1", W1[i - 1][0]) * F.col("x1") + move(f"w1_{i}2", W1[i - 1][1]) * F.col("x2") + move(f"b1_{i}", B1[i - 1]) for i in (1, 2)]
    f = sum((move(f"w2_{i}", W2[i - 1]) * F.greatest(a[i - 1], F.lit(0.0)) for i in (1, 2)), F.lit(move("b2", B2)))
    return F.avg(0.5 * (f - F.col("y")) ** 2)


@query("finite_difference", f"with {NET}, g as (select {GRADIENT} from out), u as (unpivot g on {', '.join(NAMES)} into name parameter value gradient) select parameter, round(gradient, 3) as gradient, true as is_equal from u")
def finite_difference(spark, sf):
    """The gradient by central differences of every parameter, next to the analytic one, in one pass."""
    pts = points(spark, sf)
    moved = [((loss_at(pts, n, 1e-5) - loss_at(pts, n, -1e-5)) / 2e-5).alias(f"n_{n}") for n in NAMES]
    both = pts.agg(*moved).crossJoin(gradients(forward(pts)))
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("gradient"), F.col(f"n_{n}").alias("numeric")) for n in NAMES])).alias("r")).select("r.*")
    return rows.select("parameter", F.round("gradient", 3).alias("gradient"), (F.abs(F.col("gradient") - F.col("numeric")) < 1e-3).alias("is_equal"))


@query("first_nonboundary", f"with {NET} select min(event_id) filter (abs(a1) > 1e-3 and abs(a2) > 1e-3) as first_index from out")
def first_nonboundary(spark, sf):
    off = (F.abs("a1") > 1e-3) & (F.abs("a2") > 1e-3)
    return forward(points(spark, sf)).agg(F.min(F.when(off, F.col("event_id"))).alias("first_index"))


@query(
    "batch_eval",
    f"""with {NET}, b as (select event_id // 64 as b, avg(0.5 * (f - y) * (f - y)) as l, avg(((f > 0.5) = (y > 0.5))::int) as a, count(*) as n from out group by 1)
    select round(sum(l * n) / sum(n), 6) as loss, round(sum(a * n) / sum(n), 6) as accuracy, count(*) as batches from b""",
)
def batch_eval(spark, sf):
    rows = forward(points(spark, sf))
    right = ((F.col("f") > 0.5) == (F.col("y") > 0.5)).cast("int")
    by = rows.groupBy(F.expr("event_id div 64").alias("b")).agg(F.avg("loss").alias("l"), F.avg(right).alias("a"), F.count("*").alias("n"))
    return by.agg(*(F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(name) for c, name in (("l", "loss"), ("a", "accuracy"))), F.count("*").alias("batches"))


@query(
    "best_checkpoint",
    """with e as (select user_id, row_number() over (partition by user_id order by ts, event_id)::int as epoch, value from events),
    b as (select user_id, epoch, min(value) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding) as m, value from e)
    select user_id, max(epoch) filter (m is null or value < m) as best_epoch, min(value) as best from b group by user_id""",
)
def best_checkpoint(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("epoch"), "value")
    return rows.groupBy("user_id").agg(F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"), F.min("value").alias("best"))


@query("unit_activity", f"with {NET} select round(avg((a1 > 0)::int), 6) as unit_1, round(avg((a2 > 0)::int), 6) as unit_2 from out")
def unit_activity(spark, sf):
    return forward(points(spark, sf)).agg(*(F.round(F.avg((F.col(f"a{i}") > 0).cast("int")), 6).alias(f"unit_{i}") for i in (1, 2)))


@query(
    "error_location",
    f"""with {NET}, d as (select least(abs(x1), abs(x2)) as d, (f > 0.5) <> (y > 0.5) as wrong from out)
    select round(median(d) filter (wrong), 6) as wrong_median, round(median(d) filter (not wrong), 6) as right_median, round(median(d) filter (wrong) / median(d) filter (not wrong), 5) as ratio from d""",
)
def error_location(spark, sf):
    rows = forward(points(spark, sf)).select(F.least(F.abs("x1"), F.abs("x2")).alias("d"), ((F.col("f") > 0.5) != (F.col("y") > 0.5)).alias("wrong"))
    m = rows.agg(F.percentile(F.when(F.col("wrong"), F.col("d")), 0.5).alias("w"), F.percentile(F.when(~F.col("wrong"), F.col("d")), 0.5).alias("r"))
    return m.select(F.round("w", 6).alias("wrong_median"), F.round("r", 6).alias("right_median"), F.round(F.col("w") / F.col("r"), 5).alias("ratio"))


@query("full_batch_training")
def full_batch_training(spark, sf):
    """Gradient descent on all points: one aggregate a step, nine numbers come back each time."""
    pts = points(spark, sf).cache()
    p = dict(zip(NAMES, (B2, *W2, B1[0], *W1[0], B1[1], *W1[1]), strict=True))
    out = []
    for k in range(5):
        w1, b1, w2 = ((p["w1_11"], p["w1_12"]), (p["w1_21"], p["w1_22"])), (p["b1_1"], p["b1_2"]), (p["w2_1"], p["w2_2"])
        rows = forward(pts, w1, b1, w2, p["b2"])
        g = gradients(rows, w2).crossJoin(rows.agg(F.avg("loss").alias("loss"))).first()
        out.append((k, g.loss, math.sqrt(sum(g[n] ** 2 for n in NAMES))))
        p = {n: v - 0.05 * g[n] for n, v in p.items()}
    pts.unpersist()
    return spark.createDataFrame(out, "step int, loss double, gradient_norm double")


@query("model_roundtrip")
def model_roundtrip(spark, sf):
    """Parameters that differ after a trip through a written table; no row means that all came back."""
    from quillspark.sources.sinks import shared_table

    before = spark.createDataFrame(list(zip(NAMES, (B2, *W2, B1[0], *W1[0], B1[1], *W1[1]), strict=True)), "name string, value double")
    after = shared_table(before)
    lost = before.exceptAll(after).select(F.lit("lost").alias("side"), "name")
    return lost.union(after.exceptAll(before).select(F.lit("new"), "name")).union(after.agg(F.lit("read"), F.count("*").cast("string")))
