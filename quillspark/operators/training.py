"""Training on a table's points in mini-batches, many runs side by side.

A point's batch is a hash of seed, epoch and point: each epoch deals all points
anew, every point to one batch.  Points are written once, in order of epoch and
batch, so a step reads its batch and no more.  A step is one aggregation for
all runs together: the parameters are a row a run and are sent to all tasks,
the mean gradients of every run come back, nine numbers each.  After an epoch
one pass over the held-out points gives every run's loss and accuracy; the best
epoch of a run is the first with its lowest loss.

Nulls and edges: a point without a coordinate counts nowhere; a batch without a
point changes nothing and has no row; runs of one seed see the same batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.numeric import B1, B2, NAMES, POINTS, W1, W2, forward, gradient_columns, points
from quillspark.operators.windows import draw
from quillspark.plans.registry import query
from quillspark.sources.sinks import shared_table

START = dict(zip(NAMES, (B2, *W2, B1[0], *W1[0], B1[1], *W1[1]), strict=True))
STEPS = "run int, epoch int, batch int, points long, loss double, gradient_norm double, active double"
EPOCHS = "run int, epoch int, train_loss double, val_loss double, val_accuracy double"


def dealt(rows: DataFrame, seeds: Sequence[int], epochs: int, batches: int, id: str) -> DataFrame:
    """Every point once a seed and epoch with its batch, in a table in order of epoch and batch."""
    each = rows.where("x1 is not null and x2 is not null").select("*", F.explode(F.array(*map(F.lit, sorted(set(seeds))))).alias("seed")).select("*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    each = each.withColumn("batch", draw(F.lit("batch"), F.col("seed"), F.col("epoch"), F.col(id), n=F.lit(batches)))
    return shared_table(each.repartitionByRange("epoch", "batch", F.xxhash64(id)).sortWithinPartitions("epoch", "batch"))


def passed(rows: DataFrame, runs: list[dict], on: str | None) -> DataFrame:
    """Points with the outputs of each run that sees them."""
    p = rows.sparkSession.createDataFrame([(r["run"], r["seed"], *(r["p"][n] for n in NAMES)) for r in runs], "run int, _seed int, " + ", ".join(f"{n} double" for n in NAMES))
    if on:
        both = rows.join(F.broadcast(p), F.col(on) == F.col("_seed"))  # a row a run
    else:  # every run sees every point
        both = rows.withColumn("run", F.explode(F.array(*[F.lit(r["run"]) for r in runs]))).join(F.broadcast(p), "run")
    c = F.col
    return forward(both, ((c("w1_11"), c("w1_12")), (c("w1_21"), c("w1_22"))), (c("b1_1"), c("b1_2")), (c("w2_1"), c("w2_2")), c("b2"))


def train(rows: DataFrame, held_out: DataFrame, runs: Sequence[tuple[int, float]], epochs: int, batches: int, id: str = "event_id", start: dict[str, float] = START) -> tuple[DataFrame, DataFrame]:
    """(steps, epochs) of runs, each a seed and a rate: loss, gradient norm and share of active units by step, losses and accuracy by epoch."""
    table = dealt(rows, [s for s, _ in runs], epochs, batches, id)
    held = shared_table(held_out.where("x1 is not null and x2 is not null"))
    state = [{"run": k, "seed": s, "rate": r, "p": dict(start)} for k, (s, r) in enumerate(runs)]
    steps, ends = [], []
    means = [F.avg(g).alias(n) for n, g in gradient_columns((F.col("w2_1"), F.col("w2_2"))).items()]
    active = F.avg(((F.col("a1") > 0).cast("double") + (F.col("a2") > 0).cast("double")) / 2).alias("active")
    for epoch in range(1, epochs + 1):
        losses = {r["run"]: [0.0, 0] for r in state}
        for batch in range(batches):
            seen = passed(table.where((F.col("epoch") == epoch) & (F.col("batch") == batch)), state, "seed")
            for g in seen.groupBy("run").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"), active, *means).collect():
                own = state[g.run]
                steps.append((g.run, epoch, batch, g.n, g.loss, math.sqrt(sum(g[n] ** 2 for n in NAMES)), g.active))
                own["p"] = {n: v - own["rate"] * g[n] for n, v in own["p"].items()}
                losses[g.run][0] += g.loss * g.n
                losses[g.run][1] += g.n
        right = ((F.col("f") > 0.5) == (F.col("y") > 0.5)).cast("double")
        found = {r.run: r for r in passed(held, state, None).groupBy("run").agg(F.avg("loss").alias("loss"), F.avg(right).alias("accuracy")).collect()}
        for r in state:
            total, n = losses[r["run"]]
            v = found.get(r["run"])
            ends.append((r["run"], epoch, total / n if n else None, v and v.loss, v and v.accuracy))
    spark = rows.sparkSession
    return spark.createDataFrame(steps, STEPS), spark.createDataFrame(ends, EPOCHS)


def checkpoints(epochs: DataFrame) -> DataFrame:
    """Epochs with whether each is its run's best: the first of the lowest loss on held-out points."""
    best = F.row_number().over(Window.partitionBy("run").orderBy(F.asc_nulls_last("val_loss"), "epoch"))
    return epochs.withColumn("is_best", best == 1)


#: Runs, epochs and batches of the queries; every fifth point is held out.
RUNS, N_EPOCHS, N_BATCHES = tuple(product((1, 2), (0.02, 0.1))), 2, 3


def _trained(spark, sf) -> tuple[DataFrame, DataFrame]:
    pts = points(spark, sf)
    return train(pts.where("event_id % 5 <> 0"), pts.where("event_id % 5 = 0"), RUNS, N_EPOCHS, N_BATCHES)


def _train_sql() -> str:
    a = {i: f"p.w1_{i}1 * x1 + p.w1_{i}2 * x2 + p.b1_{i}" for i in (1, 2)}
    net = f"greatest({a[1]}, 0) as h1, greatest({a[2]}, 0) as h2, {a[1]} as a1, {a[2]} as a2"
    f = "w2_1 * h1 + w2_2 * h2 + b2"
    up = {i: f"case when a{i} > 0 then (f - y) * w2_{i} else 0 end" for i in (1, 2)}
    grads = {"b2": "f - y", "w2_1": "(f - y) * h1", "w2_2": "(f - y) * h2"}
    for i in (1, 2):
        grads |= {f"b1_{i}": up[i], f"w1_{i}1": f"({up[i]}) * x1", f"w1_{i}2": f"({up[i]}) * x2"}
    values = ", ".join(f"({k}, {s}, {r}::double, " + ", ".join(f"{START[n]}::double" for n in NAMES) + ")" for k, (s, r) in enumerate(RUNS))
    parts = [f"{POINTS}, p0(run, seed, rate, {', '.join(NAMES)}) as (values {values})"]
    k, steps, ends = 0, [], []
    for epoch in range(1, N_EPOCHS + 1):
        for batch in range(N_BATCHES):
            draw = f"('0x' || substr(md5('batch|' || p.seed || '|{epoch}|' || event_id), 1, 8))::bigint % {N_BATCHES}"
            parts.append(f"n{k} as (select p.*, x1, x2, y, {net} from pts join p{k} p on {draw} = {batch} where event_id % 5 <> 0)")
            parts.append(f"g{k} as materialized (select run, count(*) as n, avg(0.5 * (f - y) * (f - y)) as loss, avg(((a1 > 0)::int + (a2 > 0)::int) / 2) as active, {', '.join(f'avg({e}) as g_{n}' for n, e in grads.items())} from (select *, {f} as f from n{k}) group by run)")
            parts.append(f"p{k + 1} as materialized (select p.run, p.seed, p.rate, {', '.join(f'p.{n} - p.rate * coalesce(g_{n}, 0) as {n}' for n in NAMES)} from p{k} p left join g{k} using (run))")
            norm = " + ".join(f"g_{n} * g_{n}" for n in NAMES)
            steps.append(f"select run, {epoch} as epoch, {batch} as batch, n as points, round(loss, 6) as loss, round(sqrt({norm}), 6) as gradient_norm, round(active, 6) as active from g{k}")
            k += 1
        parts.append(f"v{epoch} as (select run, avg(0.5 * (f - y) * (f - y)) as val_loss, avg(((f > 0.5) = (y > 0.5))::int) as val_accuracy from (select *, {f} as f from (select p.*, x1, x2, y, {net} from pts cross join p{k} p where event_id % 5 = 0)) group by run)")
        losses = " union all ".join(f"select run, n, loss from g{j}" for j in range(k - N_BATCHES, k))
        ends.append(f"select run, {epoch} as epoch, round((select sum(l.loss * l.n) / sum(l.n) from ({losses}) l where l.run = v.run), 6) as train_loss, round(val_loss, 6) as val_loss, round(val_accuracy, 6) as val_accuracy, val_loss as v from v{epoch} v")
    return f"with {', '.join(parts)}, steps as ({' union all '.join(steps)}), epochs as ({' union all '.join(ends)})"


@query("minibatch_steps", _train_sql() + " select * from steps")
def minibatch_steps(spark, sf):
    rounded = [F.round(c, 6).alias(c) for c in ("loss", "gradient_norm", "active")]
    return _trained(spark, sf)[0].select("run", "epoch", "batch", "points", *rounded)


@query("minibatch_epochs", _train_sql() + " select run, epoch, train_loss, val_loss, val_accuracy, row_number() over (partition by run order by v, epoch) = 1 as is_best from epochs")
def minibatch_epochs(spark, sf):
    rounded = [F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")]
    return checkpoints(_trained(spark, sf)[1]).select("run", "epoch", *rounded, "is_best")
