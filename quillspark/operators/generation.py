"""Texts continued by the character model, all sequences a step at a time.

A step is one pass over a written table of sequences: the distinct last
contexts ask the n-gram counts, each gets the probability of every character of
the alphabet, and every sequence draws from its context's.  Logits are the logs
of the probabilities; they are divided by the temperature, of those below the
k-th largest none is drawn (those equal to it may be), and a draw is a hash of
sequence, step and seed against the cumulated weights.  Greedy takes the
largest, of equal ones the first in order of code points.

Nulls and edges: a null or empty prompt starts from the empty context; a
character that was never seen leaves the contexts with it unknown; repeated ids
with one prompt continue alike; no prompt gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.models import GRAMS, ORDER, contexts, fitted_counts, looked_up
from quillspark.operators.splits import with_split
from quillspark.operators.stats import draw
from quillspark.plans.registry import query
from quillspark.sources.sinks import shared_table
from quillspark.sources.tables import documents

#: Bits of a draw.
BITS = 32


def distributions(wanted: DataFrame, known: DataFrame, alphabet: list[str], order: int) -> DataFrame:
    """(ctx, p): the probability of every character of the alphabet after each distinct context."""
    found = looked_up(wanted, known, len(alphabet), order).select("ctx", F.struct("k", "total", "types", F.map_entries("seen").alias("seen")).alias("s"))
    steps = found.groupBy("ctx").agg(F.sort_array(F.collect_list("s")).alias("steps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: i for i, c in enumerate(alphabet)}
        for batch in batches:
            out = np.full((batch.num_rows, len(alphabet)), 1.0 / len(alphabet))
            for p, steps in zip(out, batch.column("steps").to_pylist(), strict=True):
                for s in steps:  # from the shortest context up
                    if s["total"] is not None:
                        n = np.zeros(len(alphabet))
                        n[[place[e["key"]] for e in s["seen"]]] = [e["value"] for e in s["seen"]]
                        p[:] = (n + s["types"] * p) / (s["total"] + s["types"])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(alphabet), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("ctx"), rows], ["ctx", "p"])

    return steps.mapInArrow(run, "ctx string, p array<double>")


def weights(p: DataFrame, power: float, top_k: int | None) -> DataFrame:
    """(ctx, upto, best): cumulated weights of the characters that may be drawn, and the place of the likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            w = p**power
            if top_k:
                w[w < np.sort(w, axis=1)[:, [-min(top_k, w.shape[1])]]] = 0
            upto = np.cumsum(w, axis=1)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(upto.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("ctx"), rows, pa.array(p.argmax(axis=1))], ["ctx", "upto", "best"])

    return p.mapInArrow(run, "ctx string, upto array<double>, best long")


def generate(prompts: DataFrame, counts: DataFrame, steps: int, id: str = "id", text: str = "text", order: int = ORDER, temperature: float = 1.0, greedy: bool = False, top_k: int | None = None, seed: int = 0) -> DataFrame:
    """(id, text, new): prompts continued by ``steps`` characters, by counts (k, ctx, ch, n) of all orders."""
    alphabet = sorted(r.ch for r in counts.where("k = 0").select("ch").collect())  # the characters of a script
    if not alphabet:
        raise ValueError("nothing was counted")
    known = shared_table(contexts(counts))
    rows = prompts.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit("").alias("new"))
    for step in range(steps):
        rows = shared_table(rows.withColumn("ctx", F.when(F.lit(order < 2), "").otherwise(F.expr(f"right(concat(text, new), {max(order - 1, 1)})"))))
        p = distributions(rows.select("ctx").distinct(), known, alphabet, order)
        p = weights(p, 1 / max(temperature, 1e-8), top_k)
        rows = rows.join(p, "ctx")
        u = (draw(F.lit("generate"), F.lit(seed), F.lit(step), F.col("id"), n=F.lit(1 << BITS)) + 0.5) / float(1 << BITS)
        rows = rows.withColumn("u", u * F.element_at("upto", -1)).where(F.spark_partition_id() >= 0)  # keeps the draw out of the loop below
        place = F.size(F.filter("upto", lambda c: c <= F.col("u")))
        rows = rows.withColumn("at", F.col("best") if greedy else F.least(place, F.lit(len(alphabet) - 1)))
        rows = rows.select("id", "text", F.concat("new", F.get(F.array(*map(F.lit, alphabet)), F.col("at").cast("int"))).alias("new"))
    return rows


#: Prompt length, new characters and the way of drawing of the queries.
PROMPT, NEW, TEMPERATURE, TOP, SEED = 6, 3, 0.8, 5, 7


def _step(i: int) -> str:
    p = "1.0::double / n_chars"
    joins = ""
    for k in range(ORDER):
        x = "''" if k == 0 else f"right(s.t, {k})"
        p = f"case when t{k}.total is null then {p} else (coalesce(n{k}.n, 0) + t{k}.types * ({p})) / (t{k}.total + t{k}.types) end"
        there = f" and length(s.t) >= {k}" if k else ""
        joins += f" left join st t{k} on t{k}.k = {k} and t{k}.ctx = {x}{there} left join k n{k} on n{k}.k = {k} and n{k}.ctx = {x} and n{k}.ch = c.ch{there}"
    return f"""p{i} as materialized (select doc_id, t, c.ch, {p} as p from s{i} s cross join chars c{joins}),
    r{i} as (select *, pow(p, 1 / {TEMPERATURE}::double) as w, rank() over (partition by doc_id order by p desc) as r from p{i}),
    w{i} as (select *, sum(case when r <= {TOP} then w else 0 end) over (partition by doc_id order by ch) as c, sum(case when r <= {TOP} then w else 0 end) over (partition by doc_id) as s,
      (('0x' || substr(md5('generate|{SEED}|{i}|' || doc_id), 1, 8))::bigint + 0.5) / {1 << BITS}.0::double as u from r{i}),
    s{i + 1} as materialized (select doc_id, t || min(ch) filter (c > u * s) as t from w{i} group by doc_id, t)"""


@query(
    "generated_text",
    f"""with {GRAMS}, chars as (select ch, count(*) over () as n_chars from k where k = 0), s0 as (select doc_id, left(body, {PROMPT}) as t from split_docs where split in ('N', 'F')),
    {", ".join(map(_step, range(NEW)))} select doc_id, t as text from s{NEW}""",
)
def generated_text(spark, sf):
    """The openings of all documents outside the learnt split, continued by draws from the learnt model."""
    docs = with_split(documents(spark, sf))
    counts = shared_table(fitted_counts(docs.where("split = 'T'")))
    prompts = docs.where("split in ('N', 'F')").select("doc_id", F.substring("body", 1, PROMPT).alias("text"))
    made = generate(prompts, counts, NEW, "doc_id", temperature=TEMPERATURE, top_k=TOP, seed=SEED)
    return made.select(F.col("id").alias("doc_id"), F.concat("text", "new").alias("text"))
