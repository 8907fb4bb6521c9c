"""Attention blocks over groups of vectors, choosing the next token, and checks of document scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import models
from quillspark.operators.splits import MEETINGS, with_split
from quillspark.operators.windows import draw
from quillspark.plans.registry import query
from quillspark.sources.tables import documents, table

GROUP, HEADS = 16, 4


def fixed_weights(rows: int, columns: int, phase: int) -> np.ndarray:
    """A matrix whose entries follow from their place, the same in every engine."""
    r, c = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return np.cos(r * 7 + c * 3 + phase) / math.sqrt(rows)


def heads_of(x: np.ndarray, heads: int) -> np.ndarray:
    """(length, width) as (heads, length, width / heads)."""
    return x.reshape(len(x), heads, -1).transpose(1, 0, 2)


def attended_heads(x: np.ndarray, qkv: np.ndarray, out: np.ndarray, heads: int, causal: bool = True) -> np.ndarray:
    """Self-attention with several heads: projections without bias, softmax of scaled products, heads side by side, projected once more."""
    q, k, v = (heads_of(part, heads) for part in np.split(x @ qkv, 3, axis=1))
    s = q @ k.transpose(0, 2, 1) / math.sqrt(q.shape[2])
    if causal:
        s = np.where(np.tril(np.ones(s.shape[1:], bool)), s, -np.inf)
    a = np.exp(s - s.max(axis=2, keepdims=True))
    y = (a / a.sum(axis=2, keepdims=True)) @ v
    return y.transpose(1, 0, 2).reshape(len(x), -1) @ out


def normed_rows(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + eps)


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function."""
    return 0.5 * x * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def block(x: np.ndarray, heads: int, wide: int) -> np.ndarray:
    """x plus attention over its normed rows, then plus a GELU layer over those of the sum."""
    d = x.shape[1]
    x = x + attended_heads(normed_rows(x), fixed_weights(d, 3 * d, 1), fixed_weights(d, d, 2), heads)
    return x + gelu(normed_rows(x) @ fixed_weights(d, wide, 3)) @ fixed_weights(wide, d, 4)


def by_group(rows: DataFrame, change) -> DataFrame:
    """(vec_id, d, y): a function of each group's matrix; groups are ``GROUP`` neighbouring ids, so a task holds few rows."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        y = change(np.array(frame.embedding.tolist(), float))
        return pd.DataFrame({"vec_id": np.repeat(frame.vec_id.to_numpy(), y.shape[1]), "d": np.tile(np.arange(y.shape[1], dtype=np.int32), len(y)), "y": y.ravel()})
    keyed = rows.select("vec_id", "embedding", F.expr(f"vec_id div {GROUP}").alias("blk"))
    return keyed.groupBy("blk").applyInPandas(run, "vec_id long, d int, y double")


HEADS_SQL = f"""e as (select vec_id, vec_id // {GROUP} as blk, len(embedding) as w, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as d from embeddings),
c as (select distinct w, unnest(range(0, 3 * w)) as c from e), p as (select vec_id, blk, w, c, sum(v * cos(d * 7 + c * 3 + 1) / sqrt(w)) as v from e join c using (w) group by all),
q as (select *, c // (w // {HEADS}) as h, c % (w // {HEADS}) as k from p where c < w), k as (select *, (c - w) // (w // {HEADS}) as h, c % (w // {HEADS}) as k from p where c >= w and c < 2 * w), v as (select *, (c - 2 * w) // (w // {HEADS}) as h, c % (w // {HEADS}) as k from p where c >= 2 * w),
s as (select q.blk, q.h, q.vec_id as i, k.vec_id as j, sum(q.v * k.v) / sqrt(any_value(q.w) / {HEADS}) as s from q join k on q.blk = k.blk and q.h = k.h and q.k = k.k and k.vec_id <= q.vec_id group by all),
x as (select *, exp(s - max(s) over (partition by h, i)) as x from s), a as (select blk, h, i, j, x / sum(x) over (partition by h, i) as a from x),
y as (select a.i as vec_id, a.h * (v.w // {HEADS}) + v.k as d, any_value(v.w) as w, sum(a.a * v.v) as y from a join v on v.blk = a.blk and v.h = a.h and v.vec_id = a.j group by all)"""


@query("multihead_attention", f"with {HEADS_SQL}, o as (select vec_id, c.c as d, sum(y * cos(y.d * 7 + c.c * 3 + 2) / sqrt(y.w)) as y from y join c on c.w = y.w and c.c < y.w group by all) select vec_id, d::int as d, round(y, 4) as y from o")
def multihead_attention(spark, sf):
    def change(x: np.ndarray) -> np.ndarray:
        return attended_heads(x, fixed_weights(x.shape[1], 3 * x.shape[1], 1), fixed_weights(x.shape[1], x.shape[1], 2), HEADS)
    return by_group(table(spark, sf, "embeddings"), change).withColumn("y", F.round("y", 4))


@query("transformer_block")
def transformer_block(spark, sf):
    """A block of attention and a GELU layer, each over normed rows and added to what came in."""
    return by_group(table(spark, sf, "embeddings"), lambda x: block(x, HEADS, 4 * x.shape[1])).withColumn("y", F.round("y", 4))


def next_tokens(rows: DataFrame, id: str, logits: str, temperature: float, top_k: int | None, seed: int) -> DataFrame:
    """(id, greedy, sampled): the largest logit's place, and one drawn from the softmax at a temperature.

    Of logits below the k-th largest none is drawn, those equal to it may be.
    The draw is a hash of id and seed against the cumulated softmax.
    """
    x = rows.select(id, F.transform(logits, lambda v: v.cast("double") / max(temperature, 1e-8)).alias("x"))
    kth = F.get(F.sort_array("x", asc=False), F.least(F.lit(top_k), F.size("x")) - 1) if top_k else F.array_min("x")
    x = x.withColumn("m", F.array_max("x")).withColumn("kth", kth)
    x = x.withColumn("e", F.expr("transform(x, v -> case when v >= kth then exp(v - m) else 0D end)"))
    u = (draw(F.lit("next"), F.lit(seed), F.col(id), n=F.lit(1 << 32)) + 0.5) / float(1 << 32)
    x = x.withColumn("u", u * F.expr("aggregate(e, 0D, (a, v) -> a + v)"))
    place = F.expr("aggregate(e, struct(0D as sum, 0 as n), (a, v) -> struct(a.sum + v as sum, a.n + cast(a.sum + v <= u as int) as n), a -> a.n)")
    return x.select(id, (F.array_position("x", F.col("m")) - 1).cast("int").alias("greedy"), place.cast("int").alias("sampled"))


@query(
    "next_token",
    """with s as (select vec_id, unnest(embedding)::double / 0.7 as x, generate_subscripts(embedding, 1) - 1 as d from embeddings), r as (select *, max(x) over w as m, rank() over (partition by vec_id order by x desc) as r from s window w as (partition by vec_id)),
    e as (select vec_id, d, x, case when r <= 5 then exp(x - m) else 0 end as e from r), c as (select *, sum(e) over (partition by vec_id order by d) as c, sum(e) over (partition by vec_id) as t from e),
    u as (select *, (('0x' || substr(md5('next|11|' || vec_id), 1, 8))::bigint + 0.5) / 4294967296.0::double * t as u from c)
    select vec_id, arg_max(d, [x, -d])::int as greedy, count(*) filter (c <= u)::int as sampled from u group by vec_id""",
)
def next_token(spark, sf):
    return next_tokens(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.7, 5, 11)


def score_checks(docs: DataFrame, vocab: dict[str, int], size: int = 64) -> DataFrame:
    """(doc_id, round_trips, n_targets, first_target, is_once): whether a text comes back from its ids, and which places the scorer's windows score.

    The two places before the body (start and genre) are never scored, and each
    place of the body is, once: windows overlap, targets do not.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ["doc_id", "round_trips", "n_targets", "first_target", "is_once"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = sent.value
        back = {i: c for c, i in vocab.items()}
        for frame in frames:
            rows = []
            for doc, body in zip(frame.doc_id, frame.body, strict=True):
                ids = [vocab.get(c, -1) for c in body or ""]
                seen = [t for _, start, stop in models.scored_windows(len(ids) + 2, size) for t in range(start, stop)]
                rows.append((doc, "".join(back.get(i, "") for i in ids) == (body or ""), len(seen), min(seen, default=None), seen == list(range(2, len(ids) + 2))))
            yield pd.DataFrame(rows, columns=names).astype({"first_target": "Int64"})

    return docs.select("doc_id", "body").mapInPandas(run, "doc_id long, round_trips boolean, n_targets long, first_target long, is_once boolean")


@query(
    "document_score_checks",
    f"""with {MEETINGS}, a as (select distinct unnest(string_split(body, '')) as c from split_docs where split = 'T'), b as (select doc_id, unnest(list_distinct(string_split(body, ''))) as c from split_docs where split in ('N', 'F')),
    bad as (select distinct doc_id from b where c <> '' and c not in (select c from a))
    select doc_id, doc_id not in (select doc_id from bad) as round_trips, length(body) as n_targets, case when length(body) > 0 then 2::bigint end as first_target, true as is_once from split_docs where split in ('N', 'F')""",
)
def document_score_checks(spark, sf):
    from quillspark.operators.tokens import char_vocabulary, vocabulary_map

    docs = with_split(documents(spark, sf))
    return score_checks(docs.where("split in ('N', 'F')"), vocabulary_map(char_vocabulary(docs.where("split = 'T'"))))
