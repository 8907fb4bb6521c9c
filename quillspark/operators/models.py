"""Character n-gram models with Witten-Bell smoothing, and small pieces of attention models."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.splits import MEETINGS, learnt, with_split
from quillspark.plans.registry import query
from quillspark.sources.sinks import shared_table
from quillspark.sources.tables import documents, table

ORDER = 5


#: Grams that a task holds at most before it sends them on, and characters up to which short contexts are sent to all tasks.
HELD, SEND_CHARS = 1 << 17, 5_000
#: Characters that a task works on at once, and scored grams up to which they are sent to the tasks that hold the texts.
PIECE, SEND_GRAMS = 1 << 20, 8_000_000
#: Stands for no character, after the last code point.
BLANK = 0x110000


def pieces(texts: Iterable[str], order: int) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (number of the text, part of it, characters at its start that are only context), ``PIECE`` characters at once."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for start in range(0, len(text), PIECE):
            skip = min(start, order - 1)
            held.append((k, text[start - skip : start + PIECE], skip))
            size += len(held[-1][1])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def code_points(held: list[tuple[int, str, int]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with ``order - 1`` blanks before each piece, the places of all that are not only context, and how many each piece has."""
    sizes, skips = np.array([len(t) for _, t, _ in held], np.int64), np.array([k for *_, k in held], np.int64)
    place = np.arange(sizes.sum()) + np.repeat((order - 1) * np.arange(1, len(held) + 1), sizes)
    points = np.full(sizes.sum() + (order - 1) * len(held), BLANK, np.int32)
    points[place] = np.frombuffer("".join(t for _, t, _ in held).encode("utf-32-le", "surrogatepass"), "<u4")
    if skips.any():
        place = place[np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= np.repeat(skips, sizes)]
    return points, place, sizes - skips


def gram_keys(points: np.ndarray, place: np.ndarray, alphabet: np.ndarray, order: int) -> np.ndarray:
    """Each character and those before it in one number: places in the alphabet from 1, no character as 0."""
    ids = np.zeros(BLANK + 1, np.int64)
    ids[alphabet] = np.arange(1, len(alphabet) + 1)
    ids, bits = ids[points], len(alphabet).bit_length()
    keys = ids[place]
    for j in range(1, order):
        keys |= ids[place - j] << bits * j
    return keys


def fits(alphabet: np.ndarray, order: int) -> bool:
    return len(alphabet).bit_length() * order < 64


def counted(held: list[tuple[int, str, int]], order: int) -> tuple[list[str], np.ndarray]:
    """Distinct grams of all pieces together and how often each occurs."""
    points, place, _ = code_points(held, order)
    seen = np.zeros(BLANK + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen[:BLANK])
    if not fits(alphabet, order):
        found: Counter = Counter()
        for _, text, skip in held:
            found.update([text[max(0, i + 1 - order) : i + 1] for i in range(skip, len(text))])
        return list(found), np.array(list(found.values()), np.int64)
    keys, times = np.unique(gram_keys(points, place, alphabet, order), return_counts=True)
    bits = len(alphabet).bit_length()
    ids = np.stack([keys >> bits * j & (1 << bits) - 1 for j in range(order - 1, -1, -1)], axis=1)
    text = np.r_[0, alphabet].astype("<u4")[ids].tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.arange(1, len(keys) + 1) * order
    return [text[i:j] for i, j in zip((ends - (ids > 0).sum(axis=1)).tolist(), ends.tolist(), strict=True)], times


def grams(docs: DataFrame, keep: list[str], order: int = ORDER) -> DataFrame:
    """(keep, ctx, ch, n): each character with up to ``order - 1`` characters before it in its document.

    Counted inside tasks before anything moves: by document where columns are
    kept, else over a million characters of a task's documents at once.
    """
    source = docs.select(*keep, F.col("body").cast("string").alias("_body")).where("_body <> ''")

    def made(found: list[str], times: np.ndarray | list[int]) -> list[pa.Array]:
        return [pa.array([g[:-1] for g in found], pa.string()), pa.array([g[-1] for g in found], pa.string()), pa.array(times, pa.int64())]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for batch in batches for t in batch.column("_body").to_pylist())
        for held in pieces(texts, order):
            found, times = counted(held, order)
            for i in range(0, len(found), HELD):
                yield pa.RecordBatch.from_arrays(made(found[i : i + HELD], times[i : i + HELD]), ["ctx", "ch", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, times, at = [], [], []

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
            new = pa.RecordBatch.from_arrays(own + made(found, times), [*keep, "ctx", "ch", "n"])
            for x in (found, times, at):
                x.clear()
            return new

        for batch in batches:
            for k, body in enumerate(batch.column("_body").to_pylist()):
                counts = Counter([body[max(0, i + 1 - order) : i + 1] for i in range(len(body))])
                found += counts.keys()
                times += counts.values()
                at += [k] * len(counts)
                if len(found) >= HELD:
                    yield out(batch)
            if found:
                yield out(batch)

    kind = StructType([*source.select(*keep).schema.fields, *StructType.fromDDL("ctx string, ch string, n long").fields])
    return source.mapInArrow(each, kind) if keep else source.mapInArrow(together, kind).groupBy("ctx", "ch").agg(F.sum("n").alias("n"))


def ngram_counts_of(full: DataFrame, order: int = ORDER) -> DataFrame:
    """(k, ctx, ch, n) for contexts of k = 0 .. order - 1 characters, from counts of the longest ones."""
    ks = F.explode(F.sequence(F.lit(0), F.least(F.length("ctx"), F.lit(order - 1)))).alias("k")
    rows = full.select("ctx", "ch", "n", ks)
    return rows.select("k", F.when(F.col("k") == 0, "").otherwise(F.expr("right(ctx, k)")).alias("ctx"), "ch", "n").groupBy("k", "ctx", "ch").agg(F.sum("n").alias("n"))


def fitted_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts (k, ctx, ch, n) of all orders, fitted on documents of the learnt split only."""
    return ngram_counts_of(grams(learnt(docs), [], order), order)


def context_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("types"))


def contexts(counts: DataFrame) -> DataFrame:
    """(_k, _x, total, types, seen): each context with its next characters, no more than the alphabet."""
    seen = F.map_from_entries(F.collect_list(F.struct("ch", "n"))).alias("seen")
    return counts.groupBy(F.col("k").alias("_k"), F.col("ctx").alias("_x")).agg(F.sum("n").alias("total"), F.count("*").alias("types"), seen)


def looked_up(asked: DataFrame, known: DataFrame, n_chars: int, order: int = ORDER) -> DataFrame:
    """Rows with a column ``ctx``, one for each of its contexts k, with what is known of it (null if nothing).

    Contexts of no and of one character, which everything asks for, are sent to
    all tasks where the alphabet bounds them; only longer ones move.
    """
    ks = asked.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.length("ctx"), F.lit(order - 1)))))
    ks = ks.withColumn("_key", F.when(F.col("k") == 0, "").otherwise(F.expr("right(ctx, k)")))
    match = (F.col("k") == F.col("_k")) & (F.col("_key") == F.col("_x"))
    short = known.where("_k <= 1")
    short = F.broadcast(short) if n_chars <= SEND_CHARS else short
    return ks.where("k <= 1").join(short, match, "left").unionByName(ks.where("k > 1").join(known.where("_k > 1"), match, "left"))


def witten_bell(wanted: DataFrame, counts: DataFrame, n_chars: int, order: int = ORDER) -> DataFrame:
    """(ctx, ch, p) for distinct pairs: interpolation from the empty context up, over the contexts that were seen.

    The pairs of a context ask for all its contexts together; counts of their
    characters come back and are folded from the shortest context up.  A longer
    context than an unseen one is unseen too, so what is missing keeps the
    probability reached so far.
    """
    asked = wanted.groupBy("ctx").agg(F.collect_set("ch").alias("chars"))
    found = looked_up(asked, contexts(counts), n_chars, order)
    own = F.transform("chars", lambda c: F.coalesce(F.try_element_at("seen", c), F.lit(0)))
    found = found.select("ctx", "chars", F.struct("k", own.alias("n"), "total", "types").alias("s"))
    by = found.groupBy("ctx").agg(F.sort_array(F.collect_list("s")).alias("steps"), F.any_value("chars").alias("chars"))
    each = by.select("ctx", "steps", F.posexplode("chars").alias("_i", "ch"))
    folded = F.aggregate("steps", F.lit(1.0 / n_chars), lambda p, s: F.when(s["total"].isNull(), p).otherwise((F.get(s["n"], F.col("_i")) + s["types"] * p) / (s["total"] + s["types"])))
    return each.select("ctx", "ch", folded.alias("p"))


GRAMS = f"""{MEETINGS}, cs as (select doc_id, split, list_filter(string_split(body, ''), lambda c: c <> '') as c from split_docs),
pos as materialized (select doc_id, split, unnest(c) as ch, generate_subscripts(c, 1) as i from cs),
each as (select doc_id, split, coalesce(lag(ch, 4) over w, '') || coalesce(lag(ch, 3) over w, '') || coalesce(lag(ch, 2) over w, '') || coalesce(lag(ch, 1) over w, '') as ctx, ch from pos window w as (partition by doc_id order by i)),
g as materialized (select doc_id, split, ctx, ch, count(*) as n from each group by all),
t as (select ctx, ch, sum(n)::bigint as n from g where split = 'T' group by all),
k as materialized (select k::int as k, case when k = 0 then '' else right(ctx, k) end as ctx, ch, sum(n)::bigint as n from (select *, unnest(range(0, least(length(ctx), 4) + 1)) as k from t) group by all),
st as materialized (select k, ctx, sum(n)::bigint as total, count(*) as types from k group by all)"""


def STEP(k: int) -> str:
    """Probability over contexts of up to ``k`` characters from the one before."""
    return f"case when t{k} is null then p else (n{k} + y{k} * p) / (t{k} + y{k}) end as p"


PROB = f"""{GRAMS}, want as materialized (select distinct ctx, ch from g where split in ('N', 'F')),
ask as (select ctx, ch, k::int as k, case when k = 0 then '' else right(ctx, k) end as x from (select *, unnest(range(0, least(length(ctx), 4) + 1)) as k from want)),
got as (select a.ctx, a.ch, a.k, s.total, s.types, coalesce(c.n, 0) as n from ask a left join st s on s.k = a.k and s.ctx = a.x left join k c on c.k = a.k and c.ctx = a.x and c.ch = a.ch),
wide as (select ctx, ch, {", ".join(f"max(total) filter (k = {k}) as t{k}, max(types) filter (k = {k}) as y{k}, max(n) filter (k = {k}) as n{k}" for k in range(5))} from got group by ctx, ch),
p0 as (select * replace ({STEP(0)}) from (select *, 1.0::double / (select count(distinct ch) from k) as p from wide)),
p1 as (select * replace ({STEP(1)}) from p0), p2 as (select * replace ({STEP(2)}) from p1), p3 as (select * replace ({STEP(3)}) from p2), p4 as materialized (select * replace ({STEP(4)}) from p3),
nll as (select doc_id, split, sum(-ln(p) * n) as total_nll, sum(n)::bigint as body_tokens from g join p4 using (ctx, ch) where split in ('N', 'F') group by all)"""


def fitted(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Scored documents, and the probabilities of their grams by the learnt counts."""
    docs = shared_table(with_split(documents(spark, sf)).where("split in ('T', 'N', 'F')").select("doc_id", "split", "body"))  # read by the fit and by the scores
    counts = shared_table(fitted_counts(docs.where("split = 'T'")))  # every order reads them
    n_chars = counts.where("k = 0").count()
    scored = docs.where("split in ('N', 'F')")
    return scored, witten_bell(grams(scored, []).select("ctx", "ch"), counts, n_chars)


def text_scores(docs: DataFrame, p: DataFrame, order: int = ORDER, send: int = SEND_GRAMS) -> DataFrame:
    """(doc_id, split, total_nll, body_tokens) of texts that are not empty, by the probabilities of all their grams.

    Distinct grams are few beside the texts: they are sent to the tasks that
    hold these, and a text sends on one row.  More than ``send`` of them, or
    grams of too many different characters for one number, are joined.
    """
    n = p.count()
    letters = p.select("ch").union(p.select(F.explode(F.split("ctx", "")))).where("ch <> ''").distinct().limit(SEND_CHARS + 1).collect() if n <= send else []
    alphabet = np.array(sorted(ord(r.ch) for r in letters), np.int64)
    if n > send or len(letters) > SEND_CHARS or not fits(alphabet, order):
        rows = grams(docs, ["doc_id", "split"], order).join(p, ["ctx", "ch"]).select("doc_id", "split", (-F.log("p") * F.col("n")).alias("s"), "n")
    else:
        known = p.select(F.concat("ctx", "ch").alias("g"), (-F.log("p")).alias("v")).toArrow()
        points, place, sizes = code_points([(0, g, 0) for g in known.column("g").to_pylist()], order)
        keys = gram_keys(points, place[np.cumsum(sizes) - 1], alphabet, order)
        by = np.argsort(keys)
        sent = docs.sparkSession.sparkContext.broadcast((alphabet, keys[by], known.column("v").to_numpy()[by]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            alphabet, keys, values = sent.value
            for batch in batches:
                at, sums, counts = [], [], []
                for held in pieces(batch.column("body").to_pylist(), order):
                    points, place, sizes = code_points(held, order)
                    asked = gram_keys(points, place, alphabet, order)
                    found = np.searchsorted(keys, asked)
                    if not (keys[np.minimum(found, len(keys) - 1)] == asked).all():
                        raise ValueError("a text has a gram without a probability")
                    at += [k for k, *_ in held]
                    sums.append(np.add.reduceat(values[found], np.cumsum(sizes) - sizes))
                    counts.append(sizes)
                if at:
                    own = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "split")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(sums)), pa.array(np.concatenate(counts), pa.int64())], ["doc_id", "split", "s", "n"])

        source = docs.select("doc_id", "split", "body").where("body <> ''")
        rows = source.mapInArrow(run, StructType([*source.select("doc_id", "split").schema.fields, *StructType.fromDDL("s double, n long").fields]))
    return rows.groupBy("doc_id", "split").agg(F.sum("s").alias("total_nll"), F.sum("n").alias("body_tokens"))


def scores(spark, sf) -> DataFrame:
    """(doc_id, split, total_nll, body_tokens, bpc) of every document outside the learnt split."""
    docs, p = fitted(spark, sf)
    return text_scores(docs, shared_table(p)).withColumn("bpc", F.col("total_nll") / (F.col("body_tokens") * math.log(2)))


@query("ngram_counts", f"with {GRAMS} select * from k")
def ngram_counts(spark, sf):
    return fitted_counts(with_split(documents(spark, sf)).where("split = 'T'"))


@query("ngram_context_stats", f"with {GRAMS} select * from st")
def ngram_context_stats(spark, sf):
    return context_stats(ngram_counts(spark, sf))


@query("witten_bell_prob", f"with {PROB} select ctx, ch, round(p, 9) as p from p4")
def witten_bell_prob(spark, sf):
    return fitted(spark, sf)[1].withColumn("p", F.round("p", 9))


@query("ngram_nll", f"with {PROB} select doc_id, split, round(total_nll, 4) as total_nll from nll")
def ngram_nll(spark, sf):
    return scores(spark, sf).select("doc_id", "split", F.round("total_nll", 4).alias("total_nll"))


@query("ngram_bpc", f"with {PROB} select doc_id, split, body_tokens, round(total_nll / (body_tokens * ln(2)), 6) as bpc from nll")
def ngram_bpc(spark, sf):
    return scores(spark, sf).select("doc_id", "split", "body_tokens", F.round("bpc", 6).alias("bpc"))


@query("greedy_next_char", f"with {GRAMS} select ctx, arg_max(ch, [n, -unicode(ch)]) as ch from k where k = 2 group by ctx")
def greedy_next_char(spark, sf):
    return ngram_counts(spark, sf).where("k = 2").groupBy("ctx").agg(F.max_by("ch", F.struct("n", -F.ascii("ch"))).alias("ch"))


# Attention over a table of vectors; each vector attends inside its own group of neighbours.


def attention_rows(vectors: DataFrame, group: str, id: str, vector: str, causal: bool) -> DataFrame:
    """(group, i, j, a): softmax of scaled dot products inside a group, over j <= i if causal.

    Groups are blocks of bounded size, so the pairs are those that attention asks for.
    """
    q = vectors.select(group, F.col(id).alias("i"), F.col(vector).alias("q"))
    k = vectors.select(group, F.col(id).alias("j"), F.col(vector).alias("k"))
    pairs = q.join(k, group)
    pairs = pairs.where("j <= i") if causal else pairs
    dot = F.expr("aggregate(zip_with(q, k, (x, y) -> double(x) * double(y)), 0D, (a, x) -> a + x) / sqrt(size(q))")
    s = pairs.select(group, "i", "j", dot.alias("s"))
    w = Window.partitionBy(group, "i")
    s = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return s.select(group, "i", "j", (F.col("e") / F.sum("e").over(w)).alias("a"))


def attended(weights: DataFrame, vectors: DataFrame, group: str, id: str, vector: str) -> DataFrame:
    """(i, d, y): weighted sums of the vectors' components."""
    v = vectors.select(group, F.col(id).alias("j"), F.posexplode(vector).alias("d", "v"))
    return weights.join(v, [group, "j"]).groupBy("i", "d").agg(F.sum(F.col("a") * F.col("v")).alias("y"))


ATTENTION = """e as (select vec_id, vec_id // 16 as blk, embedding from embeddings),
s as (select q.blk, q.vec_id as i, k.vec_id as j, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda x: q.embedding[x]::double * k.embedding[x]::double)) / sqrt(len(q.embedding)) as s from e q join e k on q.blk = k.blk {where}),
x as (select *, exp(s - max(s) over (partition by i)) as x from s), a as (select blk, i, j, x / sum(x) over (partition by i) as a from x)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.expr("vec_id div 16").alias("blk"), "embedding")


@query("attention", "with " + ATTENTION.format(where="") + """, v as (select vec_id as j, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as d from e)
select i, d::int as d, round(sum(a * v), 5) as y from a join v using (j) group by all""")  # fmt: skip
def attention(spark, sf):
    v = _vectors(spark, sf)
    return attended(attention_rows(v, "blk", "vec_id", "embedding", False), v, "blk", "vec_id", "embedding").withColumn("y", F.round("y", 5))


@query("causal_attention", "with " + ATTENTION.format(where="where k.vec_id <= q.vec_id") + " select i, j, round(a, 6) as a from a")
def causal_attention(spark, sf):
    return attention_rows(_vectors(spark, sf), "blk", "vec_id", "embedding", True).select("i", "j", F.round("a", 6).alias("a"))


@query("causal_mask", "select i, j, j <= i as visible, case when j <= i then 0.0::double else '-infinity'::double end as additive from range(0, 16) a(i), range(0, 16) b(j)")
def causal_mask(spark, sf):
    return mask(spark, 16)


def mask(spark, n: int) -> DataFrame:
    """Which of ``n`` positions sees which, and the same as a term to add."""
    ij = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j"))
    return ij.select("i", "j", (F.col("j") <= F.col("i")).alias("visible"), F.when(F.col("j") <= F.col("i"), 0.0).otherwise(float("-inf")).alias("additive"))


@query(
    "layer_norm",
    """with s as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as d from embeddings)
    select vec_id, d::int as d, round((v - avg(v) over w) / sqrt(var_pop(v) over w + 1e-5), 5) as y from s window w as (partition by vec_id)""",
)
def layer_norm(spark, sf):
    return normed(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("y", F.round("y", 5))


def normed(rows: DataFrame, id: str, vector: str, eps: float = 1e-5) -> DataFrame:
    """Components less their mean over the deviation, computed inside the row."""
    x = rows.select(id, F.transform(vector, lambda v: v.cast("double")).alias("x"))
    x = x.withColumn("m", F.expr("aggregate(x, 0D, (a, v) -> a + v) / size(x)"))
    x = x.withColumn("s", F.expr(f"sqrt(aggregate(x, 0D, (a, v) -> a + (v - m) * (v - m)) / size(x) + {eps}D)"))
    return x.select(id, F.posexplode(F.expr("transform(x, v -> (v - m) / s)")).alias("d", "y"))


@query("positional_encoding", "select p as pos, i as dim, round(case when i % 2 = 0 then sin(p / power(10000.0::double, (i - i % 2) / 64.0)) else cos(p / power(10000.0::double, (i - i % 2) / 64.0)) end, 6) as v from range(0, 128) a(p), range(0, 64) b(i)")
def positional_encoding(spark, sf):
    return positions(spark, 128, 64).withColumn("v", F.round("v", 6))


def positions(spark, n: int, dim: int) -> DataFrame:
    """Sines and cosines in turn, of falling frequency."""
    rows = spark.range(n).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))).alias("dim"))
    angle = F.col("pos") / F.pow(F.lit(10000.0), (F.col("dim") - F.col("dim") % 2) / dim)
    return rows.select("pos", "dim", F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("v"))


@query(
    "cross_entropy",
    """with s as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as d from embeddings)
    select vec_id, round(max(v) + ln(sum(exp(v - m))) - max(v) filter (d = label % 64), 6) as loss from (select *, max(v) over (partition by vec_id) as m from s) group by vec_id""",
)
def cross_entropy(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("label") % 64).alias("t"))
    x = x.withColumn("m", F.array_max("x"))
    loss = F.expr("m + ln(aggregate(x, 0D, (a, v) -> a + exp(v - m))) - x[t]")
    return x.select("vec_id", F.round(loss, 6).alias("loss"))


@query(
    "topk_filter",
    """with s as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as d from embeddings)
    select vec_id, d::int as d from (select *, rank() over (partition by vec_id order by v desc) as r from s) where r <= 5""",
)
def topk_filter(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("kth", F.get(F.sort_array("embedding", asc=False), F.lit(4)))
    return rows.select("vec_id", "kth", F.posexplode("embedding").alias("d", "v")).where("v >= kth").select("vec_id", "d")


class CharTransformer:
    """A one-block attention model over characters with fixed weights; uniform where all weights are zero."""

    def __init__(self, vocabulary: int, dim: int = 16, seed: int | None = 3):
        draw = np.random.default_rng(seed or 0)
        scale = 0.0 if seed is None else 0.2
        self.embed = scale * draw.standard_normal((vocabulary, dim))
        self.q, self.k, self.v = (scale * draw.standard_normal((dim, dim)) for _ in range(3))

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed[ids]
        s = (x @ self.q) @ (x @ self.k).T / math.sqrt(x.shape[1])
        s = np.where(np.tril(np.ones(s.shape, bool)), s, -np.inf)
        a = np.exp(s - s.max(axis=1, keepdims=True))
        logits = (x + (a / a.sum(axis=1, keepdims=True)) @ (x @ self.v)) @ self.embed.T
        top = logits.max(axis=1, keepdims=True)
        return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


    def target_logs(self, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """For many sequences of one length the log-probability of a target after each of their last places.

        As :meth:`log_probs`, but only of what is asked for; (sequence, place) in and out.
        """
        x = self.embed[ids]
        m = targets.shape[1]
        last = x[:, -m:]
        s = (last @ self.q) @ (x @ self.k).transpose(0, 2, 1)
        s /= math.sqrt(x.shape[2])
        s[:, ~np.tri(m, x.shape[1], x.shape[1] - m, dtype=bool)] = -np.inf
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        y = (last + s @ (x @ self.v)).reshape(-1, x.shape[2])
        logits = y @ self.embed.T
        top = logits.max(axis=1)
        found = logits[np.arange(len(y)), targets.ravel()] - top
        logits -= top[:, None]
        np.exp(logits, out=logits)
        return (found - np.log(logits.sum(axis=1))).reshape(targets.shape)


def scored_windows(n: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(context, start, stop) of the windows over ``n`` ids: places from start on are scored, after what stands from context on."""
    for start in range(2, n, block // 2):
        stop = min(start + block // 2, n)
        yield max(0, stop - 1 - block), start, stop


#: Windows of one length that are scored at once; what they take stays in a core's cache.
WINDOWS = 16


def transformer_scores(docs: DataFrame, vocab: dict[str, int], model: CharTransformer, block: int = 64) -> DataFrame:
    """(doc_id, total_nll, body_tokens): windowed log-likelihoods, every character scored once in context."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, model = sent.value
        known = np.zeros(BLANK, np.int32)
        for c, i in vocab.items():
            if len(c) == 1:
                known[ord(c)] = i
        for frame in frames:
            bodies = [body or "" for body in frame.body]
            sizes = np.array([len(body) for body in bodies], np.int64)
            total = np.zeros(len(frame))
            groups: dict[int, list[tuple[int, int, int, int]]] = {}

            def score(length: int, some: list[tuple[int, int, int, int]], total: np.ndarray) -> None:
                doc, first, stop, n = np.array(some).T
                m = int(n.max())
                logs = model.target_logs(ids[first[:, None] + np.arange(length)], ids[stop[:, None] + np.arange(-m, 0)])
                logs[np.arange(m) < m - n[:, None]] = 0  # scored in the window before
                np.subtract.at(total, doc, logs.sum(axis=1))

            rows = enumerate(zip(frame.genre, bodies, strict=True))
            while (held := next(rows, None)) is not None:
                parts, base = [], 0
                while held is not None:
                    k, (genre, body) = held
                    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")
                    parts += [np.array([0, 1 if genre == "statement" else 2], np.int32), known[points]]
                    for ctx, start, stop in scored_windows(len(body) + 2, block):
                        groups.setdefault(stop - 1 - ctx, []).append((k, base + ctx, base + stop, stop - start))
                    base += len(body) + 2
                    held = next(rows, None) if base < PIECE else None
                ids = np.concatenate(parts)
                for length, found in groups.items():
                    for i in range(0, len(found), WINDOWS):
                        score(length, found[i : i + WINDOWS], total)
                groups.clear()
            yield pd.DataFrame({"doc_id": frame.doc_id, "total_nll": total, "body_tokens": sizes})

    parts = 4 * docs.sparkSession.sparkContext.defaultParallelism  # the texts are small beside the work on them
    return docs.select("doc_id", "genre", "body").repartition(parts, "doc_id").mapInPandas(run, "doc_id long, total_nll double, body_tokens long")


@query("transformer_nll")
def transformer_nll(spark, sf):
    from quillspark.operators.tokens import char_vocabulary, vocabulary_map

    docs = with_split(documents(spark, sf))
    vocab = vocabulary_map(char_vocabulary(docs.where("split = 'T'")))
    found = transformer_scores(docs.where("split in ('N', 'F')"), vocab, CharTransformer(len(vocab)))
    return found.withColumn("bpc", F.when(F.col("body_tokens") > 0, F.col("total_nll") / (F.col("body_tokens") * math.log(2))))
