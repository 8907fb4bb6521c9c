"""Toxicity by class-conditional models of words and word pairs with shared backoff counts.

Two models, of toxic and of ordinary labelled texts, give a text its
log-likelihoods; their difference, divided by the text's words, is the evidence.

*Counts.*  As Kneser-Ney counts contexts and not tokens, ``n_c(x)`` is the number
of different texts of class c that hold the expression x, a word or a word after
a word: one text that repeats a word, and exact copies of one text, prove
nothing more.  Every expression of every learnt row is counted.

*Backoff.*  Both classes share the pooled counts n(x) = n_t(x) + n_o(x).  Of them
a class may expect ``e_c(x) = n(x) * N_c / N``, N_c being all counts of its kind
in the class.  What a class shows beyond or below that is discounted, and the
discount goes back to the shared counts:

    f_c(x) = (e_c + sign(n_c - e_c) * max(|n_c - e_c| - D * sqrt(e_c + 1), 0)) / e_c

so P_c(w) = f_c(w) * P_shared(w).  The discount grows with the count's standard
error instead of being the constant of plain Kneser-Ney, for with the constant
the chance counts of rare words outweigh all else (README has the figures).  Rare
expressions fall back on the shared counts; common ones keep their difference, in
either direction.  A pair backs off to its word: its expected odds of the classes
are those of all pairs times f_t / f_o of both words, and

    log P_t(w | v) / P_o(w | v) = log f_t(w) / f_o(w) + log f_t(v w) / f_o(v w).

*Link.*  A logistic function of the length-normalised evidence and the text's
length gives the score, fitted on at most ``FIT_ROWS`` learnt rows with the
smallest id hashes (documented bound), each scored without its own counts.

Counts are aggregated in tasks before they move and texts never move.  Only
expressions whose counts pass the discount enter the model, which is exact: for
all others f_t = f_o = 1.  A counted pair brings the names of its words, so it is
held against the odds that they give it.  Up to ``max_table`` expressions are
broadcast; of more none is dropped, but the expressions of texts that pass a
filter of fixed size are joined with the table and summed by text.

Nulls and edges: a null or empty text has no evidence and gets the link's value
for it; null labels teach nothing, as do null ids; several labels of one id count
as the largest; without toxic or without ordinary rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import LETTER, hashed_words, mix

DISCOUNT, FIT_ROWS = 3.0, 20_000
#: Expressions that a task holds before it sends what it has added up.
HELD = 1 << 20
_U = np.uint64
_ONE = _U(1)


def expressions(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the words (even), names of the pairs (odd), and the places of both words of each pair."""
    if not len(words):
        return words, words, rows, rows
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    names = words & ~_ONE
    return names, pair_names(names[inner], names[inner + 1]), inner, inner + 1


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _U(0x9DDFEA08EB382D69) + right) | _ONE


def added(x: np.ndarray, n: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of n by x, and what x determines."""
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[first], np.add.reduceat(n, first) if len(first) else n, *(c[order[first]] for c in of)


def counted(texts: DataFrame, least: int) -> DataFrame:
    """(x, toxic, ordinary, l, r): texts of each class that hold x, where they are ``least`` in one class, and the words of a pair.

    Names 0 and 1 hold the sums over all words and all pairs.  What is shuffled
    is known by l and r alone: both words of a pair, 1 and a word, 1 and 1 or 3
    for a sum; names follow from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def batch_of(_: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(_), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)].view(np.int64)) for c in cols], ["n", "l", "r"])

        for batch in batches:
            # both counts in one number: toxic texts above, ordinary ones below
            one = np.where(batch.column("_label").to_numpy(zero_copy_only=False) == 1, np.int64(1) << 32, np.int64(1))
            for i, _, words, rows, *_ in hashed_words(batch.column("_t"), LETTER):
                names, pairs, left, right = expressions(words, rows)
                x, row = np.concatenate([names, pairs]), np.concatenate([rows, rows[left]])
                order = np.lexsort((row, x))
                new = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(row[order]) != 0)]] if len(x) else order
                of = [np.concatenate(c)[new] for c in ((np.ones(len(names), _U), names[left]), (names, names[right]))]
                x, n, kind = x[new], one[i + row[new]], x[new] & _ONE
                held += [added(x, n, *of), added(kind, n, np.ones(len(kind), _U), 2 * kind + _ONE)]
                size += len(held[-2][0]) + len(held[-1][0])
                if size >= HELD:
                    held = [added(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield from batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield from batch_of(*added(*(np.concatenate(c) for c in zip(*held, strict=True))))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_numpy(zero_copy_only=False).view(_U) for c in ("l", "r"))
            x = np.where(left != _ONE, pair_names(left, right), np.where(right & _ONE == _ONE, right >> _ONE, right))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), *(batch.column(c) for c in ("toxic", "ordinary", "l", "r"))], ["x", "toxic", "ordinary", "l", "r"])

    sums = texts.select("_t", "_label").mapInArrow(run, "n long, l long, r long").groupBy("l", "r").agg(F.sum("n").alias("n"))
    sums = sums.select(F.shiftrightunsigned("n", 32).alias("toxic"), F.col("n").bitwiseAND(F.lit(0xFFFFFFFF)).alias("ordinary"), "l", "r")
    sums = sums.where((F.col("r").bitwiseAND(F.lit(1)) == 1) | (F.greatest("toxic", "ordinary") >= least))
    return sums.mapInArrow(named, "x long, toxic long, ordinary long, l long, r long")


def factor(n: np.ndarray, e: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """f of the module's text; never below a thousandth."""
    with np.errstate(divide="ignore", invalid="ignore"):
        off = n - e
        kept = np.sign(off) * np.maximum(np.abs(off) - discount * np.sqrt(e + 1), 0)
        return np.where(e > 0, np.maximum((e + kept) / np.where(e > 0, e, 1), 1e-3), 1.0)


def log_ratio(n_t: np.ndarray, n_o: np.ndarray, log_odds: np.ndarray | float) -> np.ndarray:
    """log f_t / f_o where the classes are expected at these log odds."""
    share = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    n = n_t + n_o
    return np.log(factor(n_t, n * share)) - np.log(factor(n_o, n * (1 - share)))


def share_at(log_odds: Column) -> Column:
    """As in :func:`log_ratio`, the toxic class's expected share of a count."""
    return 1 / (1 + F.exp(-F.greatest(F.least(log_odds, F.lit(30.0)), F.lit(-30.0))))


def deviates(log_odds: Column, discount: float = DISCOUNT - 0.5) -> Column:
    """Whether the counts of a row may pass the discount, with room for a text that leaves its own counts out."""
    n, share = F.col("toxic") + F.col("ordinary"), share_at(log_odds)
    e = F.least(n * share, n * (1 - share))
    return F.abs(F.col("toxic") - n * share) >= discount * F.sqrt(e + 1) - 1


def ratio_column(log_odds: float, discount: float = DISCOUNT) -> Column:
    """:func:`log_ratio` of a row's counts."""
    n, share = F.col("toxic") + F.col("ordinary"), share_at(F.lit(log_odds))

    def part(count: Column, e: Column) -> Column:
        kept = F.signum(count - e) * F.greatest(F.abs(count - e) - discount * F.sqrt(e + 1), F.lit(0.0))
        return F.log(F.greatest((e + kept) / e, F.lit(1e-3)))

    return part(F.col("toxic"), n * share) - part(F.col("ordinary"), n * (1 - share))


def passing(counts: DataFrame, odds: tuple[float, float], scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """(x, toxic, ordinary) of words and pairs that pass the discount, and the tables that it reads.

    A pair enters at the odds of all pairs or at those that its words give it.
    Odds in between, as of a text that leaves its own counts out of the words,
    admit no other: a count that fails at both ends fails between them.
    """
    even = F.col("x").bitwiseAND(F.lit(1)) == 0
    words = counts.where("x not in (0, 1)").where(even).where(deviates(F.lit(odds[0])))
    words, path = scratch.table(words.select("x", "toxic", "ordinary", ratio_column(odds[0]).alias("w")))
    pairs = counts.where("x not in (0, 1)").where(~even)
    for side in ("l", "r"):
        pairs = pairs.join(words.select(F.col("x").alias(side), F.col("w").alias(f"w{side}")), side, "left")
    moved = F.lit(odds[1]) + F.coalesce("wl", F.lit(0.0)) + F.coalesce("wr", F.lit(0.0))
    pairs = pairs.where(deviates(F.lit(odds[1])) | deviates(moved))
    return words.drop("w").unionByName(pairs.select("x", "toxic", "ordinary")), [path]


class Model:
    """Counts of expressions that pass the discount, class odds of words and pairs, and the link."""

    def __init__(self, odds: tuple[float, float], keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, table: DataFrame | None = None):
        order = np.argsort(keys)
        self.odds, self.keys, self.toxic, self.ordinary = odds, keys[order], toxic[order].astype(float), ordinary[order].astype(float)
        self.weights = np.zeros(3)
        self.table = table  # (x, toxic, ordinary) where there are too many to send

    def found(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` of the model's expressions, and which they are."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(table[(x >> _U(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, x[maybe]), len(self.keys) - 1)
        same = self.keys[at] == x[maybe]
        return maybe[same], at[same]

    def evidence(self, column: pa.Array, table: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per text: log P_toxic - log P_ordinary over all its words, and its words; with labels, without the text's own counts."""
        total, size = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for i, j, words, rows, *_ in hashed_words(column, LETTER):
            size[i:j] = np.bincount(rows, minlength=j - i)
            names, pairs, left, right = expressions(words, rows)
            own = None if label is None else label[i + rows]
            place, k = self.found(names, table)
            at, k2 = self.found(pairs, table)
            value = evidence_of(len(words), self.odds, place, self.toxic[k], self.ordinary[k], left[at], right[at], self.toxic[k2], self.ordinary[k2], own)
            total[i:j] = np.bincount(rows, value, minlength=j - i)
        return total, size


def evidence_of(n_words: int, odds: tuple[float, float], place: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, left: np.ndarray, right: np.ndarray, pair_toxic: np.ndarray, pair_ordinary: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Log ratio of both classes at each word; counts are given at places of words, and of pairs by both places."""
    if own is not None:
        toxic, ordinary = np.maximum(toxic - (own[place] == 1), 0), np.maximum(ordinary - (own[place] == 0), 0)
        pair_toxic, pair_ordinary = np.maximum(pair_toxic - (own[right] == 1), 0), np.maximum(pair_ordinary - (own[right] == 0), 0)
    lone = np.zeros(n_words)
    lone[place] = log_ratio(toxic, ordinary, odds[0])
    value = lone.copy()
    value[right] += log_ratio(pair_toxic, pair_ordinary, odds[1] + lone[left] + lone[right])
    return value


def features(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Intercept, length-normalised evidence (per hundred words, drawn in at both ends), and length."""
    return np.stack([np.ones(len(total)), np.arcsinh(100 * total / np.maximum(size, 1)), np.log1p(size)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_of(weights: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(total, size) @ weights, -30, 30))) if weights.any() else np.zeros(len(total))


def bits_of(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, bool)
    table[(keys >> _U(42)).astype(np.int64)] = True
    return table


def filter_of(keys: DataFrame) -> np.ndarray:
    """The table of :func:`bits_of` for the hashes in column x; comes as 65,536 numbers at most."""
    words = np.zeros(1 << 16, np.int64)
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 42) & 63 as int))")
    for r in keys.groupBy(F.expr("shiftrightunsigned(x, 48)").alias("i")).agg(F.bit_or(bit).alias("b")).collect():
        words[r.i] = r.b
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _joined_evidence(texts: DataFrame, model: Model, keep: tuple[str, ...], own: bool) -> DataFrame:
    """As :meth:`Model.evidence`, with a shuffled join; each text's found expressions are brought together."""
    sent, weights, odds = texts.sparkSession.sparkContext.broadcast(filter_of(model.table)), model.weights, model.odds
    names = ["_k", *keep, "_own", "n_words", "x", "place"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for i, j, words, rows, *_ in hashed_words(batch.column("_t"), LETTER):
                size = np.bincount(rows, minlength=j - i)
                first = np.cumsum(size) - size
                name, pairs, _, right = expressions(words, rows)
                x, place = np.concatenate([name, pairs]), np.concatenate([np.arange(len(words)), right])
                maybe = np.flatnonzero(table[(x >> _U(42)).astype(np.int64)])
                at = place[maybe]
                row = np.concatenate([rows[at], np.arange(j - i)])  # a row of its own for each text
                none = pa.nulls(j - i, pa.int64())
                cols = [pa.concat_arrays([pa.array(c, pa.int64()), none]) for c in (x[maybe].view(np.int64), at - first[rows[at]])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(i + row)) for c in ("_k", *keep, "_own")), pa.array(size[row], pa.int64()), *cols], names)

    zero = F.lit(0).cast("long")
    rows = texts.select("_t", *keep, (F.col("_label") if own else F.lit(None).cast("int")).alias("_own")).withColumn("_k", F.monotonically_increasing_id())
    found = rows.mapInArrow(spread, rows.select("_k", *keep, "_own", *(F.when(zero == 0, zero).alias(c) for c in names[-3:])).schema)
    found = found.join(model.table, "x", "left").where("x is null or toxic is not null")
    by = found.groupBy("_k").agg(*(F.first(c).alias(c) for c in (*keep, "_own", "n_words")), F.collect_list(F.when(F.col("x").isNotNull(), F.struct("place", "x", "toxic", "ordinary"))).alias("_found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, total = batch.column("n_words").to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            for r, (hits, label) in enumerate(zip(batch.column("_found").to_pylist(), batch.column("_own").to_pylist(), strict=True)):
                got = np.array([(h["place"], h["x"] & 1, h["toxic"], h["ordinary"]) for h in hits], np.int64).reshape(-1, 4)
                got = got[np.argsort(got[:, 0], kind="stable")]
                one, two = got[got[:, 1] == 0], got[got[:, 1] == 1]
                mine = None if label is None else np.full(int(size[r]), label)
                total[r] = evidence_of(int(size[r]), odds, one[:, 0], one[:, 2].astype(float), one[:, 3].astype(float), two[:, 0] - 1, two[:, 0], two[:, 2].astype(float), two[:, 3].astype(float), mine).sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(total), batch.column("n_words"), pa.array(score_of(weights, total, size))], [*keep, "evidence", "n_words", "score"])

    return by.mapInArrow(run, texts.select(*keep, F.lit(0.0).alias("evidence"), zero.alias("n_words"), F.lit(0.0).alias("score")).schema)


def _evidence(texts: DataFrame, model: Model, keep: tuple[str, ...], own: bool = False) -> DataFrame:
    if model.table is not None:
        return _joined_evidence(texts, model, keep, own)
    sent = texts.sparkSession.sparkContext.broadcast((model, bits_of(model.keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = sent.value
        for batch in batches:
            label = batch.column("_label").to_numpy(zero_copy_only=False) if own else None
            total, size = model.evidence(batch.column("_t"), table, label)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(total), pa.array(size, pa.int64()), pa.array(score_of(model.weights, total, size))], [*keep, "evidence", "n_words", "score"])

    schema = texts.select(*keep, F.lit(0.0).alias("evidence"), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("score")).schema
    return texts.select("_t", *dict.fromkeys((*keep, "_label") if own else keep)).mapInArrow(run, schema)


def learn(df: DataFrame, labels: DataFrame, learn_from: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", max_table: int = 300_000, label_rows: int = 2_000_000) -> Model:
    """Fits both models on labelled rows where ``learn_from`` (over ``_id``) holds; labels are broadcast up to ``label_rows`` rows."""
    spark = df.sparkSession
    scratch = Scratch(spark, "toxicity")
    source = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t")).where(learn_from)
    known = labels.select(F.col(id).alias("_label_id"), F.col(label).cast("int").alias("_label")).where("_label_id is not null and _label in (0, 1)").groupBy("_label_id").agg(F.max("_label").alias("_label"))
    known = F.broadcast(known) if labels.count() <= label_rows else known
    rows = source.join(known, source["_id"] == known["_label_id"])
    # of exact copies within a class the one with the smallest id stands for all
    copies = rows.groupBy(F.xxhash64("_t").alias("h"), F.xxhash64(F.lit(1), "_t").alias("g"), "_label").agg(F.min("_id").alias("_label_id"))
    chosen, chosen_path = scratch.table(copies.groupBy("_label_id").agg(F.max("_label").alias("_label")))
    chosen = F.broadcast(chosen) if chosen.count() <= label_rows else chosen
    rows = source.join(chosen, source["_id"] == chosen["_label_id"]).select("_id", "_t", "_label")

    # with fewer counts no expression passes the discount, whatever the odds
    maybe, maybe_path = scratch.table(counted(rows, 4))
    sums = {r.x: r for r in maybe.where("x in (0, 1)").collect()}
    words, pairs = sums.get(0), sums.get(1)
    if not words or not words.toxic or not words.ordinary:
        scratch.drop(maybe_path, chosen_path)
        return Model((0.0, 0.0), np.zeros(0, _U), np.zeros(0), np.zeros(0))
    shares = [(r.toxic + 0.5) / (r.toxic + r.ordinary + 1) for r in (words, pairs or words)]
    odds = tuple(float(np.log(s / (1 - s))) for s in shares)
    strong, read = passing(maybe, odds, scratch)
    strong, strong_path = scratch.table(strong)
    scratch.drop(maybe_path, *read)
    if strong.count() > max_table:
        model = Model(odds, np.zeros(0, _U), np.zeros(0), np.zeros(0), strong)
    else:
        got = strong.collect()
        scratch.drop(strong_path)
        model = Model(odds, np.array([r.x for r in got], np.int64).view(_U), np.array([r.toxic for r in got], np.int64), np.array([r.ordinary for r in got], np.int64))
    sample = rows.withColumn("_o", F.xxhash64(F.col("_id").cast("string")))
    least = sample.select("_o").orderBy("_o").limit(FIT_ROWS).agg(F.max("_o").alias("o")).first().o
    fit = _evidence(sample.where(F.col("_o") <= least), model, ("_label",), own=True).select("_label", "evidence", "n_words").collect()
    scratch.drop(chosen_path)
    y = np.array([r._label for r in fit], float)
    if 0 < y.sum() < len(y):
        x = features(np.array([r.evidence for r in fit]), np.array([r.n_words for r in fit]))
        order = np.lexsort((*x.T, y))  # rows come in any order; sums shall not
        model.weights = logistic(x[order], y[order])
    return model


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``evidence`` (log likelihood of toxic text less that of ordinary text), ``n_words`` and ``score`` in [0, 1]."""
    rows = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t"))
    return _evidence(rows, model, ("_id",)).withColumnRenamed("_id", id)
