"""Ranked lexical search with block-max pruning.

1. Texts are split into terms (runs of ASCII letters, digits and longer
   characters, A-Z lower-cased) and counted.  Of each document the counts of
   the terms that any item uses go into a forward index, in blocks of
   neighbouring documents: ``BLOCK_DOCS`` of them, or fewer once they hold
   ``BLOCK_POSTINGS`` counts.
2. Documents, their terms and the documents of each term are added up from the
   blocks; every count then becomes its part of a score, and a block keeps the
   largest part of each of its terms.
3. An item's bound in a block adds these maxima up.  The ``SEEDS`` blocks with
   the highest bounds anywhere are scored first; the k-th best score found
   there is the item's threshold from then on.
4. Each task sorts its blocks by bound, ``TOGETHER`` at a time, and scores their forward index until the
   bound falls below the threshold, which rises with the task's own k best.
   What is left of all tasks is ranked.  A bound that equals the threshold is
   still scored, so equal scores are never lost.

Items are a stated query set: they are sent in blocks of at most
``block_terms`` terms, each block with an index of its own terms, so nothing
that is sent grows with the corpus, and of the corpus a task sends on at most k
rows an item.  A block of documents is bounded in documents and in counts.

Score: a term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), a
document's length norm m = 75 + (25 n N) div L, its score the sum over the
item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 12 m)).

Nulls and edges: null, empty and term-free texts count nowhere and are never
found; items without a term have no rows; repeated items are answered each (a
null item id included), repeated documents are ranked each; a null document id
comes after the others of its score.  An empty corpus or query set gives an
empty result.  Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import LETTER, LOWER

K, SEEDS = 20, 3
#: A block of the index ends at so many documents, or at so many counts.
BLOCK_DOCS, BLOCK_POSTINGS = 32, 1 << 11
#: Blocks that are turned into parts of scores at once, and blocks whose bounds are sorted together.
PIECE, TOGETHER = 64, 256
#: Cells of one pass over the bounds of items and blocks.
CELLS = 1 << 20
TERM = bytes(np.where(LETTER, LOWER, 32).astype(np.uint8))
FORWARD = "n_docs long, n_terms long, ids array<long>, lengths array<long>, ends array<int>, terms array<int>, counts array<int>, own array<int>, own_df array<int>"
INDEX = "ids array<long>, ends array<int>, terms array<int>, parts array<int>, own array<int>, tops array<int>"
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text in order."""
    return text.translate(TERM).split()


class Items:
    """A block of items: their ids, and for each its distinct terms by number with repeats; ``known`` numbers the terms."""

    def __init__(self, ids: list[int | None], bodies: list[list[bytes]]):
        self.ids, self.known = ids, {}
        cut, number, times = [0], [], []
        for body in bodies:
            for term, n in Counter(body).items():
                number.append(self.known.setdefault(term, len(self.known)))
                times.append(n)
            cut.append(len(number))
        self.cut, self.number, self.times = (np.array(x, np.int64) for x in (cut, number, times))

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        """Turns repeats into repeats times the term's weight; a term of no document weighs nothing."""
        w = np.zeros(len(self.known), np.int64)
        for t, n in df.items():
            w[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        self.weight = self.times * w[self.number]


def item_blocks(items: DataFrame, id: str, text: str, block_terms: int) -> Iterator[Items]:
    """Items in order, in blocks of at most ``block_terms`` terms or of one longer item; one block is here at a time."""
    ids, bodies, size = [], [], 0
    for r in items.select(F.col(id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        body = terms((r.t or "").encode())
        if not body:
            continue
        if ids and size + len(body) > block_terms:
            yield Items(ids, bodies)
            ids, bodies, size = [], [], 0
        ids.append(r.i)
        bodies.append(body)
        size += len(body)
    if ids:
        yield Items(ids, bodies)


def forward(source: DataFrame, items: Items) -> DataFrame:
    """Blocks of the forward index, with the documents and terms that went into them or lay between."""
    sent = source.sparkSession.sparkContext.broadcast(items.known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64())] + [(c, pa.list_(pa.int64() if c in ("ids", "lengths") else pa.int32())) for c in ("ids", "lengths", "ends", "terms", "counts", "own", "own_df")])
        number = sent.value.get
        n_docs = n_terms = 0
        ids, lengths, ends, found, counts = [], [], [], [], []

        def block() -> pa.RecordBatch:
            own, df = np.unique(np.array(found, np.int32), return_counts=True)
            row = dict(zip(schema.names, (n_docs, n_terms, ids, lengths, ends, found, counts, own.tolist(), df.tolist()), strict=True))
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for id, text in zip(batch.column("_id").to_pylist(), batch.column("_t").cast(pa.binary()), strict=True):
                body = terms(text.as_py() or b"")
                if not body:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(body)
                held = Counter(map(number, body))
                held.pop(None, None)
                if not held:
                    continue
                ids.append(id)
                lengths.append(len(body))
                found += held.keys()
                counts += held.values()
                ends.append(len(found))
                if len(ids) >= BLOCK_DOCS or len(found) >= BLOCK_POSTINGS:
                    yield block()
                    n_docs = n_terms = 0
                    ids, lengths, ends, found, counts = [], [], [], [], []
        if n_docs:
            yield block()

    return source.mapInArrow(run, FORWARD)


def parts_of(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) of counts in documents of the given lengths."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        m = 75 + (25 * lengths * n_docs) // n_terms
    else:
        m = np.array([75 + 25 * x * n_docs // n_terms for x in lengths.tolist()], np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def indexed(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks with each count's part of a score and, for each of a block's terms, the largest part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            post = Ragged(batch, "terms")
            doc = np.repeat(Ragged(batch, "lengths").values, np.diff(Ragged(batch, "ends").values_by_block(post.cut)))
            part = parts_of(Ragged(batch, "counts").values.astype(np.int64), doc.astype(np.int64), n_docs, n_terms).astype(np.int32)
            own = Ragged(batch, "own")
            block = np.repeat(np.arange(batch.num_rows), np.diff(post.cut))
            order = np.lexsort((post.values, block))
            first = np.flatnonzero(np.r_[True, (np.diff(post.values[order]) != 0) | (np.diff(block[order]) != 0)]) if len(order) else order
            tops = np.maximum.reduceat(part[order], first) if len(order) else part
            made = [batch.column("ids"), batch.column("ends"), batch.column("terms"), post.like(part), batch.column("own"), own.like(tops)]
            yield pa.RecordBatch.from_arrays(made, [x.split()[0] for x in INDEX.split(", ")])

    return blocks.mapInArrow(run, INDEX)


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows; what is worked out for one is gone before the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


class Ragged:
    """A list column of an Arrow batch as one array and its cuts; ``row`` picks a block."""

    def __init__(self, batch: pa.RecordBatch, name: str):
        column = batch.column(name)
        self.cut = column.offsets.to_numpy().astype(np.int64)
        inner = column.values.slice(self.cut[0], self.cut[-1] - self.cut[0])
        self.cut -= self.cut[0]
        self.missing = inner.is_null().to_numpy(zero_copy_only=False) if inner.null_count else None
        self.values = (inner.fill_null(_LAST) if inner.null_count else inner).to_numpy(zero_copy_only=False)

    def row(self, b: int) -> np.ndarray:
        return self.values[self.cut[b] : self.cut[b + 1]]

    def values_by_block(self, base: np.ndarray) -> np.ndarray:
        """Ends of documents counted through the whole batch, with a leading zero."""
        return np.r_[0, self.values + np.repeat(base[:-1], np.diff(self.cut))]

    def like(self, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.cut, pa.int32()), pa.array(values, pa.int32()))


def bounds(items: Items, own: Ragged, tops: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For items in turn their bound in every block of a batch.

    Sums are of whole numbers in doubles and so exact up to 2^53; larger ones
    are raised by more than they can be off.
    """
    n = len(own.cut) - 1
    block = np.repeat(np.arange(n), np.diff(own.cut))
    order = np.argsort(own.values, kind="stable")
    start = np.searchsorted(own.values[order], np.arange(len(items.known) + 1))
    block, tops = block[order], tops[order].astype(np.float64)
    size = np.r_[0, np.cumsum((start[1:] - start[:-1])[items.number])][items.cut]
    i, last = 0, len(items.ids)
    while i < last:
        j = i + 1
        while j < last and size[j + 1] - size[i] <= CELLS and (j + 1 - i) * n <= CELLS:
            j += 1
        at = np.arange(items.cut[i], items.cut[j])
        t, q = items.number[at], np.repeat(np.arange(j - i), np.diff(items.cut[i : j + 1]))
        many = start[t + 1] - start[t]
        got = np.repeat(start[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        sums = np.bincount(np.repeat(q, many) * n + block[got], np.repeat(items.weight[at].astype(np.float64), many) * tops[got], minlength=(j - i) * n)
        sums[sums >= 2**53] *= 1 + 1e-9
        yield from zip(range(i, j), sums.reshape(j - i, n), strict=True)
        i = j


class Best:
    """The k best (score, id) of each item so far, ids ascending within a score, and what a score must reach to count."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, np.maximum(floor, 1)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, q: int, score: np.ndarray, id: np.ndarray, missing: np.ndarray) -> None:
        some = score >= self.floor[q]
        if not some.any():
            return
        new = (score[some], id[some], missing[some])
        if q in self.held:
            new = tuple(np.concatenate(p) for p in zip(self.held[q], new, strict=True))
        order = np.lexsort((new[1], new[2], -new[0]))[: self.k]
        self.held[q] = tuple(x[order] for x in new)
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.held[q][0][-1])

    def rows(self) -> pa.RecordBatch:
        q = np.repeat(np.array(list(self.held), np.int32), [len(x[0]) for x in self.held.values()])
        score, id, missing = (np.concatenate([x[c] for x in self.held.values()]) if self.held else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, bool)))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score), pa.array(id, mask=missing)], ["q", "score", "id"])


class Blocks:
    """The forward index of a batch of blocks."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.terms, self.parts, self.ends = (Ragged(batch, c) for c in ("ids", "terms", "parts", "ends"))

    def score(self, b: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, ids and missing ids of a block's documents."""
        ends = self.ends.row(b)
        sums = np.add.reduceat(weight[self.terms.row(b)] * self.parts.row(b), np.r_[0, ends[:-1]])
        at = slice(self.ids.cut[b], self.ids.cut[b + 1])
        missing = np.zeros(len(ends), bool) if self.ids.missing is None else self.ids.missing[at]
        return sums, self.ids.values[at], missing


def best_blocks(index: DataFrame, sent) -> DataFrame:
    """(block, q): of each item the ``SEEDS`` blocks with the highest bounds, a task's first and then all tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, high = sent.value, {}
        for batch in pieces(batches, TOGETHER):
            name = batch.column("block").to_numpy(zero_copy_only=False)
            for q, bound in bounds(items, Ragged(batch, "own"), Ragged(batch, "tops").values):
                b = np.argpartition(-bound, min(SEEDS, len(bound)) - 1)[:SEEDS]
                new = [(bound[x], name[x]) for x in b if bound[x] > 0]
                high[q] = sorted(high.get(q, []) + new, key=lambda x: (-x[0], x[1]))[:SEEDS]
        rows = [(int(name), q, float(bound)) for q, found in high.items() for bound, name in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.float64()))], ["block", "q", "bound"])

    found = index.select("block", "own", "tops").mapInArrow(run, "block long, q int, bound double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return found.withColumn("_place", place).where(F.col("_place") <= SEEDS).select("block", "q")


def thresholds(index: DataFrame, sent, chosen: DataFrame, k: int) -> np.ndarray:
    """The k-th best score of each item over its chosen blocks, 0 where they hold fewer; one number an item comes here."""
    asked = chosen.groupBy("block").agg(F.collect_list("q").alias("qs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best, weight = Best(k, np.zeros(len(items.ids), np.int64)), np.zeros(len(items.known), np.int64)
        for batch in batches:
            blocks, qs = Blocks(batch), Ragged(batch, "qs")
            for b in range(batch.num_rows):
                for q in qs.row(b):
                    at = slice(items.cut[q], items.cut[q + 1])
                    weight[items.number[at]] = items.weight[at]
                    best.add(q, *blocks.score(b, weight))
                    weight[items.number[at]] = 0
        yield best.rows()

    # at most SEEDS blocks an item are asked for
    found = index.join(F.broadcast(asked), "block").select("ids", "ends", "terms", "parts", "qs").mapInArrow(run, "q int, score long, id long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    floor = np.zeros(len(sent.value.ids), np.int64)
    for r in found.withColumn("_place", place).where(F.col("_place") == k).select("q", "score").collect():
        floor[r.q] = r.score
    return floor


def ranked(index: DataFrame, sent, floor, k: int) -> DataFrame:
    """(q, score, id): each task's k best of an item that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best, weight = Best(k, floor.value.copy()), np.zeros(len(items.known), np.int64)
        for batch in pieces(batches, TOGETHER):
            blocks = Blocks(batch)
            for q, bound in bounds(items, Ragged(batch, "own"), Ragged(batch, "tops").values):
                high = np.flatnonzero(bound >= best.floor[q])
                if not len(high):
                    continue
                at = slice(items.cut[q], items.cut[q + 1])
                weight[items.number[at]] = items.weight[at]
                for b in high[np.argsort(-bound[high], kind="stable")]:
                    if bound[b] < best.floor[q]:
                        break
                    best.add(q, *blocks.score(b, weight))
                weight[items.number[at]] = 0
        yield best.rows()

    return index.select("ids", "ends", "terms", "parts", "own", "tops").mapInArrow(run, "q int, score long, id long")


def search(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, block_terms: int = 500_000) -> DataFrame:
    """The k best documents of each item: item_id, ``rank`` (int, from 1), the document's id and ``score`` (long)."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "search")
    context = spark.sparkContext
    source, found = df.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t")), []
    schema = f"`{item_id}` long, rank int, `{id}` long, score long"
    for block in item_blocks(items, item_id, item_text, block_terms):
        blocks, counted = scratch.table(forward(source, block))
        total = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        if not total.n:
            scratch.drop(counted)
            continue
        own = blocks.select(F.explode(F.arrays_zip("own", "own_df")).alias("x")).groupBy(F.col("x.own").alias("t")).agg(F.sum("x.own_df").alias("n"))
        block.weigh(total.n, {r.t: r.n for r in own.collect()})  # a row for each term of the items at most
        index, written = scratch.table(indexed(blocks.where(F.size("ids") > 0).drop("n_docs", "n_terms", "own_df"), total.n, total.l).withColumn("block", F.monotonically_increasing_id()))
        scratch.drop(counted)
        block.known = range(len(block.known))  # the terms themselves are needed no longer
        sent = context.broadcast(block)
        floor = context.broadcast(thresholds(index, sent, best_blocks(index, sent), k))
        top = ranked(index, sent, floor, k)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        names = spark.createDataFrame(list(enumerate(block.ids)), "q int, item long")
        best = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(names), "q")
        found.append(scratch.save(best.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id), "score")))
        scratch.drop(written)
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
