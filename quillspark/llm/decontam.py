"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every word n-gram of the test items is counted over the whole corpus.
2. Seeds are all n-grams of an item that occur in the corpus.  None is thinned
   out: an edited copy may keep just those that a choice would drop.
3. Texts are scanned for seeds.  A text and an item that share one are a pair;
   pairs whose texts share too few words with the item, whatever their order, for
   a score of ``threshold`` go before any passage is made, so an n-gram common
   to many items and texts costs one test a pair.  Seeds of a pair that lie in
   order within one item length form a passage; one seed is enough.
4. A passage is widened on both sides by the most words that an alignment of
   ``threshold`` can span.  It is left out where it shares too few words with
   the item, whatever their order, for a score of ``threshold`` (a bound that
   no alignment exceeds); else it is aligned with the item by Smith-Waterman
   over words (match 2, mismatch -1, gap -1).  The score is the best local
   score over that of a perfect copy; at ``threshold`` or more the text is
   contaminated.  A window longer than an alignment can span is cut into pieces
   that overlap by that span, so memory does not follow the text's length and no
   alignment is lost; of equal scores the one that starts first is reported.

Test items are a stated query set: they are broadcast in blocks of at most
``block_words`` words (sizes are counted first), one pass over the corpus a
block, so nothing that is sent grows with the corpus.  Texts never move.

Nulls and edges: words are runs of ASCII letters, digits and longer characters,
lower-cased in A-Z; null and empty texts and items match nothing, nor do items
of fewer than ``n`` words; equal rows are found each; equal items are each
reported; an empty benchmark or corpus gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LETTER, hashed_words, ngrams

N, THRESHOLD = 3, 0.5
BITS = 20
#: Words of a window that are aligned at once, or four times the words that an alignment may span, and cells of one pass.
PIECE, CELLS = 4096, 1 << 18
_U = np.uint64


class Seeds(NamedTuple):
    """N-grams of items that occur in the corpus."""

    keys: np.ndarray  #: the distinct hashes, in order
    item: np.ndarray  #: the items of each key, cut by ``item_cut``
    item_cut: np.ndarray
    key: np.ndarray  #: the keys of each item by number and their places in it, cut by ``cut``
    place: np.ndarray
    cut: np.ndarray


class Items:
    """Hashed words of a block of test items."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        column = pa.array([t or "" for t in texts], pa.string())
        words, rows = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for i, _, h, r, *_ in hashed_words(column, LETTER):
            words.append(h)
            rows.append(r + i)
        self.words, self.rows, self.ids = np.concatenate(words), np.concatenate(rows), list(ids)
        cut = np.searchsorted(self.rows, np.arange(len(ids) + 1))
        self.cut = cut
        self.grams, self.first = ngrams(self.words, self.rows, N)
        self.vocabulary, number = np.unique(self.words, return_inverse=True)
        # the bag of each item: its distinct words by number, each with its repeats
        bag, self.bag_n = np.unique(self.rows * max(len(self.vocabulary), 1) + number, return_counts=True)
        self.bag_word = bag % max(len(self.vocabulary), 1)
        self.bag_cut = np.searchsorted(bag, np.arange(len(ids) + 1) * max(len(self.vocabulary), 1))

    def keys(self) -> np.ndarray:
        return np.unique(self.grams)

    def seeds(self, keys: np.ndarray, counts: np.ndarray) -> Seeds:
        at = np.flatnonzero(counts[np.searchsorted(keys, self.grams)] > 0)
        row, n = self.rows[self.first[at]], len(self.ids)
        found, key = np.unique(self.grams[at], return_inverse=True)
        both = np.unique(key * n + row)
        # grams come in order of their items
        return Seeds(found, both % n, np.searchsorted(both, np.arange(len(found) + 1) * n), key, self.first[at] - self.cut[row], np.searchsorted(row, np.arange(n + 1)))


def filter_bits(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS, bool)
    table[(keys >> _U(64 - BITS)).astype(np.int64)] = True
    return table


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each item and window, and the window words [start, stop) that it spans."""
    m, w = max(map(len, items)), max(map(len, windows))
    c = len(items)
    left, right = np.zeros((c, m), _U), np.full((c, w), _U(1))
    live = np.zeros((c, m), bool)
    for k, (a, b) in enumerate(zip(items, windows, strict=True)):
        left[k, : len(a)], right[k, : len(b)], live[k, : len(a)] = a, b, True
    # a cell holds score * 2**32 + (2**32 - 1 - start): of equal scores the one that starts first wins
    one = np.int64(1 << 32)
    j = np.arange(w + 1, dtype=np.int64)
    fresh = one - 1 - j
    before = np.broadcast_to(fresh, (c, w + 1)).copy()
    best, stop = before[:, 0].copy(), np.zeros(c, np.int64)
    for i in range(m):
        step = np.where((left[:, i, None] == right) & live[:, i, None], 2 * one, -one)
        cell = np.broadcast_to(fresh, (c, w + 1)).copy()
        np.maximum(cell[:, 1:], before[:, :-1] + step, out=cell[:, 1:])
        np.maximum(cell, before - one, out=cell)
        cell = np.maximum.accumulate(cell + j * one, axis=1) - j * one
        cell = np.where(live[:, i, None], cell, before)
        at = cell.argmax(axis=1)
        top = cell[np.arange(c), at]
        better = top > best
        best, stop = np.where(better, top, best), np.where(better, at, stop)
        before = cell
    return best // one, one - 1 - best % one, stop


def pieces(a: int, b: int, reach: int) -> Iterator[tuple[int, int]]:
    """A long window in overlapping pieces; whatever spans at most ``reach`` words lies in one of them."""
    most = max(4 * reach, PIECE)
    while b - a > most:
        yield a, a + most
        a += most - reach
    yield a, b


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def chunks(size: np.ndarray) -> Iterator[slice]:
    """Ranges of entries whose sizes add up to ``CELLS`` at most, or of one larger entry."""
    upto, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CELLS, "right")))
        yield slice(i, j)
        i = j


class Bag:
    """The words of a slice of texts that items use, in order of word and place."""

    def __init__(self, items: Items, words: np.ndarray):
        self.items, self.span = items, len(words) + 1
        number = np.minimum(np.searchsorted(items.vocabulary, words), len(items.vocabulary) - 1)
        at = np.flatnonzero(items.vocabulary[number] == words)
        self.held = np.sort(number[at] * self.span + at)

    def shared(self, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that each item and its window [a, b) both have, each as often as in the one with fewer; no alignment matches more."""
        cut = self.items.bag_cut
        size, out = cut[item + 1] - cut[item], np.zeros(len(item), np.int64)
        for part in chunks(size):
            n = size[part]
            bag = ranges(cut[item[part]], n)
            base = self.items.bag_word[bag] * self.span
            many = np.searchsorted(self.held, base + np.repeat(b[part], n)) - np.searchsorted(self.held, base + np.repeat(a[part], n))
            out[part] = np.bincount(np.repeat(np.arange(len(n)), n), np.minimum(many, self.items.bag_n[bag]), minlength=len(n))
        return out


def candidates(rows: np.ndarray, key: np.ndarray, seeds: Seeds, items: Items, bag: Bag, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) pairs that share a seed and enough words; ``rows`` and ``key`` are the seeds found, a key once a row."""
    n, found = len(items.ids), [np.zeros(0, np.int64)]
    size = seeds.item_cut[key + 1] - seeds.item_cut[key]
    for part in chunks(size):
        pair = np.unique(np.repeat(rows[part], size[part]) * n + seeds.item[ranges(seeds.item_cut[key[part]], size[part])])
        row, item = pair // n, pair % n
        found.append(pair[bag.shared(item, bounds[row], bounds[row + 1]) >= threshold * np.diff(items.cut)[item]])
    pair = np.unique(np.concatenate(found))
    return pair // n, pair % n


def scan(column: pa.Array, items: Items, seeds: Seeds, table: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item, score, first and last+1 byte, seeds) of the passages of texts that may reach ``threshold``."""
    size = np.diff(items.cut)
    # matches are at most the item's words and the score pays for each word more
    reach = np.ceil(size * max(3 - 2 * threshold, 1)).astype(np.int64)
    n_keys = max(len(seeds.keys), 1)
    for i, _, words, rows, starts, ends, own in hashed_words(column, LETTER):
        grams, first = ngrams(words, rows, N)
        maybe = np.flatnonzero(table[(grams >> _U(64 - BITS)).astype(np.int64)])
        key = np.minimum(np.searchsorted(seeds.keys, grams[maybe]), n_keys - 1)
        hit = seeds.keys[key] == grams[maybe] if len(seeds.keys) else np.zeros(len(maybe), bool)
        if not hit.any():
            continue
        key, at = key[hit], first[maybe[hit]]
        bounds = np.searchsorted(rows, np.arange(rows[-1] + 2))
        # the seeds found, in order of row, key and place
        order = np.lexsort((at, key, rows[at]))
        key, at = key[order], at[order]
        found = rows[at] * n_keys + key
        once = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        bag = Bag(items, words)
        row, item = candidates(rows[at[once]], key[once], seeds, items, bag, bounds, threshold)
        seeds_of = seeds.cut[item + 1] - seeds.cut[item]
        asked = ranges(seeds.cut[item], seeds_of)
        pair = np.repeat(np.arange(len(row)), seeds_of)
        name = row[pair] * n_keys + seeds.key[asked]
        lo, many = np.searchsorted(found, name), np.searchsorted(found, name, "right")
        many -= lo
        for part in chunks(np.bincount(pair, many, minlength=len(row)).astype(np.int64)):
            inside = slice(*np.searchsorted(pair, (part.start, part.stop)))
            yield from passages(i, pair[inside], seeds.place[asked[inside]], lo[inside], many[inside], at, row, item, items, bag, bounds, reach, threshold, words, starts, ends, own)


def passages(i, pair, place, lo, many, at, row, item, items, bag, bounds, reach, threshold, words, starts, ends, own) -> Iterator[tuple[int, int, float, int, int, int]]:
    """The passages of some (row, item) pairs: windows round their seeds that share enough words, aligned."""
    size = np.diff(items.cut)
    at, pair, place = at[ranges(lo, many)], np.repeat(pair, many), np.repeat(place, many)
    shift = at - place  # where the item would begin
    order = np.lexsort((shift, pair))
    pair, shift, at, place = pair[order], shift[order], at[order], place[order]
    slack = np.maximum(4, size[item[pair]] // 4)
    new = np.r_[True, (pair[1:] != pair[:-1]) | (shift[1:] - shift[:-1] > slack[1:])]
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    distinct = np.bincount(np.unique(group * (int(place.max()) + 1) + place) // (int(place.max()) + 1), minlength=len(begin))
    r, it = row[pair[begin]], item[pair[begin]]
    a = np.maximum(bounds[r], np.minimum.reduceat(at, begin) - reach[it])
    b = np.minimum(bounds[r + 1], np.maximum.reduceat(at, begin) + N + reach[it])
    near = np.flatnonzero(bag.shared(it, a, b) >= threshold * size[it])
    todo = [(*x[:2], *y, x[4]) for x in zip(*(v[near].tolist() for v in (r, it, a, b, distinct)), strict=True) for y in pieces(x[2], x[3], int(reach[x[1]]))]
    todo.sort(key=lambda x: (x[3] - x[2], x[0], x[1], x[2]))
    k = 0
    while k < len(todo):
        n = k + 1  # windows come in order of length, so the last one is the widest
        while n < min(len(todo), k + 256) and (todo[n][3] - todo[n][2]) * (n + 1 - k) <= CELLS:
            n += 1
        part, k = todo[k:n], n
        score, s, e = align([items.words[items.cut[x[1]] : items.cut[x[1] + 1]] for x in part], [words[a:b] for _, _, a, b, _ in part])
        for (r, it, a, _, d), sc, x, y in zip(part, score, s, e, strict=True):
            yield i + r, it, float(sc) / (2 * int(size[it])), int(starts[a + x] - own[r]), int(ends[a + max(y, x + 1) - 1] - own[r]), d


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list]:
    """Items in order of id, in lists whose words stay under the bound; only one list is here at a time."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")).where("t <> ''").orderBy("i", "t")
    part, words = [], 0
    for r in rows.toLocalIterator():
        size = len(r.t.split()) + 1
        if part and words + size > block_words:
            yield part
            part, words = [], 0
        part.append(r)
        words += size
    if part:
        yield part


def matches(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_words: int = 500_000) -> DataFrame:
    """One row per text and test item aligned at ``threshold`` or more: id, item_id, score, start, stop (bytes), n_seeds."""
    source = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t"))
    kinds = {"item_id": "long", "score": "double", "start": "long", "stop": "long", "n_seeds": "long"}
    schema = source.select("_id", *(F.lit(None).cast(k).alias(c) for c, k in kinds.items())).schema
    found = []
    for block in blocks_of(benchmark, item_id, item_text, block_words):
        chosen = prepared(source, block)

        def find(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            items, seeds, table = chosen.value
            for batch in batches:
                best: dict[tuple[int, int], tuple] = {}
                for row, item, *rest in scan(batch.column("_t"), items, seeds, table, threshold):
                    old = best.get((row, item))
                    if rest[0] >= threshold and (old is None or (rest[0], -rest[1]) > (old[0], -old[1])):
                        best[row, item] = tuple(rest)
                rows = sorted(best)
                cols = [batch.column("_id").take(pa.array([r for r, _ in rows], pa.int64())), pa.array([items.ids[i] for _, i in rows], pa.int64())]
                for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.int64())):
                    cols.append(pa.array([best[x][k] for x in rows], kind))
                yield pa.RecordBatch.from_arrays(cols, ["_id", *kinds])

        found.append(source.mapInArrow(find, schema))
    out = reduce(DataFrame.union, found) if found else df.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id)


def without_matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_words: int = 500_000) -> DataFrame:
    """The rows of ``df``, as they came, that no test item is aligned with; nothing is joined or moved."""
    for block in blocks_of(benchmark, item_id, item_text, block_words):
        rows = df.select(F.struct("*").alias("_row"))
        chosen = prepared(df.select(F.col(text).cast("string").alias("_t")), block)

        def keep(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            items, seeds, table = chosen.value
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.column("_row").slice(i, 1024)
                    bad = {row for row, _, score, *_ in scan(part.field(text).cast(pa.string()), items, seeds, table, threshold) if score >= threshold}
                    good = pa.array([r for r in range(len(part)) if r not in bad], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.take(good)], ["_row"])

        df = rows.mapInArrow(keep, rows.schema).select("_row.*")
    return df


def prepared(source: DataFrame, block: list):
    """A block's items, its seeds that occur in ``source``, and their bit filter, as a broadcast."""
    context = source.sparkSession.sparkContext
    items = Items([r.i for r in block], [r.t for r in block])
    keys = items.keys()
    sent = context.broadcast((keys, filter_bits(keys)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = sent.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, words, rows, *_ in hashed_words(batch.column("_t"), LETTER):
                grams, _ = ngrams(words, rows, N)
                grams = grams[table[(grams >> _U(64 - BITS)).astype(np.int64)]]
                at = np.searchsorted(keys, grams)
                at = at[keys[np.minimum(at, len(keys) - 1)] == grams] if len(keys) else at[:0]
                total += np.bincount(at, minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "n"])

    counts = np.zeros(len(keys), np.int64)
    # a row for each n-gram of the block at most comes back
    for r in source.select("_t").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r.k] = r.n
    seeds = items.seeds(keys, counts)
    return context.broadcast((items, seeds, filter_bits(seeds.keys)))
