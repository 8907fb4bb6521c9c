"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

A window is ``length`` bytes of one text.  Each byte of a window that also
starts elsewhere, in any text, is removed; the judgement is on the input.

1. *Keys.*  A window's key is the smallest hash among its short grams, so equal
   windows have equal keys and neighbours mostly share one: a text becomes a
   few runs (key, start, number of windows).  Runs of one key whose bytes are
   equal as a whole need no further look.  Keys seen once are dropped, unless
   the gram behind the key recurs inside its run.
2. *Suffix arrays.*  For keys with several different runs, one copy of each
   run's bytes goes to the task of its key.  There each new batch gets a suffix
   array (window starts in order of the ``length`` bytes that follow); it is
   merge-scanned against the existing levels for equal windows; levels of equal
   size merge, so sizes grow geometrically and a window takes part in
   logarithmically many merges.  The family is dropped at a key boundary once it
   holds ``FAMILY_WINDOWS``, since windows of two keys never match.  A window
   whose 64-bit hash no other one of the family has cannot repeat and is left
   out before; of the others the bytes decide.
3. *Hot keys.*  A key with more than ``hot`` different runs (a passage that very
   many texts surround differently) would fill one task.  Its windows are dealt
   by their own 128-bit hash instead and counted with partial aggregation; this
   is exact as well, and no key is capped.

Texts move twice: to hand out run bytes, and to receive what to remove.  Runs
are small rows.  A row is known by two 64-bit hashes of its id and text, so
repeated ids and repeated rows are told apart by text; equal rows are copies.

Nulls and edges: a null text is empty; texts shorter than ``length`` lose
nothing; a null id is an ordinary value; equal rows of at least ``length``
bytes lose all bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import SLICE_BYTES, WORD_BYTES, buffers, hashed_words, mix, prefix_hash, range_hash, slices

GRAM, MAX_RUN, PLACE_BITS = 32, 512, 22
BATCH_WINDOWS, FAMILY_WINDOWS, HOT_RUNS = 1 << 14, 1 << 19, 4096
_U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    n = len(data) - 7
    words = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = words[: n - GRAM + 8] * _U(0x9E3779B185EBCA87)
    for k in range(8, GRAM, 8):
        h ^= h >> _U(29)
        h += words[k : n - GRAM + 8 + k]
        h *= _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(32)
    return h


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by running minima from both block ends."""
    n = len(h)
    blocks = np.full(-(-n // w) * w, ~_U(0))
    blocks[:n] = h
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, start in the row, windows, key, hash of all bytes, and whether the key's gram recurs, for every run in a slice of rows.

    Grams are compared by their upper bits, then by place, so the smallest one
    is the leftmost (or rightmost) of its kind in a window, wherever the window
    stands in the slice.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none.astype(bool)
    w = length - GRAM + 1
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=_U)
    high = h & ~_U((1 << PLACE_BITS) - 1)
    first = (window_min(high | place, w) & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    key = h[first]
    size = np.diff(offsets)
    inside = np.zeros(len(key) + 1, np.int32)
    rows = np.flatnonzero(size >= length)
    inside[offsets[rows]] = 1
    np.add.at(inside, offsets[rows] + size[rows] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = inside.copy()
    change[1:] &= (key[1:] != key[:-1]) | ~inside[:-1]
    change[offsets[rows]] = True
    starts = np.flatnonzero(change)
    stops = np.r_[starts[1:], len(key)]
    row = np.searchsorted(offsets[1:], starts, "right")
    stops = np.minimum(stops, offsets[row + 1] - length + 1)
    pieces = -(-(stops - starts) // MAX_RUN)
    row, base = np.repeat(row, pieces), np.repeat(starts, pieces)
    nth = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts, last = base + nth * MAX_RUN, np.repeat(stops, pieces)
    count = np.minimum(last - starts, MAX_RUN)
    back = window_min(high | (_U((1 << PLACE_BITS) - 1) - place), w)[starts + count - 1]
    rightmost = (1 << PLACE_BITS) - 1 - (back & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    again = first[starts] != rightmost
    whole = range_hash(prefix_hash(data), starts, starts + count + length - 1)
    return row, starts - offsets[row], count, key[starts].view(np.int64), (whole ^ mix(count.astype(_U))).view(np.int64), again


def all_runs(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`runs_of` over slices of rows; a text longer than a slice is read in overlapping parts."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        for at in range(lo, max(hi, lo + 1), SLICE_BYTES) if j == i + 1 else (lo,):
            end = hi if j > i + 1 else min(hi, at + SLICE_BYTES + length - 1)
            own = offsets[i : j + 1] - lo if j > i + 1 else np.array([0, end - at])
            row, start, *rest = runs_of(data[at:end], own, length)
            yield row + i, start + (at - lo), *rest


class SuffixFamily:
    """Levels of suffix arrays over window starts; each level holds distinct windows in byte order."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.text = np.zeros(0, np.uint8)
        self.levels: list[tuple[int, np.ndarray]] = []

    def _rows(self, at: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[at]
        return np.ascontiguousarray(view).view(f"S{self.length}").ravel()

    def add(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`meet` for windows of a text that is added."""
        base = len(self.text)
        self.text = np.concatenate([self.text, text])
        return self.meet(starts + base)

    def meet(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes a batch of window starts; gives which of its windows were there or repeat in it, and starts of older windows met again."""
        windows = self._rows(at)
        order = np.argsort(windows, kind="stable")
        sorted_windows = windows[order]
        same = sorted_windows[1:] == sorted_windows[:-1]
        hit = np.zeros(len(at), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        first = np.flatnonzero(np.r_[True, ~same])
        group = np.cumsum(np.r_[True, ~same]) - 1
        met, seen = [], np.zeros(len(first), bool)
        unique = sorted_windows[first]
        for _, level in self.levels:
            found, old = self._scan(unique, level)
            seen |= found
            met.append(old)
        hit[order] |= seen[group]
        new = at[order[first[~seen]]]
        if len(new):
            self.levels.append((max(len(new), 1).bit_length(), new))
            while len(self.levels) > 1 and self.levels[-2][0] <= self.levels[-1][0]:
                self._merge()
        return hit, np.concatenate(met) if met else np.zeros(0, np.int64)

    def _scan(self, windows: np.ndarray, level: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted windows the sorted level holds, and where; the level is read in blocks."""
        found, old = np.zeros(len(windows), bool), []
        for i in range(0, len(level), block):
            part = level[i : i + block]
            rows = self._rows(part)
            lo, hi = np.searchsorted(windows, rows[0]), np.searchsorted(windows, rows[-1], "right")
            if lo == hi:
                continue
            place = np.searchsorted(rows, windows[lo:hi])
            equal = rows[np.minimum(place, len(rows) - 1)] == windows[lo:hi]
            found[lo:hi] |= equal
            old.append(part[place[equal]])
        return found, np.concatenate(old) if old else np.zeros(0, np.int64)

    def _merge(self, block: int = 1 << 14) -> None:
        """Replaces the last two levels by their union; both are sorted and share no window."""
        (_, a), (_, b) = self.levels[-2:]
        slot, reach = np.empty(len(b), np.int64), 0
        for j in range(0, len(b), block):
            rows = self._rows(b[j : j + block])
            place = np.full(len(rows), reach, np.int64)
            for i in range(reach // block * block, len(a), block):
                part = self._rows(a[i : i + block])
                inner = rows > part[0]
                place[inner] = i + np.searchsorted(part, rows[inner])
                if part[-1] > rows[-1]:
                    break
            slot[j : j + block] = place
            reach = int(place[-1])
        merged = np.insert(a, slot, b)
        self.levels[-2:] = [(len(merged).bit_length(), merged)]


def intervals(hit: np.ndarray, ends_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 of runs of true values that do not cross the given ends."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[ends_text] = True
    start = hit.copy()
    start[1:] &= ~hit[:-1] | edge[1 : len(hit)]
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | edge[1 : len(hit)]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def repeated_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Windows whose hash another one has; no other window can repeat."""
    h = range_hash(prefix_hash(data), starts, starts + length)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    some = np.zeros(len(h), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    return np.flatnonzero(some)


def family_covers(rows: DataFrame, length: int, batch: int = BATCH_WINDOWS, family: int = FAMILY_WINDOWS) -> DataFrame:
    """Runs with bytes, dealt by key, to (k1, k2, start, stop) of bytes that other runs of the key repeat."""

    def covered(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """All runs of some keys: windows with a hash of their own are left out, the others meet in the family's arrays."""
        whole = pa.Table.from_batches(parts)
        meta = {k: whole.column(k).to_numpy() for k in ("n", "k1", "k2", "s")}
        data, offsets = buffers(whole.column("span"))
        counts = np.diff(offsets) - length + 1
        cut = np.r_[0, np.cumsum(counts)]
        starts = np.repeat(offsets[:-1] - cut[:-1], counts) + np.arange(cut[-1])
        some = repeated_hashes(data, starts, length)
        levels, hit = SuffixFamily(length), np.zeros(len(starts), bool)
        levels.text = data
        for i in range(0, len(some), batch):
            new = some[i : i + batch]
            found, old = levels.meet(starts[new])
            hit[new[found]] = True
            hit[np.searchsorted(starts, old)] = True
        a, b = intervals(hit, cut)
        of = np.searchsorted(cut, a, "right") - 1
        once = meta["n"][of] == 1
        a, b, of = a[once], b[once], of[once]
        cols = (meta["k1"][of], meta["k2"][of], meta["s"][of] + a - cut[of], meta["s"][of] + b - cut[of] - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["k1", "k2", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, last = [], 0, None
        for whole in batches:
            n = whole.num_rows
            keys, size = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("m", "L"))
            i = 0
            while i < n:
                if windows >= family:  # full, but a key stays in one family
                    other = np.flatnonzero(keys[i:] != last)
                    j = i + int(other[0]) if len(other) else n
                else:
                    j = min(n, i + 1 + int(np.searchsorted(np.cumsum(size[i:]), family - windows)))
                if j > i:
                    held.append(whole.slice(i, j - i))
                    windows, last = windows + int(size[i:j].sum()), keys[j - 1]
                if windows >= family and j < n and keys[j] != last:
                    yield covered(held)
                    held, windows = [], 0
                i = j
        if held:
            yield covered(held)

    dealt = rows.repartition("m").sortWithinPartitions("m")
    return dealt.mapInArrow(run, "k1 long, k2 long, s long, e long")


def hot_covers(rows: DataFrame, length: int) -> DataFrame:
    """The same for keys with too many different runs for a task: windows are dealt by their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(0, whole.num_rows, 256):
                part = whole.slice(r, 256)
                data, offsets = buffers(part.column("span"))
                counts = np.diff(offsets) - length + 1
                cut = np.cumsum(counts) - counts
                nth = np.arange(counts.sum()) - np.repeat(cut, counts)
                at = np.repeat(offsets[:-1], counts) + nth
                one = range_hash(prefix_hash(data), at, at + length)
                two = range_hash(prefix_hash(data ^ np.uint8(0x5A)), at, at + length)
                cols = [np.repeat(part.column(c).to_numpy(zero_copy_only=False), counts) for c in ("n", "k1", "k2", "s")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (cols[0], cols[1], cols[2], cols[3] + nth)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["n", "k1", "k2", "w", "h1", "h2"])

    windows = rows.mapInArrow(run, "n long, k1 long, k2 long, w long, h1 long, h2 long")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1")
    once = windows.where("n = 1").join(again, ["h1", "h2"])
    return once.select("k1", "k2", F.col("w").alias("s"), (F.col("w") + length).alias("e"))


def row_keys(id: str, text: str) -> list[Column]:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    i = F.coalesce(F.col(id).cast("string"), F.lit("\x00"))
    return [F.xxhash64(i, F.lit("|"), t).alias("k1"), F.xxhash64(t, F.lit("/"), i).alias("k2")]


def keyed_texts(df: DataFrame, id: str, text: str) -> DataFrame:
    """(k1, k2, t): row keys and text."""
    return df.select(*row_keys(id, text), F.col(text).cast("string").alias("t"))


def keyed_words(df: DataFrame, id: str, text: str) -> DataFrame:
    """(k1, k2, t): row keys, and two bytes of hash for each word of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, rows, *_ in hashed_words(batch.column("t"), WORD_BYTES):
                stops = np.r_[0, 2 * np.cumsum(np.bincount(rows, minlength=j - i))].astype(np.int32)
                t = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(stops), pa.py_buffer((words >> _U(48)).astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column("k1").slice(i, j - i), batch.column("k2").slice(i, j - i), t], ["k1", "k2", "t"])

    return keyed_texts(df, id, text).mapInArrow(run, "k1 long, k2 long, t binary")


def covers(texts: DataFrame, length: int, hot: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, t) to (k1, k2, spans): per row key, the array of (start, stop) byte ranges that windows which start elsewhere too cover; they may overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))
            for row, *rest, again in all_runs(batch.column("t"), length):
                cols = [k1[row], k2[row], *rest]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(again)], ["k1", "k2", "s", "L", "m", "whole", "again"])

    runs, runs_path = scratch.table(texts.mapInArrow(find, "k1 long, k2 long, s long, L long, m long, whole long, again boolean"))
    # counts are written before they join, so that no aggregate stands between a join and a skewed key's splitting
    often, often_path = scratch.table(runs.groupBy("m").agg(F.count("*").alias("c")).where("c > 1"))
    repeated, repeated_path = scratch.table(runs.join(often, "m", "left").where("c is not null or again").drop("c"))
    scratch.drop(runs_path, often_path)
    kinds = repeated.groupBy("m", "whole").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "s", "L")).alias("r"))
    kinds, kinds_path = scratch.table(kinds.select("m", "whole", "n", "again", "r.*"))
    full = repeated.join(kinds.where("n > 1").select("m", "whole"), ["m", "whole"]).select("k1", "k2", "s", (F.col("s") + F.col("L") - 1 + length).alias("e"))
    several = kinds.groupBy("m").agg(F.count("*").alias("kinds"), F.max("again").alias("any")).where("kinds > 1 or any").drop("any")
    several, several_path = scratch.table(several)
    asked = kinds.join(several, "m").withColumn("hot", F.col("kinds") > hot)
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "n", "s", "L", "hot")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("t"))
            lists = batch.column("runs")
            runs, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin = offsets[row] + runs.field("s").to_numpy()
            size = runs.field("L").to_numpy() - 1 + length
            keys = [batch.column(k).to_numpy(zero_copy_only=False)[row] for k in ("k1", "k2")]
            ends, i = np.cumsum(size), 0
            while i < len(size):
                # spans overlap, so what a batch gives is bounded by their bytes and not by its rows
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
                body = np.concatenate([data[x : x + n] for x, n in zip(begin[i:j].tolist(), size[i:j].tolist(), strict=True)])
                span = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.r_[0, np.cumsum(size[i:j])].astype(np.int32)), pa.py_buffer(body)])
                part = runs.slice(i, j - i)
                cols = [*(part.field(c) for c in ("m", "n")), *(pa.array(k[i:j]) for k in keys), *(part.field(c) for c in ("s", "L", "hot")), span]
                yield pa.RecordBatch.from_arrays(cols, ["m", "n", "k1", "k2", "s", "L", "hot", "span"])
                i = j

    spans = texts.join(asked, ["k1", "k2"]).mapInArrow(cut, "m long, n long, k1 long, k2 long, s long, L long, hot boolean, span binary")
    spans, spans_path = scratch.table(spans)
    scratch.drop(several_path)
    found = full.union(family_covers(spans.where("not hot"), length)).union(hot_covers(spans.where("hot"), length))
    out = scratch.save(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    scratch.drop(spans_path, repeated_path, kinds_path)
    return out


def remove(body: bytes, spans: list) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs were removed."""
    if not spans:
        return body, 0
    at = np.array([(x["s"], x["e"]) for x in spans], np.int64)
    at = at[np.argsort(at[:, 0], kind="stable")]
    stop = np.maximum.accumulate(at[:, 1])
    new = np.r_[True, at[1:, 0] > stop[:-1]]
    first = np.flatnonzero(new)
    begin, end = at[first, 0], stop[np.r_[first[1:] - 1, len(at) - 1]]
    kept = [body[a:b] for a, b in zip(np.r_[0, end], np.r_[begin, len(body)], strict=True)]
    return b"".join(kept), len(first)


def sharing(df: DataFrame, id: str, text: str, words: int, hot: int = HOT_RUNS) -> DataFrame:
    """(k1, k2) of rows with a passage of so many words (as two hashed bytes each) that starts elsewhere too."""
    scratch = Scratch(df.sparkSession, "passages")
    coded, coded_path = scratch.table(keyed_words(df, id, text))
    found = covers(coded, 2 * words, hot, scratch).select("k1", "k2")
    scratch.drop(coded_path)
    return found


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 400, hot: int = HOT_RUNS, as_text: bool = False, words: int | None = None) -> DataFrame:
    """Per row: ``_row`` (the row as it came), ``_n_bytes, _n_removed, _n_spans`` and ``_kept``; with ``words`` also ``_shares``.

    ``_kept`` holds the remaining bytes, or with ``as_text`` the remaining text:
    of a character that is cut in the middle the rest is left out.  ``_shares``
    tells whether the text has a passage of that many words that starts
    elsewhere too, whatever its bytes; nothing is removed for it.
    """
    scratch = Scratch(df.sparkSession, "suffix")
    spans = covers(keyed_texts(df, id, text), length, hot, scratch)
    whole = df.select(F.struct("*").alias("_row"), *row_keys(id, text))
    more = []
    if words:
        found = spans.withColumn("_shares", F.lit(False)).unionByName(sharing(df, id, text, words, hot).select("k1", "k2", F.lit(True).alias("_shares")), allowMissingColumns=True)
        spans = scratch.save(found.groupBy("k1", "k2").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("_shares").alias("_shares")))
        more = [F.coalesce("_shares", F.lit(False)).alias("_shares")]
    joined = whole.join(spans, ["k1", "k2"], "left").select("_row", "spans", *more)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("_row").field(text).cast(pa.string())
            for i, j in slices(buffers(whole)[1]):
                part = batch.slice(i, j - i)
                bodies = [b or b"" for b in whole.slice(i, j - i).cast(pa.binary()).to_pylist()]
                done = [remove(b, s) for b, s in zip(bodies, part.column("spans").to_pylist(), strict=True)]
                kept = [k.decode("utf-8", "ignore") if as_text else k for k, _ in done]
                cols = [part.column("_row"), pa.array([len(b) for b in bodies], pa.int64()), pa.array([len(b) - len(k) for b, (k, _) in zip(bodies, done, strict=True)], pa.int64()), pa.array([n for _, n in done], pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), *([part.column("_shares")] if words else [])]
                yield pa.RecordBatch.from_arrays(cols, ["_row", "_n_bytes", "_n_removed", "_n_spans", "_kept", "_shares"][: len(cols)])

    schema = joined.select("_row", *(F.lit(0).cast("long").alias(c) for c in ("_n_bytes", "_n_removed", "_n_spans")), F.lit("" if as_text else b"").alias("_kept"), *(["_shares"] if words else [])).schema
    return joined.mapInArrow(strip, schema)
