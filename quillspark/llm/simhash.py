"""SimHash near-duplicates through a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint.  Rows with one fingerprint collapse to
their smallest id.  Distinct fingerprints are cut into ``BLOCKS`` blocks; two
that differ in at most ``radius`` bits agree on all blocks but ``radius`` of
them, so each fingerprint goes to one bucket per choice of the blocks kept.
A bucket's shared masked pattern is the top node of the index.  At a radius of
two 48 bits are fixed, so a bucket holds at most 2**16 fingerprints however large
a group of copies is (2**24 at a radius of three, 16 bytes each while the bucket
is gathered), and a fingerprint has at most 136 (2,324) neighbours in it.  Inside buckets the fingerprints lie in
order of Gray rank; runs of ``FANOUT`` neighbours form nodes that keep only
the bits their members share beyond the parent's, and a search adds up the
differences on its way down and leaves a node, with all below it, once they
pass the radius.  A bucket returns a spanning star for each linked set rather
than all of its pairs, which loses no link between components.

Nulls and edges: a null text counts as empty; an empty text has fingerprint
zero and links like any other.  A row with a null id keeps its fingerprint,
links nothing and has a null component.  Equal rows share a component.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._scratch import Scratch

BLOCKS, FANOUT, QUERIES, SEED = 8, 16, 4096, 42
_U = np.uint64


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles, repeats included."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    raw = np.frombuffer(b"".join([xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(raw), 1 << 14):
        votes += np.unpackbits(raw[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(raw)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str, shingle: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``_fp``, the fingerprint as a signed long."""
    source = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps)], [*keep, "_fp"])

    schema = source.select(*keep, F.lit(0).cast("long").alias("_fp")).schema
    return source.mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code word in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U(k)
    return x


def forest(bucket: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from leaves to roots: child starts, child ends, masks and patterns of children, masks of nodes."""
    mask, pattern, levels = np.full(len(fps), ~_U(0)), fps, []
    while True:
        n = len(bucket)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        if levels and len(first) == n:
            return levels
        place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        starts = np.flatnonzero(place % FANOUT == 0)
        ends = np.r_[starts[1:], n]
        lead = np.repeat(pattern[starts], ends - starts)
        shared = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), starts)
        levels.append((starts, ends, mask, pattern, shared))
        mask, pattern, bucket = shared, pattern[starts] & shared, bucket[starts]


def search(bucket: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one bucket at most ``radius`` bits apart, some queries at a time; rows lie in order of (bucket, Gray rank)."""
    levels = forest(bucket, fps)
    root = np.cumsum(np.r_[False, bucket[1:] != bucket[:-1]])
    for lo in range(0, len(fps), QUERIES):
        q = np.arange(lo, min(lo + QUERIES, len(fps)))
        node, spent = root[q], np.zeros(len(q), np.uint8)
        for starts, ends, mask, pattern, above in reversed(levels):
            size = ends[node] - starts[node]
            child = np.repeat(starts[node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            q, up, spent = np.repeat(q, size), np.repeat(node, size), np.repeat(spent, size)
            spent = spent + np.bitwise_count((fps[q] ^ pattern[child]) & mask[child] & ~above[up])
            near = spent <= radius
            q, node, spent = q[near], child[near], spent[near]
        ahead = q < node
        yield q[ahead], node[ahead]


def stars(bucket: np.ndarray, fps: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Representatives with a link, each with the smallest one of its linked set, for some queries at a time.

    Sets found by different queries meet through the members that they share.
    """
    order = np.lexsort((gray_rank(fps), bucket))
    bucket, fps, reps = bucket[order], fps[order], reps[order]
    left, right = [reps[:0]], [reps[:0]]
    for a, b in search(bucket, fps, radius):
        top = reps.copy()
        while True:
            low = np.minimum(top[a], top[b])
            was = top.copy()
            np.minimum.at(top, a, low)
            np.minimum.at(top, b, low)
            if (was == top).all():
                break
        linked = np.flatnonzero(top != reps)
        left.append(reps[linked])
        right.append(top[linked])
    return np.concatenate(left), np.concatenate(right)


def links(reps: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """(_fp, _rep) to star links (a, b) between representatives at most ``radius`` bits apart."""
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        m = sum(((1 << int(cuts[k + 1] - cuts[k])) - 1) << int(cuts[k]) for k in kept)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keyed = reps.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("_fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for c, m in enumerate(masks)])))
    keyed = keyed.select(F.col("_k.c").alias("c"), F.col("_k.v").alias("v"), "_fp", "_rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            many = np.bincount(bucket)[bucket] > 1
            x, y = stars(bucket[many], fp[many].view(_U), rep[many], radius) if many.any() else (rep[:0], rep[:0])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        held, name = [], None  # parts of the last bucket, which may go on in the next batch
        for batch in batches:
            c, v, fp, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("c", "v", "_fp", "_rep"))
            if not len(c):
                continue
            first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (v[1:] != v[:-1])])
            ends, last = np.r_[first[1:], len(c)], int(first[-1])
            if name == (c[0], v[0]):
                held.append((fp[: ends[0]], rep[: ends[0]]))
                first, ends = first[1:], ends[1:]
            if not len(first):
                continue
            if held:
                own = [np.concatenate(p) for p in zip(*held, strict=True)]
                yield found(np.zeros(len(own[0]), np.int64), *own)
            begin = int(first[0])
            if begin < last:
                yield found(np.repeat(np.arange(len(first) - 1), (ends - first)[:-1]), fp[begin:last], rep[begin:last])
            held, name = [(fp[last:].copy(), rep[last:].copy())], (c[last], v[last])
        if held:
            own = [np.concatenate(p) for p in zip(*held, strict=True)]
            yield found(np.zeros(len(own[0]), np.int64), *own)

    dealt = keyed.repartition("c", "v").sortWithinPartitions("c", "v")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 2, blocks: int = BLOCKS, scratch: Scratch | None = None) -> DataFrame:
    """Per row: the id, ``fingerprint`` (long) and ``component_id``, the smallest id reachable over links."""
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    fps = scratch.save(fingerprints(df.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_t")), "_t", shingle, ("_id",)))
    reps = scratch.save(fps.where("_id is not null").groupBy("_fp").agg(F.min("_id").alias("_rep")))
    comp = components(links(reps, radius, blocks), scratch)
    named = reps.join(comp, reps["_rep"] == comp["node"], "left").select("_fp", F.coalesce("component", "_rep").alias("_comp"))
    out = fps.join(named, "_fp", "left")
    return out.select(F.col("_id").alias(id), F.col("_fp").alias("fingerprint"), F.when(F.col("_id").isNotNull(), F.col("_comp")).alias("component_id"))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 3, blocks: int = BLOCKS, send_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``df``, as they came, less all but one of each linked set of fingerprints.

    A row is known by its id and fingerprint, and the smallest of a set stays:
    ids that stand for several texts lose the copies among them only.  Of rows
    alike in both, one stays.  Rows with a null id stay.  The ids to leave out
    are broadcast only where they are counted to be at most ``send_rows``; texts
    move only beyond that, or where an id occurs more than once.
    """
    scratch, inner = Scratch(df.sparkSession, "simhash-kept"), Scratch(df.sparkSession, "simhash")
    fps = inner.save(fingerprints(df.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_t")), "_t", shingle, ("_id",)).where("_id is not null"))
    firsts = inner.save(fps.groupBy("_fp").agg(F.min("_id").alias("_low")))
    comp = components(links(firsts.select("_fp", F.col("_fp").alias("_rep")), radius, blocks), inner)
    named = firsts.join(comp, firsts["_fp"] == comp["node"], "left")
    stay = named.groupBy(F.coalesce("component", "_fp")).agg(F.min(F.struct(F.col("_low").alias("_id"), "_fp")).alias("_k")).select("_k.*")
    stay = scratch.save(stay)
    again = scratch.save(fps.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_id").alias("_gone")))
    out = scratch.save(fps.distinct().join(stay, ["_id", "_fp"], "left_anti").select(F.col("_id").alias("_gone")).union(again).distinct())
    inner.drop(inner.root)
    bounded = lambda ids: F.broadcast(ids) if ids.count() <= send_rows else ids
    own = df[id].cast("long")
    kept = df.join(bounded(out), own == out["_gone"], "left_anti")
    if not again.limit(1).count():
        return kept
    rows = df.join(bounded(again), own == again["_gone"], "left_semi").select(F.struct("*").alias("_row"), own.alias("_id"), F.col(text).cast("string").alias("_t"))
    rows = fingerprints(rows, "_t", shingle, ("_row", "_id", "_t")).join(stay, ["_id", "_fp"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", "_fp").orderBy(F.xxhash64("_t"), "_t"))
    return kept.unionByName(rows.withColumn("_place", first).where("_place = 1").select("_row.*"))
