"""Data selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models, of target text (labelled as good) and of raw text
(every row), count words and word pairs in ``BUCKETS`` hash buckets.  A text's
log weight is the sum over its n-grams of log target - log raw probability.
Adding Gumbel noise to log weights and taking the k largest draws k rows
without replacement in proportion to their weights.

Counts run over all rows of both texts; a task sends one row for each bucket,
and both models together are two arrays of ``BUCKETS`` numbers, whatever the
corpus.  The k-th largest key is found exactly by radix selection: counts of at
most 65,536 key prefixes come to the driver in each of four rounds, no row does.
Noise is a hash of id and seed, so lost executors and reruns change nothing.

Nulls and edges: a null or empty text has log weight 0; null labels and ids are
no target; rows with equal keys are told apart by id hash, and equal rows share
a draw (all or none of those tied at the cut stay, in favour of keeping); k is
a share of the rows, rounded; without target rows all weights are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import WORD_BYTES, hashed_words, mix

BUCKETS, SHARE, SMOOTH = 1 << 16, 0.85, 1.0
_U = np.uint64


def buckets(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and pair of neighbouring words."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    pairs = mix(words[inner] * _U(0x9DDFEA08EB382D69) + words[inner + 1])
    return (np.concatenate([words, pairs]) >> _U(48)).astype(np.int64), np.concatenate([rows, rows[inner]])


def counts(rows: DataFrame) -> np.ndarray:
    """Counts of all buckets: raw in the first row, target (where ``_target``) in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = batch.column("_target").to_numpy(zero_copy_only=False).astype(bool)
            for i, _, words, row, *_ in hashed_words(batch.column("_t"), WORD_BYTES):
                b, r = buckets(words, row)
                n[0] += np.bincount(b, minlength=BUCKETS)
                n[1] += np.bincount(b[target[i + r]], minlength=BUCKETS)
        some = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (some, n[0, some], n[1, some])], ["b", "raw", "target"])

    out = np.zeros((2, BUCKETS), np.int64)
    got = rows.select("_t", "_target").mapInArrow(run, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    for r in got.collect():  # BUCKETS rows at most
        out[:, r.b] = r.raw, r.target
    return out


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs in ``_key``, by 16 bits a round; null where there are fewer."""
    if k <= 0:
        return None
    prefix, left = 0, k
    unsigned = F.col("_key").bitwiseXOR(F.lit(-(1 << 63)))  # order of signed longs as unsigned bits
    for shift in (48, 32, 16, 0):
        part = keys.where(F.shiftrightunsigned(unsigned, shift + 16) == prefix) if shift < 48 else keys
        digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit(0xFFFF))
        for r in sorted(part.groupBy(digit.alias("d")).count().collect(), key=lambda r: -r.d):
            if left <= r["count"]:
                prefix = prefix << 16 | r.d
                break
            left -= r["count"]
        else:
            return None
    return prefix - (1 << 63)


def resample(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", share: float = SHARE, seed: int = 7, label_rows: int = 2_000_000) -> DataFrame:
    """Per row: the id, ``log_weight``, ``score`` (log weight with Gumbel noise) and ``kept``.

    Labels join by broadcast only where their counted rows are at most ``label_rows``.
    """
    good = labels.select(F.col(id).alias("_label_id")).where((F.col(label) == 1) & F.col(id).isNotNull()).distinct().withColumn("_good", F.lit(True))
    good = F.broadcast(good) if labels.count() <= label_rows else good
    source = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t"))
    rows = source.join(good, source["_id"] == good["_label_id"], "left").select("_t", F.col("_good").isNotNull().alias("_target"))
    n = counts(rows).astype(float)
    p = (n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    ratio = np.log(p[1] / p[0]) if n[1].sum() else np.zeros(BUCKETS)
    sent = df.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for i, j, words, row, *_ in hashed_words(batch.column("_t"), WORD_BYTES):
                b, r = buckets(words, row)
                weight[i:j] = np.bincount(r, ratio[b], minlength=j - i)
            u = (batch.column("_h").to_numpy(zero_copy_only=False).view(_U) >> _U(11)).astype(float) + 0.5
            score = weight - np.log(-np.log(u / 2.0**53))
            bits = np.where(score == 0, 0.0, score).view(np.int64)
            key = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)  # order of doubles as order of longs
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(weight), pa.array(score), pa.array(key)], ["_id", "log_weight", "score", "_key"])

    seeded = source.select("_id", "_t", F.xxhash64(F.col("_id").cast("string"), F.lit(seed)).alias("_h"))
    schema = source.select("_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("_key")).schema
    keyed = Scratch(df.sparkSession, "importance").save(seeded.mapInArrow(run, schema))
    cut = kth_largest(keyed.select("_key"), round(share * keyed.count()))
    kept = F.lit(False) if cut is None else F.col("_key") >= cut
    return keyed.select(F.col("_id").alias(id), "log_weight", "score", kept.alias("kept"))
