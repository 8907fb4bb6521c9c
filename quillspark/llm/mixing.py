"""Mixing sources to target weights by systematic sampling.

1. A text's size is its words (runs of anything but ASCII white space).
2. Sources, in order of code points and a missing one last, take the weights in
   turn.  They share ``share`` times all sizes by weight; a target stops at
   ``cap`` times its source's size, and the excess is shared again by weight
   among the others until none is above.
3. A document's expected copies are its source's target over its source's size.
   They are summed up through the source, documents in order of size and then
   of a hash of the id; one random offset a source is added, and a document is
   taken once for each whole number that its stretch of the sum crosses.  In
   order of size the words taken miss the target by less than about the longest
   document of the source.

Places in a source come from ranges of the order over all sources, so a source
with a third of all rows is spread like any other, and no task holds a source.
The shares are settled by one small aggregation over sources a round.  Offsets
and order come from hashes: reruns agree, whatever the partitioning.

Nulls and edges: a null or empty text has size 0, is taken as often as others
and adds no words; a source without words has target 0 and none of its texts is
taken; a null source is a source of its own, the empty string another; null and
repeated ids are rows like any other.  An empty table gives an empty result.
Other columns may have any names: those asked for come back in ``_row``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.order import numbered

from ._scratch import Scratch
from ._text import WORD_BYTES, buffers, slices, word_ranges

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Hexadecimal digits of a source's offset, which is a whole number of 2**-20.
DIGITS = 5


def sized(df: DataFrame, id: str, source: str, text: str, keep: Sequence[str]) -> DataFrame:
    """``_row`` (the columns ``keep``), ``_id``, ``_source`` and ``_size`` of every row."""
    rows = df.select(F.struct(*keep).alias("_row"), F.col(id).cast("string").alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_t"))
            size = np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offsets):
                row = word_ranges(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORD_BYTES)[2]
                size[i:j] = np.bincount(row, minlength=j - i)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_id", "_source")), pa.array(size)], ["_row", "_id", "_source", "_size"])

    return rows.mapInArrow(run, rows.select("_row", "_id", "_source", F.lit(0).cast("long").alias("_size")).schema)


def settle(sources: DataFrame, share: float, cap: float) -> tuple[float, float]:
    """What a unit of weight gets once no target is above its cap: (words, weight) that the others share.

    ``sources`` has ``_source_size`` and ``_weight``.  Shares only grow from
    round to round, so sources that have stopped stay stopped.
    """
    full = cap * F.col("_source_size")
    total = sources.agg(F.sum("_source_size").alias("s"), F.sum("_weight").alias("w")).first()
    words, weight, stopped = share * float(total.s or 0), float(total.w or 0), 0
    while weight:
        at = full <= F.lit(words / weight) * F.col("_weight")
        now = sources.agg(F.count_if(at).alias("n"), F.sum(F.when(at, full)).alias("f"), F.sum(F.when(~at, F.col("_weight"))).alias("w")).first()
        if now.n == stopped:
            break
        stopped, words, weight = now.n, share * float(total.s) - float(now.f), float(now.w or 0)
    return words, weight


def offset(source: Column) -> Column:
    """A source's random offset in [0, 1)."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit("="), source), F.lit("-"))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def mix(df: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", keep: Sequence[str] | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, send_rows: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``df``: ``_row`` (its columns ``keep``, all by default), ``_size``, ``_source_size``, ``_target`` and ``_copies``."""
    scratch = scratch or Scratch(df.sparkSession, "mix")
    hashed = sized(df, id, source, text, list(keep if keep is not None else df.columns)).withColumn("_h", F.md5(F.coalesce("_id", F.lit(""))))
    # rows of one id and size, should they differ elsewhere, come in an order of their contents
    order = [F.asc_nulls_last("_source"), F.col("_size"), F.col("_h"), F.asc_nulls_first("_id"), F.xxhash64(F.to_json("_row"))]
    rows = numbered(hashed, order, "_at", scratch.save).drop("_h", "_id")
    sums = scratch.save(rows.groupBy("_source").agg(F.count("*").alias("_n"), F.sum("_size").alias("_source_size"), F.min("_at").alias("_first")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    sources = scratch.save(numbered(sums, [F.asc_nulls_last("_source")], "_place", scratch.save).withColumn("_weight", weight))
    words, left = settle(sources, share, cap)
    full, fair = (cap * F.col("_source_size")).cast("double"), F.lit(words / left if left else float("inf")) * F.col("_weight")
    target = F.when((full <= fair) | F.lit(not left), full).otherwise(fair)
    named = sources.withColumn("_target", target).withColumn("_rate", F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0)))
    named = named.withColumn("_offset", offset(F.col("_source"))).drop("_n", "_place", "_weight")
    named = F.broadcast(named) if sources.count() <= send_rows else named
    out = rows.join(named.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
    upto = lambda i: F.floor(F.col("_rate") * i + F.col("_offset"))
    place = F.col("_at") - F.col("_first") + 1
    return out.select("_row", "_size", "_source_size", "_target", (upto(place) - upto(place - 1)).cast("long").alias("_copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows, each as often as it is taken."""
    copies = F.when(F.col("_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return mixed.select("_row", F.explode(copies).alias("_copy")).select("_row.*")
