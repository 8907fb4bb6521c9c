"""How quality filters overlap: what each removes after any others, in any order.

A text's failures are a set.  Documents are counted by part, failure set and
labels; from these counts each part gets its lattice: an edge for every set of
filters already applied and every filter that comes next (80 of them for five
filters), with what that filter keeps and removes there.  An order of the
filters is a path through the lattice, so the counts of its steps are a join of
edges with the steps of all orders (600); no document is looked at again.

Filters A to E fail a text of under 50 words; with under 65 distinct words of
100; with over 5 ASCII capitals in 100 code points; that holds any of
``#$%&*|``; that is identical to the text of any smaller id, removed or not.

Copies: the rows of one text are counted by part and label inside the tasks
first, so a text that a third of all rows share is a few rows by then; only the
counts of one text's parts meet in a task.

Nulls and edges: a null text is empty; an empty text has no words, so it fails
A alone of A to D; a row with a null id fails no E and makes none fail, and
rows that share an id don't make each other fail; a null part is the empty
string.  A document is good or toxic if any label of its id says so.  An empty
table gives an empty result; a part whose documents fail nothing has its rows
with zeros.  Texts are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS = 50, 65, 5
#: Capitals, marks, and the bytes of a character after its first.
UPPER, MARKS, FOLLOWING = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits 0 to 3: whether a UTF-8 text fails A to D."""
    words = text.split()
    n, marks = len(words), len(text) - len(text.translate(None, MARKS))
    capitals, points = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, FOLLOWING))
    return (n < MIN_WORDS) | (100 * len(set(words)) < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * points) << 2 | (marks > 0) << 3


def measured(df: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """(_id, _part, _text, _fails): the text as a 128-bit hash, failures A to D as bits."""
    source = df.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, fails = [], []
            for t in batch.column("_t").cast(pa.binary()):
                t = t.as_py() or b""
                name.append(hashlib.blake2b(t, digest_size=16).digest())
                fails.append(failures(t))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_part"), pa.array(name, pa.binary()), pa.array(fails, pa.int32())], ["_id", "_part", "_text", "_fails"])

    return source.mapInArrow(run, "_id long, _part string, _text binary, _fails int")


def counted(rows: DataFrame) -> DataFrame:
    """(_part, _set, _good, _toxic, _n): rows by part, whole failure set and labels."""
    own = ["_text", "_part", "_fails", "_good", "_toxic"]
    by_id = rows.groupBy(*own, "_id").agg(F.count("*").alias("_c"))
    some = by_id.groupBy(*own).agg(F.sum("_c").alias("_n"), F.min("_id").alias("_low"), F.min_by("_c", "_id").alias("_c_low"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_c"))), F.lit(0)).alias("_c_null"))
    # of one text there is a row a part and label here, however many copies it has
    lowest = F.min("_low").over(Window.partitionBy("_text"))
    first = F.coalesce(F.when(F.col("_low") == lowest, F.col("_c_low")), F.lit(0)) + F.col("_c_null")
    copy = 1 << FILTERS.index("E")
    both = some.withColumn("_own", first).select("*", F.inline(F.array(F.struct(F.col("_fails").alias("_set"), F.col("_own").alias("_m")), F.struct((F.col("_fails") + copy).alias("_set"), (F.col("_n") - F.col("_own")).alias("_m")))))
    return both.where("_m > 0").groupBy("_part", "_set", "_good", "_toxic").agg(F.sum("_m").alias("_n"))


def edges(counts: DataFrame) -> DataFrame:
    """(_part, _before, _next) and what the filter keeps, removes, would remove and loses there; 80 rows a part."""
    n = len(FILTERS)
    lattice = [(s, 1 << f) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    each = counts.select("*", F.inline(F.array(*[F.struct(F.lit(s).alias("_before"), F.lit(f).alias("_next")) for s, f in lattice])))
    fails, gone = F.col("_set").bitwiseAND(F.col("_next")) > 0, F.col("_set").bitwiseAND(F.col("_before")) > 0
    named = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": F.col("_set") == F.col("_next"), "good_lost": fails & ~gone & F.col("_good"), "toxic_lost": fails & ~gone & F.col("_toxic")}
    return each.groupBy("_part", "_before", "_next").agg(*(F.sum(F.when(c, F.col("_n")).otherwise(F.lit(0))).cast("long").alias(k) for k, c in named.items()))


def paths() -> list[tuple[str, int, int, int]]:
    """(order, step, filters before as bits, the step's filter as a bit) of all orders of the filters."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source", send_rows: int = 2_000_000) -> DataFrame:
    """One row per part, order of the filters and step, with the documents kept, removed, redundant, failing this filter alone, good and toxic ones lost, and ``shapley``, the removals of the step's filter over all orders."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "audit")
    named = labels.select(F.col(id).cast("long").alias("_l"), (F.col("quality") == 1).alias("_q"), (F.col("toxic") == 1).alias("_x")).where("_l is not null and (_q or _x)")
    named = named.groupBy("_l").agg(F.coalesce(F.bool_or("_q"), F.lit(False)).alias("_q"), F.coalesce(F.bool_or("_x"), F.lit(False)).alias("_x"))
    named = F.broadcast(named) if named.count() <= send_rows else named
    rows = measured(df, id, text, part).join(named, F.col("_id") == F.col("_l"), "left")
    rows = rows.select("_id", "_part", "_text", "_fails", F.coalesce("_q", F.lit(False)).alias("_good"), F.coalesce("_x", F.lit(False)).alias("_toxic"))
    lattice = scratch.save(edges(counted(rows)))
    n = len(FILTERS)
    # the orders in which so many filters come before and so many after
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("_before") + 1)
    worth = lattice.groupBy("_part", "_next").agg(F.sum(F.col("removed") * ways).cast("long").alias("shapley"))
    steps = spark.createDataFrame(paths(), "filter_order string, step int, _before int, _next int")
    out = lattice.join(worth, ["_part", "_next"]).join(F.broadcast(steps), ["_before", "_next"])
    return out.select(F.col("_part").alias("part"), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
