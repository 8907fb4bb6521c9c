"""Two builds of one table compared by a tree of digests: only ranges that differ are read again.

A snapshot keeps the rows in order of a hash of their key, cut into leaves, and
for each leaf its rows, an xor and a sum of the rows' digests: they do not
depend on the order of rows, and equal rows count as often as they occur.  A
node of the level above stands for sixteen below it.  Two snapshots with as many
leaves are compared from the root down, each time only below nodes that differ;
rows are read in the leaves that are left, and by the sorted column, so a scan
skips the others.

Nulls and edges: a null key is a key; nulls in rows are told from each other by
their column; equal rows and repeated keys are compared as often as they
occur; an empty build differs from any other in all of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.sources.sinks import shared_table
from quillspark.sources.tables import table

#: Bits by which a node is smaller than the one above, and rows of a leaf.
STEP, LEAF_ROWS = 4, 16
#: Leaves that are named in a filter; of more the rows are joined with them.
NAMED = 5_000


@dataclass
class Snapshot:
    """Rows with their leaf, and digests by leaf; ``bits`` leaves as a power of two."""

    rows: DataFrame
    digests: DataFrame
    bits: int


def leaf_bits(n_rows: int) -> int:
    """Bits for leaves of about ``LEAF_ROWS`` rows, whole steps of the tree."""
    bits = STEP
    while bits < 32 and n_rows >> bits > LEAF_ROWS:
        bits += STEP
    return bits


def snapshot(df: DataFrame, key: str, bits: int) -> Snapshot:
    """A build in order of its keys' hashes, written, with its digests."""
    leaf = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))), 64 - bits)
    named = df.withColumn("_leaf", leaf)
    rows = shared_table(named.repartitionByRange("_leaf", F.xxhash64(*df.columns)).sortWithinPartitions("_leaf"))
    # a row as text: a null, an empty text and a text in the next column all differ
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    each = rows.select("_leaf", F.xxhash64(text).alias("x"), (F.xxhash64(F.concat(F.lit("+"), text)) % (1 << 40)).alias("s"))
    return Snapshot(rows, shared_table(each.groupBy("_leaf").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))), bits)


def level(digests: DataFrame, bits: int, of: int, inside: DataFrame | None) -> DataFrame:
    """Digests of the nodes of a level, below the nodes given."""
    rows = digests.withColumn("node", F.shiftrightunsigned("_leaf", bits - of))
    if inside is not None:
        rows = rows.join(inside, F.shiftrightunsigned("node", STEP) == inside["above"], "left_semi")
    return rows.groupBy("node").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))


def differing(a: Snapshot, b: Snapshot) -> DataFrame:
    """The leaves in which two snapshots differ, found from the root down."""
    if a.bits != b.bits:
        raise ValueError("snapshots of different depth")
    inside = None
    for of in range(STEP, a.bits + 1, STEP):
        left, right = (level(s.digests, s.bits, of, inside).alias(n) for s, n in ((a, "l"), (b, "r")))
        same = F.col("l.n").eqNullSafe(F.col("r.n")) & F.col("l.x").eqNullSafe(F.col("r.x")) & F.col("l.s").eqNullSafe(F.col("r.s"))
        unlike = left.join(right, F.col("l.node") == F.col("r.node"), "full_outer").where(~same)
        inside = shared_table(unlike.select(F.coalesce("l.node", "r.node").alias("above")))
    return inside.withColumnRenamed("above", "_leaf")


def inside(s: Snapshot, leaves: DataFrame) -> DataFrame:
    """The rows of some leaves; few leaves are pushed down to the scan."""
    few = leaves.limit(NAMED + 1).collect()
    if len(few) <= NAMED:
        return s.rows.where(F.col("_leaf").isin([r["_leaf"] for r in few]))
    return s.rows.join(leaves, "_leaf", "left_semi")


def changes(a: Snapshot, b: Snapshot) -> DataFrame:
    """``exceptAll`` both ways: the rows of one build alone, each as often as the other lacks it, with their side."""
    leaves = differing(a, b)
    left, right = inside(a, leaves).drop("_leaf"), inside(b, leaves).drop("_leaf")
    return left.exceptAll(right).withColumn("side", F.lit("base")).union(right.exceptAll(left).withColumn("side", F.lit("rebuild")))


def report(a: Snapshot, b: Snapshot, identity: list[str], text: str) -> DataFrame:
    """(check, base, rebuild, same): rows, identities, bytes, characters and the whole content of both builds."""
    parts = []
    for s in (a, b):
        one = F.to_json(F.struct(*identity), {"ignoreNullFields": "false"})
        sums = s.rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"), F.coalesce(F.sum(F.xxhash64(one) % (1 << 40)), F.lit(0)).alias("identities"))
        parts.append(sums.crossJoin(s.digests.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("content"))))  # one row each
    names = ["rows", "identities", "bytes", "characters", "content"]
    long = lambda d, c: d.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias(c)) for n in names])))
    both = long(parts[0], "base").join(long(parts[1], "rebuild"), "check")
    return both.withColumn("same", F.col("base") == F.col("rebuild"))


def _builds(spark, sf) -> tuple[Snapshot, Snapshot]:
    """The documents, and a rebuild of them with edited, missing and new ones."""
    base = table(spark, sf, "documents").select("doc_id", "source", "text")
    edited = base.where("doc_id % 101 <> 5").withColumn("text", F.when(F.col("doc_id") % 211 == 7, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    edited = edited.union(base.where("doc_id % 307 = 9").select(-F.col("doc_id"), "source", "text"))
    bits = leaf_bits(base.count())
    return snapshot(base, "doc_id", bits), snapshot(edited, "doc_id", bits)


BUILDS = """e as (select doc_id, source, case when doc_id % 211 = 7 then text || '.' else text end as text from documents where doc_id % 101 <> 5 union all select -doc_id, source, text from documents where doc_id % 307 = 9)"""


@query(
    "rebuild_changes",
    f"""with {BUILDS} select 'base' as side, doc_id, sha256(text) as sha256 from (select doc_id, source, text from documents except all select * from e)
    union all select 'rebuild', doc_id, sha256(text) from (select * from e except all select doc_id, source, text from documents)""",
)
def rebuild_changes(spark, sf):
    return changes(*_builds(spark, sf)).select("side", "doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "rebuild_report",
    f"""with {BUILDS}, b as (select count(*) as rows, sum(strlen(text)) as bytes, sum(length(text)) as characters from documents), r as (select count(*) as rows, sum(strlen(text)) as bytes, sum(length(text)) as characters from e)
    select 'rows' as "check", b.rows = r.rows as same from b, r union all select 'bytes', b.bytes = r.bytes from b, r union all select 'characters', b.characters = r.characters from b, r
    union all select x, (select count(*) from (select doc_id, source, text from documents except all select * from e)) + (select count(*) from (select * from e except all select doc_id, source, text from documents)) = 0 from (select unnest(['identities', 'content']) as x)""",
)
def rebuild_report(spark, sf):
    return report(*_builds(spark, sf), ["doc_id", "source", "text"], "text").select("check", "same")
