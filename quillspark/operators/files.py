"""Integrity, serialization and merging of corpora."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.splits import MEETINGS, with_split
from quillspark.plans.registry import query
from quillspark.sources.sinks import read_manifest, read_split, shared_root
from quillspark.sources.tables import DOCS, documents, table
from quillspark.sources.versions import Versions


#: Files of split manifests, and meetings of one entry list.
MANIFESTS, MANIFEST_ROWS = 16, 4096


def digests(df: DataFrame, text: str) -> DataFrame:
    """SHA-256 of the UTF-8 bytes of a text column."""
    return df.withColumn("sha256", F.sha2(F.col(text), 256))


def mismatches(df: DataFrame, expected: DataFrame, id: str, text: str) -> DataFrame:
    """Rows whose digest differs from the expected one, with both digests."""
    return digests(df, text).join(expected, id).where("sha256 <> expected").select(id, "sha256", "expected")


def serialized(docs: DataFrame) -> DataFrame:
    """Each document between markers of its genre, under its header lines."""
    head = F.format_string("<|%s|>\ndocument_id: %d\ndate: %s\n\n", "genre", "doc_id", F.date_format("meeting_date", "yyyy-MM-dd"))
    return docs.withColumn("serialized", F.concat(head, F.trim("body"), F.lit("\n<|end_"), F.col("genre"), F.lit("|>\n")))


def tagged_union(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Both corpora, each row with the name of its source."""
    return left.withColumn("source_corpus", F.lit(left_name)).unionByName(right.withColumn("source_corpus", F.lit(right_name)))


@query("sha256_documents", "select doc_id, sha256(text) as sha256 from documents")
def sha256_documents(spark, sf):
    return digests(table(spark, sf, "documents"), "text").select("doc_id", "sha256")


@query(
    "hash_mismatch",
    """select doc_id, sha256(text) as sha256, case when doc_id % 97 = 5 then sha256('') else sha256(text) end as expected
    from documents where doc_id % 97 = 5 and text <> ''""",
)
def hash_mismatch(spark, sf):
    docs = table(spark, sf, "documents")
    stated = docs.select("doc_id", F.when(F.col("doc_id") % 97 == 5, F.sha2(F.lit(""), 256)).otherwise(F.sha2("text", 256)).alias("expected"))
    return mismatches(docs, stated, "doc_id", "text")


@query(
    "serialize_corpus",
    f"""with {DOCS} select doc_id, sha256('<|' || genre || '|>' || chr(10) || 'document_id: ' || doc_id || chr(10) || 'date: ' || strftime(meeting_date, '%Y-%m-%d')
    || chr(10) || chr(10) || trim(body) || chr(10) || '<|end_' || genre || '|>' || chr(10)) as serialized_sha256 from docs""",
)
def serialize_corpus(spark, sf):
    return serialized(documents(spark, sf)).select("doc_id", F.sha2("serialized", 256).alias("serialized_sha256"))


@query(
    "merge_corpora",
    f"""with {DOCS} select case when genre = 'statement' then 'statements' else 'minutes' end as source_corpus, count(*) as documents,
    sum(length(body))::bigint as characters, min(meeting_date) as first_date, max(meeting_date) as last_date from docs group by 1""",
)
def merge_corpora(spark, sf):
    docs = documents(spark, sf)
    both = tagged_union(docs.where("genre = 'statement'"), docs.where("genre = 'minutes'"), "statements", "minutes")
    return both.groupBy("source_corpus").agg(
        F.count("*").alias("documents"), F.sum(F.length("body")).alias("characters"), F.min("meeting_date").alias("first_date"), F.max("meeting_date").alias("last_date")
    )


@query(
    "merge_id_overlap",
    f"""with {DOCS} select meeting_id from docs where genre = 'statement' intersect select meeting_id from docs where genre = 'minutes'""",
)
def merge_id_overlap(spark, sf):
    docs = documents(spark, sf)
    return docs.where("genre = 'statement'").select("meeting_id").intersect(docs.where("genre = 'minutes'").select("meeting_id"))


@query(
    "manifest_reconcile",
    f"""with {DOCS}, m as (select doc_id, genre, length(body) + case when doc_id % 50 = 7 then 1 else 0 end as n from docs where doc_id % 61 <> 3
      union all select -1, 'minutes', 10),
    j as (select coalesce(d.doc_id, m.doc_id) as doc_id, d.doc_id as a, m.doc_id as b, d.genre as g, m.genre as h, length(d.body) as n, m.n as k from docs d full join m on d.doc_id = m.doc_id)
    select doc_id, case when a is null then 'missing_document' when b is null then 'missing_entry' when g <> h then 'genre' else 'length' end as violation
    from j where a is null or b is null or g <> h or n <> k""",
)
def manifest_reconcile(spark, sf):
    docs = documents(spark, sf).select("doc_id", "genre", F.length("body").alias("n"))
    entries = docs.where("doc_id % 61 <> 3").withColumn("n", F.col("n") + (F.col("doc_id") % 50 == 7).cast("int"))
    entries = entries.unionByName(spark.createDataFrame([(-1, "minutes", 10)], "doc_id long, genre string, n int"))
    return reconcile(docs, entries)


def reconcile(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Every way in which documents and manifest entries (doc_id, genre, n) disagree."""
    d, m = docs.alias("d"), entries.alias("m")
    joined = d.join(m, F.col("d.doc_id") == F.col("m.doc_id"), "full_outer")
    kind = (
        F.when(F.col("d.doc_id").isNull(), "missing_document").when(F.col("m.doc_id").isNull(), "missing_entry")
        .when(F.col("d.genre") != F.col("m.genre"), "genre").when(F.col("d.n") != F.col("m.n"), "length")
    )
    return joined.select(F.coalesce("d.doc_id", "m.doc_id").alias("doc_id"), kind.alias("violation")).where("violation is not null")


@query("snapshot_diff", "select doc_id, 'changed' as side from documents where doc_id % 40 = 9 union all select doc_id, 'base' from documents where doc_id % 40 = 9")
def snapshot_diff(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    changed = base.withColumn("sha256", F.when(F.col("doc_id") % 40 == 9, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    left, right = base.exceptAll(changed), changed.exceptAll(base)
    return left.select("doc_id", F.lit("base").alias("side")).union(right.select("doc_id", F.lit("changed").alias("side")))


@query(
    "versioned_corpus",
    f"""with {DOCS}, v as (select 1 as version, 'statements' as run_id, doc_id, body from docs where genre = 'statement' union all select 2, 'all', doc_id, body from docs)
    select version, run_id, count(*)::bigint as documents, sum(length(body))::bigint as characters, version = 2 as holds from v group by all""",
)
def versioned_corpus(spark, sf):
    """A corpus written twice to one versioned table: each version as it reads afterwards, and which one holds."""
    docs = documents(spark, sf).select("doc_id", "genre", "body")
    kept = Versions(spark, f"{shared_root(spark)}/corpus-{uuid.uuid4().hex}")
    kept.replace(docs.where("genre = 'statement'"), "statements")
    kept.replace(docs, "all")
    found = [kept.read(c["version"]).select(F.lit(c["version"]).alias("version"), F.lit(c["run_id"]).alias("run_id"), "body") for c in kept.commits()]
    rows = reduce(DataFrame.union, found).groupBy("version", "run_id").agg(F.count("*").alias("documents"), F.sum(F.length("body")).alias("characters"))
    return rows.withColumn("holds", F.col("version") == F.lit(kept.commits()[-1]["version"]))


@query(
    "split_manifests",
    f"""with {MEETINGS} select doc_id::varchar as id, split from split_docs""",
)
def split_manifests(spark, sf):
    """Split manifests, a file for each part of the meetings, written for the corpus and read back with its digest checked."""
    docs = with_split(documents(spark, sf)).select("doc_id", "meeting_id", "split")
    corpus = F.sha2(F.lit("corpus of the documents table"), 256)
    part = F.col("meeting_id") % MANIFESTS
    entries = docs.groupBy(part.alias("part"), F.floor(F.col("meeting_id") / MANIFEST_ROWS).alias("chunk")).agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("id"), "split")).alias("documents"))
    path = f"{shared_root(spark)}/splits-{uuid.uuid4().hex}"
    entries.select("part", "chunk", corpus.alias("corpus_sha256"), "documents").write.partitionBy("part", "chunk").json(path)  # a row a file
    expected = spark.range(1).select(corpus).first()[0]
    return read_split(spark, path, expected)


@query(
    "corpus_manifest",
    f"""with {DOCS} select genre, count(*)::bigint as documents, sum(length(body))::bigint as characters, sum(strlen(body))::bigint as utf8_bytes, min(meeting_date) as first_date, max(meeting_date) as last_date from docs group by genre""",
)
def corpus_manifest(spark, sf):
    """The corpus's manifest by genre, written as JSON and read back by its schema."""
    docs = documents(spark, sf)
    found = docs.groupBy("genre").agg(F.count("*").alias("documents"), F.sum(F.length("body")).alias("characters"), F.sum(F.octet_length("body")).alias("utf8_bytes"), F.min("meeting_date").alias("first_date"), F.max("meeting_date").alias("last_date"))
    path = f"{shared_root(spark)}/manifest-{uuid.uuid4().hex}"
    found.write.partitionBy("genre").json(path)  # a row a file
    return read_manifest(spark, path, "genre string, documents long, characters long, utf8_bytes long, first_date date, last_date date")
