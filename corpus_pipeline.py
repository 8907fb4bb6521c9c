"""A corpus pipeline: rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and hands the reread table to the next one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontam, quality_rules, simhash, suffix_dedup
from quillspark.llm._scratch import Scratch
from quillspark.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("_kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each set of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes or more that occur anywhere else go from the texts; all documents stay, as they came where nothing goes (a null text stays null)."""
    found = suffix_dedup.dedup(docs, as_text=True)
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    changed = F.col("_n_removed") > 0
    return found.select(*((F.when(changed, new[c]).otherwise(F.col("_row")[c]) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go."""
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return bpe.digests(bpe.encode(docs, *tokenizer()))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", tokenize),
]

#: SQL cannot express fingerprints, alignment and merges; tests hold ``run`` against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs, path = scratch.table(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = path
    return docs
