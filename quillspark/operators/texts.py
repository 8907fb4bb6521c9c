"""Normalization, checks and parsing of texts."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.operators.files import serialized
from quillspark.operators.splits import MEETINGS, with_split
from quillspark.plans.registry import query
from quillspark.sources.tables import DOCS, documents, table


@F.pandas_udf(StringType())
def nfd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFD", t))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def unescaped_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def normalized(text: Column) -> Column:
    """Accents and format characters dropped, in this order: decompose, drop marks, drop formats, map, compose."""
    bare = F.regexp_replace(F.regexp_replace(nfd(text), "\\p{Mn}", ""), "\\p{Cf}", "")
    return nfc(F.translate(bare, "øØ®™©", "oO"))


# Characters that become plain ones, and control characters of an older code page.
PLAIN = ((" ", " "), ("‘", "'"), ("’", "'"), ("‚", "'"), ("“", '"'), ("”", '"'), ("„", '"'), ("−", "-"), ("‑", "-"))
CP1252 = (("\u0091", "'"), ("\u0092", "'"), ("\u0093", '"'), ("\u0094", '"'), ("\u0095", "-"), ("\u0096", "-"), ("\u0097", "--"), ("\u0085", "..."))


def repaired(text: Column) -> Column:
    """Control characters left over from Windows-1252 become the punctuation they stood for."""
    for old, new in CP1252:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def plain_layout(text: Column) -> Column:
    """Line ends, dashes, spaces and blank lines in one form; the text is unescaped and composed already."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.translate(text, "".join(a for a, _ in PLAIN), "".join(b for _, b in PLAIN))
    text = F.regexp_replace(text, "(?<=\\d)\\s*[–—]\\s*(?=\\d)", "-")
    text = F.regexp_replace(text, "[–—]", " -- ")
    text = F.regexp_replace(F.translate(text, "\t", " "), "[ \\f\\x0B]+", " ")
    text = F.regexp_replace(text, "(?m)^[ ]+|[ ]+$", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def controls(text: Column) -> Column:
    """Control characters other than line end and tab, each once, as U+ codes in order."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[\\p{Cc}&&[^\\n\\t]]"), F.lit(0))))
    return F.transform(found, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))


@query("normalize_text", "select doc_id, sha256(nfc_normalize(translate(regexp_replace(strip_accents(text), '[\\p{Cf}]', '', 'g'), 'øØ®™©', 'oO'))) as normalized_sha256 from documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(normalized(F.col("text")), 256).alias("normalized_sha256"))


@query(
    "normalize_finance",
    """with a as (select doc_id, nfc_normalize(text || ' 3 – 4 — x') as t from documents),
    b as (select doc_id, translate(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160) || '‘’‚“”„−‑', ' ''''''"""
    '"""'
    """--') as t from a),
    c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(\\d)\\s*[–—]\\s*(\\d)', '\\1-\\2', 'g'), '[–—]', ' -- ', 'g'), '[ \\t\\f\\v]+', ' ', 'g') as t from b),
    d as (select doc_id, regexp_replace(regexp_replace(t, '(^|\\n) ', '\\1', 'g'), ' (\\n|$)', '\\1', 'g') as t from c)
    select doc_id, sha256(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as normalized_sha256 from d""",
)
def normalize_finance(spark, sf):
    text = F.concat("text", F.lit(" 3 – 4 — x"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(plain_layout(unescaped_nfc(text)), 256).alias("normalized_sha256"))


@query("repair_cp1252", "select doc_id, length(text) + 7 as n_chars, 'a' || '''' || 'b' || '...' || '--' as sample from documents")
def repair_cp1252(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.length(repaired(F.concat("text", F.lit("a\u0092b\u0085\u0096")))).cast("long").alias("n_chars"), repaired(F.lit("a\u0092b\u0085\u0097")).alias("sample"))


@query(
    "control_chars",
    "select doc_id, length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', '', 'g')) as n_controls, 'U+0007' as first_code from (select doc_id, text || chr(7) || chr(10) as t from documents)",
)
def control_chars(spark, sf):
    t = F.concat("text", F.lit("\x07\n"))
    docs = table(spark, sf, "documents").select("doc_id", F.length(F.regexp_replace(t, "[^\\p{Cc}]|[\\n\\t]", "")).cast("long").alias("n_controls"), controls(t).alias("c"))
    return docs.select("doc_id", "n_controls", F.get("c", F.lit(0)).alias("first_code"))


MARKED = "<\\|(statement|minutes)\\|>\n(.*?)<\\|end_\\1\\|>"


#: Keys of header lines.
HEADER = "(?:date|document_id|meeting_type)"


def outside(text: Column) -> Column:
    """Whether a serialized corpus holds text outside its documents."""
    return F.regexp_replace(text, "(?s)" + MARKED, "").rlike(r"\S")


def parsed(df: DataFrame, text: str) -> DataFrame:
    """Documents of a serialized corpus: header fields, body, and the first thing that is wrong with each.

    Between markers stand ``key: value`` lines, one blank line, the body and a line end.
    """
    rows = df.withColumn("_d", F.explode(F.regexp_extract_all(F.col(text), F.lit("(?s)" + MARKED), F.lit(0))))
    genre = F.regexp_extract("_d", "^<\\|(\\w+)\\|>", 1)
    inner = F.regexp_extract("_d", "(?s)" + MARKED, 2)
    rows = rows.withColumns({"genre": genre, "_i": inner})
    head = f"(?:{HEADER}: [^\n]*\n)*"
    rows = rows.withColumns({"_h": F.regexp_extract("_i", f"(?s)^({head})", 1), "_rest": F.regexp_replace("_i", f"(?s)^{head}", "")})
    rows = rows.withColumns(
        {
            "document_id": F.regexp_extract("_h", "(?m)^document_id: (.*)$", 1),
            "date": F.regexp_extract("_h", "(?m)^date: (.*)$", 1),
            "body": F.regexp_replace("_rest", "(?s)\\A\n|\n\\z", ""),
        }
    )
    wrong = (
        F.when((F.col("document_id") == "") | (F.col("date") == ""), "missing_header").when(~F.col("_rest").startswith("\n"), "no_blank_line")
        .when(~F.substring("_rest", 2, 1 << 30).endswith("\n"), "no_newline_at_end").when((F.col("body") == "") | F.col("body").startswith("\n") | F.col("body").endswith("\n"), "blank_edge")
        .when(F.col("body").contains("<|"), "marker_in_body").when(F.col("body").rlike(f"(?m)^{HEADER}: "), "header_in_body")
    )
    return rows.withColumn("violation", wrong).drop("_d", "_i", "_h", "_rest")


@query(
    "parse_documents",
    f"""with {DOCS} select doc_id::varchar as document_id, genre, strftime(meeting_date, '%Y-%m-%d') as date, length(trim(body)) as n_chars, sha256(trim(body)) as body_sha256,
    null::varchar as violation from docs""",
)
def parse_documents(spark, sf):
    found = parsed(serialized(documents(spark, sf)).select("serialized"), "serialized")
    return found.select("document_id", "genre", "date", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_sha256"), "violation")


@query(
    "parse_violations",
    f"""with {DOCS} select doc_id::varchar as id, case doc_id % 9 when 1 then 'missing_header' when 2 then 'header_in_body' when 3 then 'marker_in_body' when 4 then 'blank_edge' when 6 then 'blank_edge' when 7 then 'no_newline_at_end' end as violation,
    doc_id % 9 = 5 as is_outside from docs""",
)
def parse_violations(spark, sf):
    """Serialized documents with a fault in most: what the parser says of each."""
    k, d = F.col("doc_id") % 9, F.col("doc_id").cast("string")
    body = F.when(k == 4, "").otherwise(F.concat(F.trim("body"), F.when(k == 2, "\ndate: x").when(k == 3, "\n<|x").when(k == 6, "\n").otherwise("")))
    head = F.concat(F.lit("date: "), F.date_format("meeting_date", "yyyy-MM-dd"), F.when(k == 1, "").otherwise(F.concat(F.lit("\ndocument_id: "), d)), F.lit("\n\n"))
    text = F.concat(F.lit("<|"), F.col("genre"), F.lit("|>\n"), head, body, F.when(k == 7, "").otherwise("\n"), F.lit("<|end_"), F.col("genre"), F.lit("|>\n"), F.when(k == 5, "left over\n").otherwise(""))
    found = parsed(documents(spark, sf).select(d.alias("id"), text.alias("t")), "t")
    return found.select("id", "violation", outside(F.col("t")).alias("is_outside"))


def finance_violation(text: Column, markers: tuple[str, ...]) -> Column:
    """Why a text cannot be normalized: control characters that it has, or a marker of the corpus in what would come out; null if neither."""
    found = controls(text)
    collides = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(plain_layout(text), m))
    return F.when(F.size(found) > 0, F.concat(F.lit("Unsupported control character(s): "), F.array_join(found, ", "))).when(collides, "collides with a reserved corpus marker")


@query(
    "normalize_violations",
    """select doc_id, case when doc_id % 17 = 3 then 'Unsupported control character(s): U+0007, U+007F' when doc_id % 19 = 4 then 'collides with a reserved corpus marker' end as violation from documents""",
)
def normalize_violations(spark, sf):
    i = F.col("doc_id")
    text = F.concat("text", F.when(i % 17 == 3, "\x7f\x07\x07").otherwise(""), F.when(i % 19 == 4, " <|statement|>").otherwise(""))
    return table(spark, sf, "documents").select(i, finance_violation(text, ("<|statement|>", "<|end_statement|>")).alias("violation"))


@query(
    "load_documents",
    f"""with {MEETINGS} select meeting_id, genre, split, doc_id, length(trim(body)) as n_chars, 'ok' as state from split_docs""",
)
def load_documents(spark, sf):
    docs = documents(spark, sf)
    texts = parsed(serialized(docs).select("serialized"), "serialized").select(F.col("document_id").cast("long").alias("doc_id"), F.col("genre").alias("g"), F.length("body").cast("long").alias("n"))
    stated = with_split(docs).select("doc_id", "meeting_id", "genre", "split", F.length(F.trim("body")).cast("long").alias("n_chars"))
    joined = stated.join(texts, "doc_id", "full_outer")
    state = F.when(F.col("genre").isNull(), "not_in_split").when(F.col("g").isNull(), "not_found").when(F.col("g") != F.col("genre"), "genre").when(F.col("n") != F.col("n_chars"), "length").otherwise("ok")
    return joined.select("meeting_id", "genre", "split", "doc_id", "n_chars", state.alias("state"))


def characters(docs: DataFrame) -> DataFrame:
    """(split, ch, n): characters of each split, counted inside texts before they move."""
    return docs.select("split", F.explode(F.split("body", "")).alias("ch")).where("ch <> ''").groupBy("split", "ch").agg(F.count("*").alias("n"))


@query(
    "char_coverage",
    f"""with {MEETINGS}, c as (select split, ch, count(*) as n from (select split, unnest(string_split(body || case when split <> 'T' and doc_id % 5 = 4 then '✓' else '' end, '')) as ch from split_docs) where ch <> '' group by all)
    select split, 'U+' || lpad(upper(to_hex(unicode(ch))), 4, '0') as code, n from c where split in ('N', 'F') and ch not in (select ch from c where split = 'T')""",
)
def char_coverage(spark, sf):
    docs = with_split(documents(spark, sf))
    docs = docs.withColumn("body", F.when((F.col("split") != "T") & (F.col("doc_id") % 5 == 4), F.concat("body", F.lit("✓"))).otherwise(F.col("body")))
    return uncovered(characters(docs), "T", ("N", "F"))


def uncovered(counted: DataFrame, learnt: str, scored: tuple[str, ...]) -> DataFrame:
    """Characters of scored splits that the learnt split lacks, as U+ codes with counts."""
    new = counted.where(F.col("split").isin(*scored)).join(counted.where(F.col("split") == learnt).select("ch"), "ch", "left_anti")
    return new.select("split", F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("ch")), 4, "0")).alias("code"), "n")


@query("char_inventory", "select ch, count(*) as n from (select unnest(string_split(text, '')) as ch from documents) where ch <> '' group by ch")
def char_inventory(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("all").alias("split"), F.col("text").alias("body"))
    return characters(docs).select("ch", "n")


@query("collapse_truncate", "select doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) as evidence from documents")
def collapse_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring(F.trim(F.regexp_replace("text", "\\s+", " ")), 1, 200).alias("evidence"))
