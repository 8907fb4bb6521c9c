"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import ready

from . import audit, bpe, decontam, html_extract, importance, langid, licenses, mixing, quality_rules, search, simhash, suffix_dedup, toxicity

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id: str, n: int, r: int):
    """Whether crc32 of an id as text leaves ``r`` over ``n``; never for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % n == r, F.lit(False))


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~remainder("_id", 3, 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", remainder("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(F.col("_id").alias("doc_id"), *(F.col(f"_{c}").alias(c) for c in names))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = langid.learn(docs, ~remainder("_id", 4, 2))
    found = langid.predict(docs, parser)
    return found.select("doc_id", remainder("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), *tokenizer()))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"), words=51)
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
        F.col("_shares").alias("shares_passage"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_importance_resampling, op2_decontamination, op3_simhash, op4_toxicity, op5_quality_rules,
        op6_html_extraction, op7_language_id, op8_license_scan, op9_byte_bpe, op10_suffix_dedup,
        op11_lexical_search, op12_source_mixing, op13_filter_audit,
    )
    return {f.__name__: f for f in found}


def _quality_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    rules = quality_rules.RULES
    grid = ", ".join(f"('{r}', {k}, {c}::double)" for r, cs in rules.items() for k, c in enumerate(cs))
    share = alpha / len(rules)
    value = "case g.rule " + " ".join(f"when '{r}' then m_{r}" for r in rules) + " end"
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(lang, '') as stratum from documents),
w as (select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
tri as (select rid, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
gram as (select rid, i, [ws[i], ws[i + 1], ws[i + 2]] as g from tri),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from gram) where c > 1),
rep as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid),
lines as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
m as (select d.rid, doc_id, stratum, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) as n_excl, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper
  from d join w using (rid) join lines using (rid) left join rep using (rid)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  n_symbols / greatest(n_words, 1) as m_symbols_per_word, n_excl / greatest(n_words, 1) as m_exclamations_per_word, n_upper / greatest(word_chars, 1) as m_upper_share,
  n_dup_lines / greatest(n_lines, 1) as m_dup_line_share, n_repeat_words / greatest(n_words, 1) as m_repeat_word_share from m),
good as (select doc_id from labels where doc_id is not null and quality is not null group by doc_id having min(quality) = 1),
grid(rule, step, cutoff) as (values {grid}),
c as (select stratum, g.rule, g.step, g.cutoff, count(*) as n, sum(({value} > g.cutoff)::int) as k
  from v cross join grid g where not base_failed and doc_id in (select doc_id from good) group by all),
tail as (select *, case when k >= {share} * n then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))
  from (select unnest(range(0, k::bigint + 1)) as i)) end as p from c),
ok as (select *, p <= {delta} / ({len(rules)} * (select count(distinct stratum) from c)) as ok from tail),
bad as (select stratum, rule, min(step) filter (where not ok) as bad from ok group by all),
cut as (select o.stratum, o.rule, min(o.cutoff) as cutoff from ok o join bad b using (stratum, rule) where b.bad is null or o.step < b.bad group by all),
rejected as (select distinct v.rid from v join cut g on v.stratum = g.stratum where {value} > g.cutoff)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and rid not in (select rid from rejected) as kept from v"""


def _license_sql() -> str:
    made = sorted((name, licenses.bigrams(body)) for name, body in licenses.TEMPLATES)
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{x}'" for x in b)) for n, b in made)
    return rf"""
with t(name, b) as (values {rows}),
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as x from documents),
u as (select distinct rid, doc_id, unnest(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\n[ \t\r]*\n'), [x])) as unit from d),
w as (select row_number() over () as uid, doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as ws from u),
a as (select uid, doc_id, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as a from w where len(ws) >= 2),
s as (select uid, doc_id, name, 2.0::double * len(list_intersect(a, b)) / (len(a) + len(b)) as dice from a cross join t where len(a) between 1 and 400),
best as (select doc_id, arg_max(name, dice) as license, max(dice) as dice from (select * from s where dice >= {licenses.THRESHOLD} order by name) group by uid, doc_id)
select doc_id, license, max(dice) as dice, count(*)::bigint as n_units from best group by doc_id, license"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _search_sql() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{term}')"
    return f"""
with d as (select row_number() over () as rid, doc_id, {split} as ts from documents),
g as (select count(*) filter (where len(ts) > 0) as n_docs, sum(len(ts))::bigint as n_terms from d),
i as (select row_number() over () as q, item_id, {split} as ts from benchmark),
asked as (select q, item_id, term, count(*) as times from (select q, item_id, unnest(ts) as term from i) group by all),
held as (select rid, term, count(*) as tf from (select rid, unnest(ts) as term from d) where term in (select term from asked) group by all),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from held, g group by term, n_docs),
part as (select rid, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ts) * n_docs) // n_terms))) as part from held join d using (rid) join w using (term), g),
scores as (select q, item_id, rid, sum(times * part)::bigint as score from asked join part using (term) group by all),
placed as (select item_id, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank, doc_id, score from scores join d using (rid) where score > 0)
select item_id, rank, doc_id, score from placed where rank <= {search.K}"""


def _mixing_sql() -> str:
    share, cap, n = mixing.SHARE, mixing.CAP, len(mixing.WEIGHTS)
    weight = "case (row_number() over (order by source nulls last) - 1) % {} {} end".format(n, " ".join(f"when {k} then {w}" for k, w in enumerate(mixing.WEIGHTS)))
    return rf"""
with d as (select row_number() over () as rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, {weight}::double as weight from d group by source),
-- sources in the order in which they reach the cap; what the others share once the first k have stopped
capped as (select *, row_number() over (order by {cap} * source_size / weight, source nulls last) as k from s),
left_over as (select *, {share} * sum(source_size) over () - coalesce(sum({cap} * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as words, sum(weight) over (order by k rows between current row and unbounded following) as weights from capped),
fair as (select words / weights as unit from left_over where not {cap} * source_size <= words / weights * weight order by k limit 1),
t as (select source, source_size, case when (select unit from fair) is null or {cap} * source_size <= (select unit from fair) * weight then {cap} * source_size::double else (select unit from fair) * weight end as target,
  ('0x' || substr(md5('{mixing.SEED}' || coalesce('=' || source, '-')), 1, {mixing.DIGITS}))::bigint / {16**mixing.DIGITS}.0::double as off from s),
placed as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate, off,
  row_number() over (partition by d.source order by size, md5(coalesce(doc_id::varchar, '')), doc_id nulls first) as i from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate * i + off) - floor(rate * (i - 1) + off)))::bigint as taken from placed"""


def _audit_sql() -> str:
    edges = "bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic"
    return rf"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^ 	-
]+') as ws, min(doc_id) over (partition by t) as low from d),
f as (select part, doc_id, len(ws) < {audit.MIN_WORDS} as fa, 100 * len(list_distinct(ws)) < {audit.DISTINCT} * len(ws) as fb,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.CAPITALS} * length(t) as fc, regexp_matches(t, '[#$%&*|]') as fd, coalesce(doc_id > low, false) as fe from w),
l as (select doc_id, {edges} from labels where doc_id is not null group by doc_id),
m as (select part, [fa, fb, fc, fd, fe] as fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from f left join l using (doc_id) group by all),
orders(o) as (select '' union all select o || x from orders, (select unnest(string_split('{audit.FILTERS}', '')) as x) where not contains(o, x)),
steps as (select o as filter_order, step, strpos('{audit.FILTERS}', substr(o, step, 1)) as this, list_transform(range(1, step), lambda k: strpos('{audit.FILTERS}', substr(o, k, 1))) as before
  from orders, (select unnest(range(1, {len(audit.FILTERS) + 1}))::int as step) where length(o) = {len(audit.FILTERS)}),
met as (select part, filter_order, step, this, fails[this] as here, len(list_filter(before, lambda k: fails[k])) > 0 as gone, len(list_filter(fails, lambda x: x)) = 1 as sole, good, toxic, n from m, steps),
e as (select part, filter_order, step, this, sum(n) filter (where not here and not gone) as kept, sum(n) filter (where here and not gone) as removed, sum(n) filter (where here and gone) as redundant,
  sum(n) filter (where here and sole) as unique_fails, sum(n) filter (where here and not gone and good) as good_lost, sum(n) filter (where here and not gone and toxic) as toxic_lost from met group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, sum(coalesce(removed, 0)) over (partition by part, this)::bigint as shapley from e"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": _quality_sql(), "op8_license_scan": _license_sql(), "op11_lexical_search": _search_sql(),
        "op12_source_mixing": _mixing_sql(), "op13_filter_audit": _audit_sql(),
    }
