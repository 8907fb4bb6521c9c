"""Quality rules whose cutoffs carry a guarantee on false rejections.

Five text measures are computed inside each row.  On labelled rows, and for
every stratum, each measure walks a fixed grid of cutoffs from lenient to
strict.  A cutoff passes when the exact binomial tail P(X <= k), for k good
rows rejected of n at the largest allowed rate, is at most the level; the walk
stops at the first cutoff that fails (fixed-sequence testing), so the level is
only divided by the number of strata times measures (Bonferroni).  The rate
``alpha`` is shared out evenly over the measures, so with probability
1 - ``delta`` no stratum loses more than ``alpha`` of its good rows.

Everything is DataFrame expressions: no Python runs on the executors.  The
measures need no shuffle.  Only labelled rows move for the calibration, as
counts; the cutoffs, one row per stratum, are a small written table.

Nulls and edges: a null text has no words and fails the base rules; a null
stratum is the stratum ''; null labels are no labels; several labels of one id
count once, as the smallest.  A stratum without enough labels gets no cutoff
and rejects nothing beyond the base rules.  Repeated rows are kept, each with
its own verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._fence import fenced
from ._scratch import Scratch

#: ASCII white space, between words.
WHITE = "\\x20\\x09-\\x0D"
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Measures and their grids of cutoffs, lenient first; a row above the cutoff is rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.8, 0.5, 0.3, 0.2, 0.1, 0.05),
    "exclamations_per_word": (0.8, 0.5, 0.3, 0.2, 0.1, 0.05),
    "upper_share": (0.7, 0.5, 0.35, 0.25, 0.2),
    "dup_line_share": (0.6, 0.4, 0.3, 0.2, 0.1),
    "repeat_word_share": (0.45, 0.35, 0.25, 0.15),
}
#: Strata up to which the cutoffs are broadcast.
MAX_STRATA = 1000


def without(text: Column, chars: str) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), chars, text)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words`` and the rules' measures."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_t", t)
    df = df.withColumn("_trim", F.btrim("_t", F.lit(WHITE_CHARS)))
    empty = F.array().cast("array<string>")
    df = df.withColumn("_w", F.when(F.col("_trim") == "", empty).otherwise(F.split("_trim", f"[{WHITE}]+"))).drop("_trim")
    df = df.withColumn("_n_words", F.size("_w").cast("long"))
    gram = F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], length(_w[i]), length(_w[i + 1])))")
    df = df.withColumn("_g", F.when(F.col("_n_words") >= 3, gram).otherwise(F.array().cast("array<bigint>"))).drop("_w")
    # windows found twice: neighbours once sorted by hash, then back in text order
    df = df.withColumn("_s", F.expr("case when size(array_distinct(_g)) < size(_g) then sort_array(transform(_g, (h, i) -> struct(h, i))) end")).drop("_g")
    df = df.withColumn(
        "_p",
        F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 and _s[k - 1].h = x.h) or (k < size(_s) - 1 and _s[k + 1].h = x.h)), x -> x.i))"),
    ).drop("_s")
    covered = F.expr("aggregate(_p, struct(0L as n, -9 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)")
    df = df.withColumn("_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    df = df.withColumn("_lines", F.expr(f"filter(split(_t, '\\n'), l -> btrim(l, ' \\t\\n{chr(11)}\\f\\r') != '')"))
    df = df.withColumn("_n_lines", F.size("_lines").cast("long")).withColumn("_n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("_word_chars", F.length(without(F.col("_t"), WHITE_CHARS)).cast("long"))
    df = df.withColumn("_n_symbols", (F.octet_length("_t") - F.octet_length(without(F.col("_t"), SYMBOLS))).cast("long"))
    df = df.withColumn("_n_excl", F.octet_length("_t") - F.octet_length(without(F.col("_t"), "!")))
    df = df.withColumn("_n_upper", F.length("_t") - F.length(F.regexp_replace("_t", "[A-Z]+", ""))).drop("_t")
    words, chars = F.greatest("_n_words", F.lit(1)), F.greatest("_word_chars", F.lit(1))
    return df.withColumns(
        {
            "_m_symbols_per_word": F.col("_n_symbols") / words,
            "_m_exclamations_per_word": F.col("_n_excl") / words,
            "_m_upper_share": F.col("_n_upper") / chars,
            "_m_dup_line_share": F.col("_n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
            "_m_repeat_word_share": F.col("_n_repeat_words") / words,
        }
    ).drop("_n_excl", "_n_upper", "_n_lines")


def base_failed() -> Column:
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def binomial_tail(k: str, n: str, rate: float) -> Column:
    """P(X <= k) for X of n draws at ``rate``, summed in logarithms; 1 where k/n is no less than the rate."""
    return F.expr(
        f"""case when {k} >= {rate}D * {n} then 1D else
        exp(aggregate(sequence(0, cast({k} as int)),
            struct({n} * ln(1D - {rate}D) as term, cast(null as double) as total),
            (a, i) -> named_struct(
                'term', case when i = 0 then a.term else a.term + ln(({n} - i + 1D) / i) + ln({rate}D / (1D - {rate}D)) end,
                'total', case when i = 0 then a.term else
                    greatest(a.total, a.term + ln(({n} - i + 1D) / i) + ln({rate}D / (1D - {rate}D)))
                    + ln(1D + exp(-abs(a.total - (a.term + ln(({n} - i + 1D) / i) + ln({rate}D / (1D - {rate}D)))))) end),
            a -> a.total)) end"""
    )


def cutoffs(labelled: DataFrame, alpha: float, delta: float, scratch: Scratch) -> DataFrame:
    """(_stratum, rule, cutoff) that passed, from good rows that the base rules keep; their counts are written, so the rows are read once."""
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k).alias("step"), F.lit(c).alias("cutoff"), (F.col(f"_m_{r}") > c).alias("hit")) for r, cs in RULES.items() for k, c in enumerate(cs)])
    counts = labelled.select("_stratum", F.explode(grid).alias("g")).groupBy("_stratum", "g.rule", "g.step", "g.cutoff").agg(F.count("*").alias("n"), F.sum(F.col("g.hit").cast("long")).alias("k"))
    counts = scratch.save(counts)
    strata = counts.select("_stratum").distinct().count()
    tested = counts.withColumn("tail", binomial_tail("k", "n", alpha / len(RULES)))
    tested = tested.withColumn("ok", F.col("tail") <= delta / (len(RULES) * max(strata, 1)))
    first_bad = F.min(F.when(~F.col("ok"), F.col("step")))
    walked = tested.groupBy("_stratum", "rule").agg(first_bad.alias("bad"), F.collect_list(F.struct("step", "cutoff")).alias("all"))
    best = F.expr("array_max(filter(all, x -> bad is null or x.step < bad)).cutoff")
    return walked.select("_stratum", "rule", best.alias("cutoff")).where("cutoff is not null")


def judge(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", alpha: float = 0.05, delta: float = 0.05, label_rows: int = 2_000_000) -> DataFrame:
    """Per row: ``_row`` (the row as it came), the measures, ``_base_failed`` and ``_kept``.

    ``labels`` joins by broadcast only where its counted rows are at most
    ``label_rows`` (one narrow column is sent), and the cutoffs only where the
    strata are at most ``MAX_STRATA``; beyond that both are shuffled joins.
    """
    known = labels.select(F.col(id).alias("_label_id"), F.col(label).alias("_label")).where("_label_id is not null and _label is not null").groupBy("_label_id").agg(F.min("_label").alias("_label")).where("_label = 1")
    known = F.broadcast(known) if labels.count() <= label_rows else known
    base = df.select(F.struct("*").alias("_row"), F.col(id).alias("_id"), F.col(text).alias("_text"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"))
    good = base.join(known, base["_id"] == known["_label_id"], "left_semi").select("_stratum", "_text")
    good = measures(good, "_text").withColumn("_good", fenced(~base_failed())).where("_good")
    scratch = Scratch(df.sparkSession, "cutoffs")
    wide = cutoffs(good, alpha, delta, scratch).groupBy(F.col("_stratum").alias("_of")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in RULES])
    wide = scratch.save(wide)
    scratch.drop(f"{scratch.root}/t1")  # the counts that the cutoffs came from
    wide = F.broadcast(wide) if wide.count() <= MAX_STRATA else wide
    out = measures(base, "_text").join(wide, F.col("_stratum") == F.col("_of"), "left").withColumn("_base_failed", base_failed())
    rejected = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_m_{r}") > F.col(f"_c_{r}"), F.lit(False)) for r in RULES])
    return out.withColumn("_kept", fenced(~F.col("_base_failed") & ~rejected))
