"""Leakage-free splits by meeting date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.sources.tables import DOCS, documents, table

# Both boundaries, the exclusion band and the delay of minutes.
FIRST, SECOND, BAND, DELAY = "2019-12-31", "2021-12-31", 30, 21
NAMES = ("T", "N", "F", "excluded")


def meetings(docs: DataFrame) -> DataFrame:
    """One row a meeting: flags and counts of its genres, and when its texts became available."""
    by = docs.groupBy("meeting_id", "meeting_date").agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("genre") == "statement").alias("n_statement"),
        F.count_if(F.col("genre") == "minutes").alias("n_minutes"),
        F.sum(F.length("body")).alias("body_chars"),
    )
    return by.withColumn("available", available(F.col("n_minutes") > 0, F.col("meeting_date")))


def available(has_minutes, meeting_date, release_date=None):
    """Minutes come out on their release date, or ``DELAY`` days after the meeting."""
    late = F.date_add(meeting_date, DELAY)
    late = late if release_date is None else F.coalesce(release_date, late)
    return F.when(has_minutes, late).otherwise(meeting_date)


def assign(date):
    """Split of an availability date; inside the band around either boundary it is excluded."""
    def near(b):
        return F.abs(F.datediff(date, F.lit(b).cast("date"))) <= BAND
    return F.when(near(FIRST) | near(SECOND), "excluded").when(date <= F.lit(FIRST).cast("date"), "T").when(date <= F.lit(SECOND).cast("date"), "N").otherwise("F")


def boundary(date):
    """The boundary that excludes a date, else null."""
    def near(b):
        return F.abs(F.datediff(date, F.lit(b).cast("date"))) <= BAND
    return F.when(near(FIRST), F.lit(FIRST).cast("date")).when(near(SECOND), F.lit(SECOND).cast("date"))


def assigned(docs: DataFrame) -> DataFrame:
    return meetings(docs).withColumn("split", assign(F.col("available"))).withColumn("boundary", boundary(F.col("available")))


def with_split(docs: DataFrame) -> DataFrame:
    """Documents with the split of their meeting, by a window over the meeting's own rows."""
    has = F.max((F.col("genre") == "minutes").cast("int")).over(Window.partitionBy("meeting_id")) == 1
    return docs.withColumn("split", assign(available(has, F.col("meeting_date"))))


MEETINGS = f"""{DOCS}, meetings as (select meeting_id, meeting_date, count(*) as n_documents, count(*) filter (genre = 'statement') as n_statement,
  count(*) filter (genre = 'minutes') as n_minutes, sum(length(body))::bigint as body_chars,
  case when count(*) filter (genre = 'minutes') > 0 then meeting_date + {DELAY} else meeting_date end as available from docs group by meeting_id, meeting_date),
assigned as (select *, case when abs(available - date '{FIRST}') <= {BAND} then date '{FIRST}' when abs(available - date '{SECOND}') <= {BAND} then date '{SECOND}' end as boundary,
  case when abs(available - date '{FIRST}') <= {BAND} or abs(available - date '{SECOND}') <= {BAND} then 'excluded'
  when available <= date '{FIRST}' then 'T' when available <= date '{SECOND}' then 'N' else 'F' end as split from meetings),
split_docs as (select d.*, a.split from docs d join assigned a using (meeting_id))"""


@query("availability_date", f"with {MEETINGS} select meeting_id, available from assigned")
def availability_date(spark, sf):
    return meetings(documents(spark, sf)).select("meeting_id", "available")


@query(
    "release_dates",
    f"""with {DOCS}, m as (select meeting_id, meeting_date, count(*) filter (genre = 'minutes') > 0 as has, min(case when genre = 'minutes' and doc_id % 3 <> 0 then meeting_date + (10 + doc_id % 20)::int end) as released from docs group by all)
    select meeting_id, case when not has then meeting_date else coalesce(released, meeting_date + {DELAY}) end as available from m""",
)
def release_dates(spark, sf):
    """When each meeting's documents were out, with release dates for two thirds of the minutes."""
    docs = documents(spark, sf)
    released = F.when((F.col("genre") == "minutes") & (F.col("doc_id") % 3 != 0), F.date_add("meeting_date", (F.lit(10) + F.col("doc_id") % 20).cast("int")))
    by = docs.groupBy("meeting_id", "meeting_date").agg(F.bool_or(F.col("genre") == "minutes").alias("has"), F.min(released).alias("released"))
    return by.select("meeting_id", available(F.col("has"), F.col("meeting_date"), F.col("released")).alias("available"))


@query("assign_split", f"with {MEETINGS} select meeting_id, split, boundary from assigned")
def assign_split(spark, sf):
    return assigned(documents(spark, sf)).select("meeting_id", "split", "boundary")


@query(
    "meeting_groups",
    f"""with {MEETINGS} select meeting_id, string_agg(genre || ':' || doc_id, ',' order by genre, doc_id) as members, count(*) filter (genre = 'minutes') > 1 or
    count(*) filter (genre = 'statement') > 1 as is_duplicate from docs group by meeting_id""",
)
def meeting_groups(spark, sf):
    docs = documents(spark, sf)
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("genre", "doc_id"))), lambda x: F.concat_ws(":", x["genre"], x["doc_id"])), ",")
    twice = (F.count_if(F.col("genre") == "minutes") > 1) | (F.count_if(F.col("genre") == "statement") > 1)
    return docs.groupBy("meeting_id").agg(members.alias("members"), twice.alias("is_duplicate"))


def counts(by_meeting: DataFrame) -> DataFrame:
    """Counts of every split, those without a meeting included."""
    spark = by_meeting.sparkSession
    names = spark.createDataFrame([(n,) for n in NAMES], "split string")
    by = by_meeting.groupBy("split").agg(
        F.count("*").alias("meetings"),
        F.sum("n_documents").alias("documents"),
        F.sum("n_statement").alias("statements"),
        F.sum("n_minutes").alias("minutes"),
        F.count_if((F.col("n_statement") > 0) & (F.col("n_minutes") > 0)).alias("matched_pairs"),
        F.sum("body_chars").alias("body_chars"),
    )
    return names.join(by, "split", "left").na.fill(0)


COUNTS = f"""{MEETINGS}, counts as (select split, count(m.meeting_id) as meetings, coalesce(sum(n_documents), 0)::bigint as documents, coalesce(sum(n_statement), 0)::bigint as statements,
  coalesce(sum(n_minutes), 0)::bigint as minutes, count(*) filter (n_statement > 0 and n_minutes > 0) as matched_pairs, coalesce(sum(body_chars), 0)::bigint as body_chars
  from (values ('T'), ('N'), ('F'), ('excluded')) s(split) left join assigned m using (split) group by split)"""


@query("split_counts", f"with {COUNTS} select * from counts")
def split_counts(spark, sf):
    return counts(assigned(documents(spark, sf)))


@query(
    "feasibility",
    f"""with {COUNTS}, v as (select max(documents) filter (split = 'F') as f, max(matched_pairs) filter (split = 'F') as p, max(documents) filter (split = 'N') as n from counts)
    select f as f_documents, p as f_pairs, n as n_documents, concat_ws('; ', case when f < 40 then 'F documents ' || f || ' < 40' end, case when p < 15 then 'F pairs ' || p || ' < 15' end,
    case when n < 16 then 'N documents ' || n || ' < 16' end) as failures from v""",
)
def feasibility(spark, sf):
    return feasible(counts(assigned(documents(spark, sf))))


def feasible(by_split: DataFrame, f_documents: int = 40, f_pairs: int = 15, n_documents: int = 16) -> DataFrame:
    """The three sizes that a study needs, and all that fall short, in one text."""
    def of(split, c):
        return F.max(F.when(F.col("split") == split, F.col(c)))
    v = by_split.agg(of("F", "documents").alias("f_documents"), of("F", "matched_pairs").alias("f_pairs"), of("N", "documents").alias("n_documents"))
    rules = (("F documents", "f_documents", f_documents), ("F pairs", "f_pairs", f_pairs), ("N documents", "n_documents", n_documents))
    short = [F.when(F.col(c) < least, F.concat(F.lit(f"{name} "), F.col(c), F.lit(f" < {least}"))) for name, c, least in rules]
    return v.withColumn("failures", F.concat_ws("; ", *short))


@query(
    "year_genre_pivot",
    f"""with {MEETINGS} select year(meeting_date)::int as year, split, count(*) filter (genre = 'minutes') as minutes, count(*) filter (genre = 'statement') as statement from split_docs group by 1, 2""",
)
def year_genre_pivot(spark, sf):
    docs = with_split(documents(spark, sf)).select(F.year("meeting_date").alias("year"), "split", "genre")
    return docs.groupBy("year", "split").pivot("genre", ["minutes", "statement"]).count().na.fill(0)


@query(
    "length_stats",
    f"""with {MEETINGS} select split, genre, min(length(body))::int as shortest, quantile_cont(length(body), 0.5)::double as median, max(length(body))::int as longest from split_docs group by all""",
)
def length_stats(spark, sf):
    docs = with_split(documents(spark, sf)).select("split", "genre", F.length("body").alias("n"))
    return docs.groupBy("split", "genre").agg(F.min("n").alias("shortest"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("longest"))


@query("counts_by_year", f"with {DOCS} select year(meeting_date)::int as year, genre, count(*) as documents from docs group by all")
def counts_by_year(spark, sf):
    return documents(spark, sf).groupBy(F.year("meeting_date").alias("year"), "genre").agg(F.count("*").alias("documents"))


@query(
    "fake_split",
    f"""with {DOCS}, m as (select meeting_id, row_number() over (order by meeting_date desc, meeting_id desc) as r, count(*) over () as n from (select distinct meeting_id, meeting_date from docs))
    select meeting_id, case when r <= round_even(0.2 * n, 0) then 'F' when r <= round_even(0.2 * n, 0) + round_even(0.1 * n, 0) then 'N' else 'T' end as split from m""",
)
def fake_split(spark, sf):
    return by_order(documents(spark, sf).select("meeting_id", "meeting_date").distinct())


def by_order(meeting_rows: DataFrame, f_share: float = 0.2, n_share: float = 0.1) -> DataFrame:
    """The last share of meetings is F, the share before it N.

    The two cut dates come from exact percentiles of meeting order, counted per
    date first, so no single task sees all meetings: dates are few.
    """
    per_date = meeting_rows.groupBy("meeting_date").agg(F.count("*").alias("c"))
    later = F.sum("c").over(Window.orderBy(F.desc("meeting_date")).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("c").over(Window.partitionBy())
    placed = per_date.select(F.col("meeting_date"), F.coalesce(later, F.lit(0)).alias("later"), total.alias("n"))
    in_date = F.row_number().over(Window.partitionBy("meeting_date").orderBy(F.desc("meeting_id")))
    ranked = meeting_rows.withColumn("i", in_date).join(placed, "meeting_date").withColumn("r", F.col("later") + F.col("i"))
    f, n = F.bround(F.lit(f_share) * F.col("n")), F.bround(F.lit(n_share) * F.col("n"))
    return ranked.select("meeting_id", F.when(F.col("r") <= f, "F").when(F.col("r") <= f + n, "N").otherwise("T").alias("split"))


@query(
    "stratified_split",
    """with r as (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id::varchar), doc_id) as r, count(*) over (partition by quality) as n from labels)
    select doc_id, quality, case when r <= floor(n * 0.2) then 'test' else 'train' end as part from r""",
)
def stratified_split(spark, sf):
    labels = table(spark, sf, "labels")
    w = Window.partitionBy("quality")
    r = F.row_number().over(w.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    n = F.count("*").over(w)
    return labels.select("doc_id", "quality", F.when(r <= F.floor(n * 0.2), "test").otherwise("train").alias("part"))


@query("holdout_split", f"with {DOCS} select doc_id, case when meeting_date >= date '2025-01-01' then 'validation' else 'train' end as part from docs where meeting_date between date '2015-01-01' and date '2026-04-29'")
def holdout_split(spark, sf):
    docs = documents(spark, sf).where(F.col("meeting_date").between("2015-01-01", "2026-04-29"))
    return docs.select("doc_id", F.when(F.col("meeting_date") >= F.lit("2025-01-01").cast("date"), "validation").otherwise("train").alias("part"))


@query(
    "split_leakage",
    f"with {MEETINGS} select split, count(*) as documents, min(doc_id) as first_doc from split_docs where split <> 'T' group by split",
)
def split_leakage(spark, sf):
    return leakage(with_split(documents(spark, sf)), "T")


def leakage(docs: DataFrame, allowed: str) -> DataFrame:
    """Documents of splits other than the allowed one, counted; no row means none leaked."""
    return docs.where(F.col("split") != allowed).groupBy("split").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def require(docs: DataFrame, allowed: str) -> DataFrame:
    """The documents; an action fails on the first one of another split."""
    ok = F.when(F.col("split") == allowed, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"only split {allowed} may be used, found "), F.coalesce("split", F.lit("none")))))
    return docs.where(ok)


def learnt(docs: DataFrame) -> DataFrame:
    """What a fit may see: documents that name a split must be of the learnt one; an action fails on any other."""
    return require(docs, "T") if "split" in docs.columns else docs


@query("same_date_groups", f"with {DOCS} select meeting_date, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) as doc_ids from docs group by meeting_date having count(*) > 1")
def same_date_groups(spark, sf):
    docs = documents(spark, sf)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return docs.groupBy("meeting_date").agg(F.count("*").alias("n"), ids.alias("doc_ids")).where("n > 1")


@query(
    "disambiguate_ids",
    f"""with {DOCS}, r as (select doc_id, meeting_date, count(*) over (partition by meeting_date, genre) as n, rank() over (partition by meeting_date, genre order by doc_id) as r, genre from docs)
    select doc_id, genre || '-' || strftime(meeting_date, '%Y%m%d') || case when n > 1 then '-' || r else '' end as document_id from r""",
)
def disambiguate_ids(spark, sf):
    w = Window.partitionBy("meeting_date", "genre")
    r = F.rank().over(w.orderBy("doc_id"))
    name = F.concat(F.col("genre"), F.lit("-"), F.date_format("meeting_date", "yyyyMMdd"))
    return documents(spark, sf).select("doc_id", F.when(F.count("*").over(w) > 1, F.concat(name, F.lit("-"), r)).otherwise(name).alias("document_id"))
