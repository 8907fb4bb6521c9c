"""Release pages: official links with dates, meeting types, splits of two builders, validation and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.files import serialized
from quillspark.operators.pages import meeting_type
from quillspark.plans.registry import query
from quillspark.sources.tables import DOCS, documents, table

# Parameters of the queries: a site, its hosts, the window of dates and when the held-out part begins.
BASE, HOST, HOSTS = "https://www.example.org/newsevents/index.htm", "www.example.org", ("example.org", "www.example.org", "news.example.org")
STATEMENT, MINUTES = r"(?i)/monetary([0-9]{8})[a-z]\.htm$", r"(?i)^/policy/minutes([0-9]{8})\.htm$"
START, END, HELD_OUT = "2015-02-01", "2025-06-30", "2025-01-01"
SHORT, STAND_IN = 500, "ly the"
# What a page's own navigation leaves in a body.
PHRASES = (
    "skip to main content", "back to top", "for media inquiries", "media contact", "implementation note issued", "implementation note",
    "board of governors of the federal reserve system", "stay connected", "follow us", "last update:",
)


def joined_url(base: Column, href: Column) -> Column:
    """An address as seen from a page: absolute, of another host, of the root, or relative with dots resolved."""
    root = F.regexp_extract(base, "^(?i)(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^(?i)https?://[^/?#]*([^?#]*/)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    full = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
    rest = F.regexp_extract(full, "^[^?#]*(.*)$", 1)
    parts = F.aggregate(F.split(F.regexp_extract(full, "^([^?#]*)", 1), "/"), F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s))))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href)).when(href == "", base)
        .when(href.startswith("#") | href.startswith("?"), F.concat(page, href)).otherwise(F.concat(root, F.array_join(parts, "/"), rest))
    )


def official(url: Column, hosts: tuple[str, ...] = HOSTS, host: str = HOST) -> Column:
    """Https address on one of the hosts, moved to the main host, single slashes, no query or fragment; null for all others."""
    found = F.lower(F.regexp_extract(url, "^(?i)https://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, "^(?i)https://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    return F.when(found.isin(*hosts), F.concat(F.lit(f"https://{host}"), path))


def dated(url: Column, pattern: str = STATEMENT) -> Column:
    """Date in an address's path; null without one, or where it is no day of the calendar."""
    text = F.regexp_extract(F.regexp_extract(url, "^(?i)https://[^/?#]*([^?#]*)", 1), pattern, 1)
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyyMMdd")).cast("date")


def discovered(anchors: DataFrame, pattern: str, start: str, end: str) -> DataFrame:
    """(source, seq, url, date, label) of anchors (base, href, label, heading) that lead to an official page of the window; both ends count."""
    url = official(joined_url(F.col("base"), F.col("href")))
    rows = anchors.withColumn("url", url).where("url is not null").withColumn("date", dated(F.col("url"), pattern))
    rows = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return rows.select("source", "seq", "url", "date", F.coalesce(F.concat_ws(" | ", clean(F.col("heading")), clean(F.col("label"))), F.lit("")).alias("label"))


def _hrefs(n: str, ymd: str) -> list[tuple[str, str]]:
    """Addresses of every kind as SQL text, and where each leads as seen from ``BASE`` (null: nowhere)."""
    s = "/newsevents/pressreleases/monetary"
    return [
        (f"'{s}' || {ymd} || 'a.htm'", f"'https://{HOST}{s}' || {ymd} || 'a.htm'"), (f"'HTTPS://News.Example.org//newsevents//pressreleases/monetary' || {ymd} || 'b.htm?x=1#top'", f"'https://{HOST}{s}' || {ymd} || 'b.htm'"),
        (f"'../newsevents/./pressreleases/monetary' || {ymd} || 'C.HTM#x'", f"'https://{HOST}{s}' || {ymd} || 'C.HTM'"), (f"'http://{HOST}{s}' || {ymd} || 'a.htm'", "null"), (f"'https://example.com{s}' || {ymd} || 'a.htm'", "null"),
        (f"'//example.org{s}' || {ymd} || 'd.htm'", f"'https://{HOST}{s}' || {ymd} || 'd.htm'"), (f"'/policy/minutes' || {ymd} || '.htm'", f"'https://{HOST}/policy/minutes' || {ymd} || '.htm'"),
        ("'/newsevents/pressreleases/monetary20231399a.htm'", f"'https://{HOST}{s}20231399a.htm'"), (f"'pressreleases/monetary' || {ymd} || 'e.htm'", f"'https://{HOST}{s}' || {ymd} || 'e.htm'"), ("'mailto:x@example.org'", "null"), ("'#top'", f"'{BASE}'"),
    ]


def anchors(spark, sf) -> DataFrame:
    """(source, seq, base, href, label, heading): eleven links a page, one of each kind, with the page's own day."""
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("page_id") * 37 % 4000).cast("int"))
    kinds = _hrefs("page_id", "ymd")
    hrefs = F.expr("array(" + ", ".join(h for h, _ in kinds) + ")")
    rows = table(spark, sf, "pages").select("page_id", F.date_format(day, "yyyyMMdd").alias("ymd")).select("page_id", F.posexplode(hrefs).alias("seq", "href"))
    return rows.select(F.col("page_id").alias("source"), "seq", F.lit(BASE).alias("base"), "href", F.concat(F.lit(" Read \n it "), F.col("seq"), F.lit(" ")).alias("label"), F.when(F.col("page_id") % 3 == 0, F.lit("Panel  one")).alias("heading"))


def _found_sql(pattern: str, heading: bool) -> str:
    kinds = _hrefs("page_id", "ymd")
    urls = ", ".join(u for _, u in kinds)
    label = "case when page_id % 3 = 0 then 'Panel one | ' else '' end || 'Read it ' || seq" if heading else "'Read it ' || seq"
    return rf"""with p as (select page_id, strftime(date '2015-01-01' + (page_id * 37 % 4000)::int, '%Y%m%d') as ymd from pages),
    l as (select page_id, unnest([{urls}]) as url, unnest(range(0, {len(kinds)})) as seq from p),
    d as (select page_id, seq, url, try_strptime(nullif(regexp_extract(regexp_extract(url, '^https://[^/]*(.*)$', 1), '{pattern}', 1), ''), '%Y%m%d')::date as date from l where url is not null)
    select page_id as source, seq::int as seq, url, date, {label} as label from d where date between date '{START}' and date '{END}'"""


@query("press_links", _found_sql(STATEMENT, True))
def press_links(spark, sf):
    return discovered(anchors(spark, sf), STATEMENT, START, END)


@query("minutes_links", _found_sql(MINUTES, False))
def minutes_links(spark, sf):
    """As statement links, with the pattern of minutes; the label is the anchor's alone."""
    return discovered(anchors(spark, sf).withColumn("heading", F.lit(None).cast("string")), MINUTES, START, END)


@query(
    "official_url",
    f"""with p as (select page_id, strftime(date '2015-01-01' + (page_id * 37 % 4000)::int, '%Y%m%d') as ymd from pages), l as (select page_id, unnest([{", ".join(u for _, u in _hrefs("", "ymd"))}]) as url, unnest(range(0, 11))::int as seq from p)
    select page_id as source, seq, url, try_strptime(nullif(regexp_extract(url, 'monetary([0-9]{{8}})[a-zA-Z][.](?i:htm)$', 1), ''), '%Y%m%d')::date as date from l""",
)
def official_url(spark, sf):
    url = official(joined_url(F.col("base"), F.col("href")))
    return anchors(spark, sf).select("source", "seq", url.alias("url"), dated(url).alias("date"))


@query(
    "meeting_types",
    "select doc_id, case when doc_id % 11 in (1, 2, 3) or contains(lower(text), 'de la') then 'unscheduled' else 'scheduled' end as meeting_type from documents",
)
def meeting_types(spark, sf):
    labels = F.element_at(F.array(*map(F.lit, ("Unscheduled call", "An intermeeting action", "NOTATION VOTE")), *[F.lit("Statement")] * 8), ((F.col("doc_id") + 10) % 11 + 1).cast("int"))
    body = F.replace(F.lower("text"), F.lit("de la"), F.lit("notational vote"))
    return table(spark, sf, "documents").select("doc_id", meeting_type(labels, body).alias("meeting_type"))


def builder_split(date: Column, start: str = START, end: str = END, held_out: str | None = HELD_OUT) -> Column:
    """Statements are held out from a fixed day on, minutes (no day given) from a year before the end; null outside the window."""
    first = F.lit(held_out).cast("date") if held_out else F.add_months(F.lit(end).cast("date"), -12)
    return F.when(~date.between(F.lit(start).cast("date"), F.lit(end).cast("date")), None).when(date >= first, "validation").otherwise("train")


@query(
    "builder_splits",
    f"""with {DOCS} select doc_id, case when meeting_date not between date '{START}' and date '{END}' then null when genre = 'statement' then case when meeting_date >= date '{HELD_OUT}' then 'validation' else 'train' end
    when meeting_date >= date '{END}' - interval 1 year then 'validation' else 'train' end as split from docs""",
)
def builder_splits(spark, sf):
    split = F.when(F.col("genre") == "statement", builder_split(F.col("meeting_date"))).otherwise(builder_split(F.col("meeting_date"), held_out=None))
    return documents(spark, sf).select("doc_id", split.alias("split"))


def published(outcomes: DataFrame, blocking: bool) -> DataFrame:
    """Counts of documents, exclusions and failures, and what is published: nothing where failures block and there is one."""
    n = {o: F.count_if(F.col("outcome") == o) for o in ("document", "exclusion", "failure")}
    done = outcomes.agg(*[c.alias(f"n_{o}") for o, c in n.items()])
    blocked = (F.col("n_failure") > 0) & F.lit(blocking)
    return done.select("*", blocked.alias("is_blocked"), F.when(blocked, 0).otherwise(F.col("n_document")).alias("n_published"))


@query(
    "publication",
    f"""with {DOCS}, o as (select genre, case when genre = 'statement' then case when length(body) < {SHORT} then 'failure' else 'document' end when meeting_date < date '2016-01-01' then 'exclusion' when length(body) < {SHORT} then 'failure' else 'document' end as outcome from docs)
    select genre, count(*) filter (outcome = 'document') as n_document, count(*) filter (outcome = 'exclusion') as n_exclusion, count(*) filter (outcome = 'failure') as n_failure,
    genre = 'statement' and count(*) filter (outcome = 'failure') > 0 as is_blocked, case when genre = 'statement' and count(*) filter (outcome = 'failure') > 0 then 0 else count(*) filter (outcome = 'document') end as n_published from o group by genre""",
)
def publication(spark, sf):
    """Short statements are failures and block; minutes before a day are exclusions, and their failures do not block."""
    short = F.length("body") < SHORT
    docs = documents(spark, sf).select("genre", F.when((F.col("genre") == "minutes") & (F.col("meeting_date") < F.lit("2016-01-01").cast("date")), "exclusion").when(short, "failure").otherwise("document").alias("outcome"))
    parts = [published(docs.where(F.col("genre") == g), g == "statement").select(F.lit(g).alias("genre"), "*") for g in ("statement", "minutes")]
    return parts[0].union(parts[1])


def rule_violations(docs: DataFrame, markers: tuple[int, int] | None = None, phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """(rule, id) of every rule that a manifest breaks; all are collected, none stops the others.

    Columns: id, seq (its place), url, date, split, raw_sha256, sha256, n_bytes,
    n_chars, body, is_reviewed.  Rules on the table as a whole give a null id.
    """
    same = {c: F.count("*").over(Window.partitionBy(c)) > 1 for c in ("url", "id", "sha256")}
    hexes = "^[0-9a-f]{64}$"
    # order is checked between neighbours, inside years and from one year to the next, so no task sees all rows
    at = F.struct("date", "url")
    year = F.year("date")
    inside = F.coalesce(F.lag("seq").over(Window.partitionBy(year).orderBy(at, "seq")) > F.col("seq"), F.lit(False))
    rules = {
        "duplicate_url": same["url"], "duplicate_id": same["id"], "duplicate_hash": same["sha256"], "out_of_order": inside,
        "not_official": F.coalesce(official(F.col("url")) != F.col("url"), F.lit(True)), "wrong_split": F.coalesce(F.col("split") != builder_split(F.col("date")), F.lit(True)),
        "bad_hash": ~(F.col("raw_sha256").rlike(hexes) & F.col("sha256").rlike(hexes)), "wrong_size": (F.octet_length("body") != F.col("n_bytes")) | (F.length("body") != F.col("n_chars")),
        "wrong_checksum": F.sha2("body", 256) != F.col("sha256"), "too_short": (F.col("n_chars") < SHORT) & ~F.col("is_reviewed"),
        "leakage": F.array_contains(F.array(*[F.contains(F.lower("body"), F.lit(p)) for p in phrases]), True),
    }
    names = list(rules)
    marked = docs.select("id", *[c.alias(n) for n, c in rules.items()])
    each = marked.select(F.explode(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("rule"), "id")
    n = docs.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation"))
    bounds = docs.groupBy(year.alias("y")).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    steps = bounds.withColumn("before", F.max("high").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1))).agg(F.coalesce(F.max(F.col("before") > F.col("low")), F.lit(False)).alias("years"))  # one row a year
    whole = F.array_compact(F.array(F.when(F.col("n") == 0, F.lit("no_documents")), F.when(F.col("train") == 0, F.lit("no_train")), F.when(F.col("validation") == 0, F.lit("no_validation")), *([F.when((F.col("n") != markers[0]) | (F.col("n") != markers[1]), F.lit("marker_count"))] if markers else [])))
    table_rules = n.select(F.explode(whole).alias("rule"), F.lit(None).cast("long").alias("id"))
    return each.union(table_rules).union(steps.where("years").select(F.lit("out_of_order"), F.lit(None).cast("long")))


@query(
    "rule_violations",
    f"""with {DOCS}, m as (select doc_id as id, row_number() over (order by meeting_date, doc_id % 100 <> 7, doc_id) as seq, 'https://{HOST}/' || case when doc_id % 41 = 0 then 'same' else lpad(doc_id::varchar, 12, '0') end as url, meeting_date as date, body,
      case when meeting_date not between date '{START}' and date '{END}' then null when (meeting_date >= date '{HELD_OUT}') <> (doc_id % 97 = 0) then 'validation' else 'train' end as split,
      case when doc_id % 89 = 0 then 'zz' else sha256(body) end as raw_sha256, case when doc_id % 83 = 0 then sha256(body || 'x') else sha256(body) end as sha256, strlen(body) + (doc_id % 79 = 0)::int as n_bytes, length(body) as n_chars, doc_id % 2 = 0 as is_reviewed from docs),
    o as (select id, lag(seq) over (partition by year(date) order by date, url, seq) > seq as bad from m)
    select 'duplicate_url' as rule, id from (select id, count(*) over (partition by url) as n from m) where n > 1 union all select 'duplicate_hash', id from (select id, count(*) over (partition by sha256) as n from m) where n > 1
    union all select 'out_of_order', id from o where bad union all select 'wrong_split', id from m where coalesce(split <> case when date not between date '{START}' and date '{END}' then null when date >= date '{HELD_OUT}' then 'validation' else 'train' end, true)
    union all select 'bad_hash', id from m where raw_sha256 = 'zz' union all select 'wrong_size', id from m where strlen(body) <> n_bytes union all select 'wrong_checksum', id from m where sha256(body) <> sha256
    union all select 'too_short', id from m where n_chars < {SHORT} and not is_reviewed union all select 'leakage', id from m where {" or ".join(f"contains(lower(body), '{p}')" for p in (*PHRASES, STAND_IN))} union all select 'marker_count', null""",
)
def rule_violations_query(spark, sf):
    """A manifest with planted faults of most kinds; its marker count is one short."""
    d, i = documents(spark, sf), F.col("doc_id")
    day = F.col("meeting_date")
    # the place in order of day, from counts by day and the order inside a day
    by = d.groupBy("meeting_date").agg(F.count("*").alias("c"))
    before = by.select("meeting_date", F.coalesce(F.sum("c").over(Window.orderBy("meeting_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a day
    inner = F.row_number().over(Window.partitionBy("meeting_date").orderBy((i % 100 != 7), i))
    split = F.when(builder_split(day).isNull(), None).when((day >= F.lit(HELD_OUT).cast("date")) != (i % 97 == 0), "validation").otherwise("train")
    m = d.withColumn("_r", inner).join(before, "meeting_date").select(
        i.alias("id"), (F.col("base") + F.col("_r")).alias("seq"), F.concat(F.lit(f"https://{HOST}/"), F.when(i % 41 == 0, "same").otherwise(F.lpad(i.cast("string"), 12, "0"))).alias("url"), day.alias("date"), "body", split.alias("split"),
        F.when(i % 89 == 0, "zz").otherwise(F.sha2("body", 256)).alias("raw_sha256"), F.when(i % 83 == 0, F.sha2(F.concat("body", F.lit("x")), 256)).otherwise(F.sha2("body", 256)).alias("sha256"),
        (F.octet_length("body") + (i % 79 == 0).cast("int")).alias("n_bytes"), F.length("body").alias("n_chars"), (i % 2 == 0).alias("is_reviewed"),
    )
    n = d.count()
    return rule_violations(m, (n, n - 1), (*PHRASES, STAND_IN))


def corpus_rules(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """(rule, genre, id) of every way in which a stored corpus (doc_id, serialized) is not what its documents make.

    ``serialization``: a document's part is missing, there twice, new or
    different; ``start_markers`` and ``end_markers``: of a genre there are more
    or fewer than documents.
    """
    made = serialized(docs).select("doc_id", "genre", F.col("serialized").alias("_m"))
    found = stored.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("serialized").alias("_s"))
    both = made.join(found, "doc_id", "full_outer").where("_m is null or _s is null or _m <> _s or _n > 1")
    each = both.select(F.lit("serialization").alias("rule"), "genre", "doc_id")
    genres = [r.genre for r in docs.select("genre").distinct().orderBy("genre").collect()]  # the kinds of a corpus
    n = lambda marker: F.coalesce(F.sum(F.size(F.split("serialized", r"\Q" + marker + r"\E")) - 1), F.lit(0))
    marks = stored.agg(*[n(f"<|{'end_' if end else ''}{g}|>").alias(f"{g}|{end}") for g in genres for end in (0, 1)])
    rows = F.array(*[F.struct(F.lit(f"{'end' if end else 'start'}_markers").alias("rule"), F.lit(g).alias("genre"), F.col(f"{g}|{end}").alias("n")) for g in genres for end in (0, 1)])
    counts = docs.groupBy("genre").agg(F.count("*").alias("_d"))
    wrong = marks.select(F.inline(rows)).join(counts, "genre").where("n <> _d")
    return each.unionByName(wrong.select("rule", "genre", F.lit(None).cast("long").alias("doc_id")))


@query(
    "corpus_rules",
    f"""with {DOCS} select 'serialization' as rule, genre, doc_id from docs where doc_id % 37 = 4 or doc_id % 41 = 6 or doc_id % 43 = 8
    union all select 'start_markers', genre, null from docs group by genre having count(*) filter (doc_id % 37 = 4 and doc_id % 41 <> 6) <> count(*) filter (doc_id % 41 = 6)
    union all select 'end_markers', genre, null from docs group by genre having count(*) filter (doc_id % 37 = 4) > 0 or count(*) filter (doc_id % 41 = 6) > 0""",
)
def corpus_rules_query(spark, sf):
    """A stored corpus that lacks some documents, has lost some end markers' last sign, and has others edited."""
    docs = documents(spark, sf)
    stored = serialized(docs).where("doc_id % 37 <> 4 or doc_id % 41 = 6")
    text = F.when(F.col("doc_id") % 41 == 6, F.concat(F.col("serialized"), F.lit("<|"), F.col("genre"), F.lit("|>"))).when(F.col("doc_id") % 43 == 8, F.concat(F.lit("x"), F.col("serialized"))).otherwise(F.col("serialized"))
    return corpus_rules(docs, stored.select("doc_id", text.alias("serialized")))
