"""Request sessions by tool name, memory that is read, envelopes, phases and what a loop learns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.incidents import FIELDS, argument_errors, field_type
from quillspark.plans.registry import query
from quillspark.sources.tables import TRACE, documents, table, trace

# Tools with their token cost, phases, resources, the default loop and the message where nothing was learnt.
TOOLS = ("retrieve_runbook", "run_diagnostic", "summarize_incident", "create_incident", "add_evidence", "append_delta", "write_plan", "append_memory_delta")
PHASES = ("observe", "plan", "act", "learn")
RESOURCES = ("memory://telemetry/snapshot", "memory://alerts/latest", "memory://runbooks/index", "memory://memory/deltas", "memory://deltas", "memory://deltas/recent", "memory://plans/current")
UNSCOPED, NO_SUMMARY = "unscoped", "No summary"


def _kinds(e: str) -> list[str]:
    """Raw requests of every kind; ``e`` is the SQL text of the request's number."""
    def call(name: str, args: str, meta: str = "") -> str:
        return f"""'{{"jsonrpc":"2.0","id":' || {e} || ',"method":"callTool","params":{{"name":"{name}","arguments":{args}{meta}}}}}'"""
    def ask(method: str, params: str, id_: str = "") -> str:
        return f"""'{{"jsonrpc":"2.0","id":' || {id_ or e} || ',"method":"{method}"{params}}}'"""
    return [
        call("retrieve_runbook", '{"query":"cpu"}', ',"_meta":{"loopId":"L1","phase":"plan","correlationId":"c-1"}'), call("retrieve_runbook", '{"query":"cpu","top_k":"2"}'),
        call("retrieve_runbook", '{"query":"cpu","top_k":true}'), call("retrieve_runbook", '{"query":"cpu","top_k":6}'), call("retrieve_runbook", '{"top_k":0}'),
        call("run_diagnostic", '{"command":"top","host":"node-3"}'), call("run_diagnostic", '{"command":"top"}'), call("write_plan", '{"plan":["a","b"]}', ',"_meta":{"phase":"bogus"}'),
        call("write_plan", '{"plan":"a"}'), call("create_incident", '{"id":"1","title":null}'), call("append_memory_delta", '{"delta":{"x":1},"more":2}'), call("drop_tables", "{}"), call("drop_tables", '{"query":1}'),
        call("add_evidence", "[1]"), ask("getResource", ',"params":{"uri":"memory://memory/deltas","cursor":"9","_meta":{"phase":"learn","loopId":""}}'),
        ask("getResource", ',"params":{"uri":"memory://nowhere"}'), ask("getResource", ',"params":{"uri":"memory://incidents/17"}'), ask("initialize", ""), ask("initialize", "", "'null'"), ask("nothing", ',"params":{"_meta":3}'),
        ask("initialize", ',"params":"text"'), "'{not json'", "'[1]'", f"""'{{"jsonrpc":"1.0","id":' || {e} || ',"method":"initialize"}}'""", f"""'{{"jsonrpc":"2.0","id":' || {e} || '}}'""", """'{"jsonrpc":"2.0","method":"initialize"}'""",
    ]


def session_requests(spark, sf) -> DataFrame:
    """(req, raw, budget): one request an event, of all kinds in turn, and what its session has left."""
    kinds = _kinds("event_id")
    raw = F.expr("case event_id % " + str(len(kinds)) + "".join(f" when {i} then {k}" for i, k in enumerate(kinds)) + " end")
    return table(spark, sf, "events").select(F.col("event_id").alias("req"), raw.alias("raw"), (F.col("event_id") % 7).alias("budget"))


def handled(rows: DataFrame) -> DataFrame:
    """(req, code, is_logged, phase, loop_id, correlation_id, handler) of each raw request that is answered, by the first rule that holds.

    A request without an id is a notification and gets no answer.  Budgets come
    before arguments, arguments before the tool's name.
    """
    j = lambda path: F.get_json_object("raw", path)
    v = F.try_parse_json("raw")
    rows = rows.withColumns(
        {
            "_bad": v.isNull(), "_object": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "_version": F.coalesce(j("$.jsonrpc"), F.lit("")), "_method": j("$.method"), "_id": j("$.id"),
            "_params": field_type(F.col("raw"), "$.params"), "_args": field_type(F.col("raw"), "$.params.arguments"), "_name": j("$.params.name"), "_uri": j("$.params.uri"),
            "_phase": j("$.params._meta.phase"), "_loop": F.nullif(j("$.params._meta.loopId"), F.lit("")), "_correlation": F.nullif(j("$.params._meta.correlationId"), F.lit("")),
        }
    )
    arguments = F.coalesce(j("$.params.arguments"), F.lit("{}"))
    errors = F.coalesce(*[F.when(F.col("_name") == t, F.size(argument_errors(arguments, t))) for t in TOOLS], F.lit(0))
    known_uri = F.col("_uri").isin(*RESOURCES) | F.coalesce(F.col("_uri").rlike("^memory://(incidents|evidence)/"), F.lit(False))
    call, get = F.col("_method") == "callTool", F.col("_method") == "getResource"
    rejected = (
        F.when(F.col("_bad"), -32700).when(~F.col("_object") | (F.col("_version") != "2.0") | F.col("_method").isNull(), -32600)
        .when(F.col("_id").isNull(), None).when(F.coalesce(F.col("_params") != "object", F.lit(False)), -32602)
    )
    answered = (
        F.when(~F.col("_method").isin("initialize", "getResource", "callTool"), -32601).when(get & ~F.coalesce(known_uri, F.lit(False)), -32603).when(call & (F.col("budget") <= 0), -32000)
        .when(call & F.coalesce(F.col("_args") != "object", F.lit(False)), -32602).when(call & (errors > 0), -32602).when(call & ~F.coalesce(F.col("_name").isin(*TOOLS), F.lit(False)), -32603).otherwise(0)
    )
    phase = F.when(F.col("_phase").isin(*PHASES), F.col("_phase")).when(F.col("_method").isin("initialize", "getResource"), "observe").otherwise("act")
    one = F.struct(rejected.alias("rejected"), answered.alias("answered"), F.col("_id").alias("id"), phase.alias("phase"), F.col("_loop").alias("loop"), F.col("_correlation").alias("correlation"), F.when(call, F.col("_name")).otherwise(F.col("_method")).alias("handler"))
    # a row for itself, so that what follows reads these columns and doesn't repeat their expressions
    rows = rows.select("req", F.inline(F.array(one))).where("rejected is not null or id is not null")
    logged = F.col("rejected").isNull()
    code = F.coalesce("rejected", "answered")
    return rows.select(
        "req", code.alias("code"), logged.alias("is_logged"), F.when(logged, F.col("phase")).alias("phase"), F.when(logged, F.coalesce("loop", F.lit(UNSCOPED))).alias("loop_id"),
        F.when(logged, F.col("correlation")).alias("correlation_id"), F.when(logged & (code == 0), F.col("handler")).alias("handler"),
    )


def _errors_sql() -> str:
    kinds = {"string": "('VARCHAR')", "integer": "('BIGINT', 'UBIGINT')", "array": "('ARRAY')", "object": "('OBJECT')"}
    out = []
    for tool, field, kind, required, low, high in FIELDS:
        have, value = f"json_type(a, '$.{field}')", f"try_cast(a->>'$.{field}' as bigint)"
        bad = f"case when {have} is null then {int(required)} when {have} not in {kinds[kind]} then 1"
        bad += f" when {value} < {low} then 1" if low is not None else ""
        bad += f" when {value} > {high} then 1" if high is not None else ""
        out.append(f"case when name = '{tool}' then {bad} else 0 end else 0 end")
    return " + ".join(out)


def _list(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


SESSION = f"""raws as (select event_id as req, event_id % 7 as budget, case event_id % {len(_kinds(""))} {" ".join(f"when {i} then {k}" for i, k in enumerate(_kinds("event_id")))} end as raw from events),
js as (select req, budget, json_valid(raw) as valid, case when json_valid(raw) then raw::json end as j from raws),
f as (select *, json_type(j) as kind, j->>'$.method' as method, j->>'$.id' as id, json_type(j, '$.params') as params, j->>'$.params.name' as name, j->>'$.params.uri' as uri, json_type(j, '$.params.arguments') as args,
  coalesce(j->'$.params.arguments', '{{}}'::json) as a, j->>'$.params._meta.phase' as ph, nullif(j->>'$.params._meta.loopId', '') as lo, nullif(j->>'$.params._meta.correlationId', '') as co from js),
g as (select *, case when not valid then -32700 when kind <> 'OBJECT' or coalesce(j->>'$.jsonrpc', '') <> '2.0' or method is null then -32600 when id is null then null when params is not null and params not in ('OBJECT', 'NULL') then -32602 end as rejected,
  case when method not in ('initialize', 'getResource', 'callTool') then -32601
  when method = 'getResource' and not coalesce(uri in ({_list(RESOURCES)}) or regexp_matches(uri, '^memory://(incidents|evidence)/'), false) then -32603
  when method = 'callTool' and budget <= 0 then -32000 when method = 'callTool' and args is not null and args <> 'OBJECT' then -32602
  when method = 'callTool' and {_errors_sql()} > 0 then -32602 when method = 'callTool' and not coalesce(name in ({_list(TOOLS)}), false) then -32603 else 0 end as answered from f),
handled as (select req, coalesce(rejected, answered) as code, rejected is null as is_logged, case when rejected is null then case when ph in ({_list(PHASES)}) then ph when method in ('initialize', 'getResource') then 'observe' else 'act' end end as phase,
  case when rejected is null then coalesce(lo, '{UNSCOPED}') end as loop_id, case when rejected is null then co end as correlation_id,
  case when rejected is null and answered = 0 then case when method = 'callTool' then name else method end end as handler from g where rejected is not null or id is not null)"""


@query("session_outcome", f"with {SESSION} select * from handled")
def session_outcome(spark, sf):
    return handled(session_requests(spark, sf))


@query("session_log", f"with {SESSION} select phase, loop_id, case when code = 0 then 'ok' else 'error' end as status, count(*) as n from handled where is_logged group by all")
def session_log(spark, sf):
    logged = handled(session_requests(spark, sf)).where("is_logged")
    return logged.groupBy("phase", "loop_id", F.when(F.col("code") == 0, "ok").otherwise("error").alias("status")).agg(F.count("*").alias("n"))


def unwrapped(envelope: Column) -> Column:
    """Text or data of the first content item, else the envelope as it came."""
    kind = F.get_json_object(envelope, "$.content[0].type")
    return F.coalesce(F.when(kind == "text", F.get_json_object(envelope, "$.content[0].text")).when(kind == "json", F.get_json_object(envelope, "$.content[0].data")), envelope)


def _answers(column: str) -> str:
    kinds = (
        """'{"content":[{"type":"text","text":"said ' || {c} || '"},{"type":"text","text":"more"}]}'""", """'{"content":[{"type":"json","data":{"n":' || {c} || '}}]}'""",
        """'{"content":[{"type":"image"}]}'""", """'{"content":[]}'""", """'{"status":"ok","data":{"n":' || {c} || '}}'""",
    )
    return f"case {column} % 5 " + " ".join(f"when {i} then " + k.replace("{c}", column) for i, k in enumerate(kinds)) + " end"


@query("response_unwrap", f"with r as (select event_id as req, ({_answers('event_id')}) as e from events) select req, coalesce(case e->>'$.content[0].type' when 'text' then e->>'$.content[0].text' when 'json' then e->>'$.content[0].data' end, e) as answer from r")
def response_unwrap(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("req"), unwrapped(F.expr(_answers("event_id"))).alias("answer"))


def learnt(results: DataFrame, by: list[str], order: str, summary: str) -> DataFrame:
    """The first summary of each group in order, else a constant."""
    first = F.min(F.when(F.col(summary).isNotNull(), F.struct(order, summary)))[summary]
    return results.groupBy(*by).agg(F.coalesce(first, F.lit(NO_SUMMARY)).alias("summary"))


@query(
    "harness_learn",
    f"""with {TRACE}, s as (select run, loop, seq, case when status = 'ok' and latency_ms > 30 then 'took ' || latency_ms end as s from trace)
    select run, loop, coalesce(arg_min(s, seq) filter (s is not null), '{NO_SUMMARY}') as summary from s group by run, loop""",
)
def harness_learn(spark, sf):
    said = F.when((F.col("status") == "ok") & (F.col("latency_ms") > 30), F.concat(F.lit("took "), F.col("latency_ms")))
    return learnt(trace(spark, sf).withColumn("said", said), ["run", "loop"], "seq", "said")


def phase_rows(loops: DataFrame) -> DataFrame:
    """(run, loop, n, phase, event): start and end of the four phases of each loop, in order."""
    names = F.array(*[F.struct(F.lit(2 * i + k).alias("n"), F.lit(p).alias("phase"), F.lit(e).alias("event")) for i, p in enumerate(PHASES) for k, e in enumerate(("start", "end"))])
    return loops.select("run", "loop", F.explode(names).alias("p")).select("run", "loop", "p.*")


@query("opal_phases", f"with {TRACE} select run, loop, (2 * i + k)::int as n, p as phase, e as event from (select distinct run, loop from trace), (values {', '.join(f'({i}, {chr(39)}{p}{chr(39)})' for i, p in enumerate(PHASES))}) a(i, p), (values (0, 'start'), (1, 'end')) b(k, e)")
def opal_phases(spark, sf):
    return phase_rows(trace(spark, sf).select("run", "loop").distinct())


# Memory: stores as rows (store, key, seq, value); reading routes an address to them.


def memory_rows(spark, sf) -> DataFrame:
    """(store, key, seq, value) of incidents, evidence and deltas, made from events and conversations."""
    e = table(spark, sf, "events")
    incidents = e.select(F.lit("incidents").alias("store"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    said = table(spark, sf, "conversations").select(F.lit("evidence"), F.col("conv_id").cast("string"), F.col("turn").cast("long"), "role")
    deltas = e.where("event_type = 'error'").select(F.lit("deltas"), F.lit("recent"), "event_id", F.col("user_id").cast("string"))
    return incidents.union(said).union(deltas)


def read_memory(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(uri, n, value, error): the latest value of a key, or the number of all items where the address is a list; an unknown address is an error.

    The old address of the deltas leads to the same rows; what follows an
    address as a cursor is not looked at.
    """
    uri = F.when(F.col("uri").isin("memory://memory/deltas", "memory://deltas"), "memory://deltas/recent").otherwise(F.col("uri"))
    part = lambda i: F.regexp_extract(uri, "^memory://(incidents|evidence|deltas)/([^/]*)$", i)
    wanted = asked.select("uri", part(1).alias("store"), part(2).alias("key"))
    latest = rows.groupBy("store", "key").agg(F.count("*").alias("n"), F.max_by("value", "seq").alias("value"))
    found = wanted.join(latest, ["store", "key"], "left")
    return found.select("uri", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("store") != "deltas", F.col("value")).alias("value"), F.when(F.col("store") == "", F.concat(F.lit("Unknown resource URI: "), F.col("uri"))).alias("error"))


ASKED = tuple(f"memory://incidents/{i}" for i in range(1, 40)) + tuple(f"memory://evidence/{i}" for i in range(1, 40)) + ("memory://memory/deltas", "memory://deltas", "memory://deltas/recent", "memory://incidents/none", "memory://other")


@query(
    "memory_read",
    f"""with rows as (select 'incidents' as store, user_id::varchar as key, event_id as seq, event_type as value from events union all select 'evidence', conv_id::varchar, turn, role from conversations
      union all select 'deltas', 'recent', event_id, user_id::varchar from events where event_type = 'error'), latest as (select store, key, count(*) as n, arg_max(value, seq) as value from rows group by all),
    asked(uri) as (values {", ".join(f"('{a}')" for a in ASKED)}), w as (select uri, case when uri in ('memory://memory/deltas', 'memory://deltas') then 'memory://deltas/recent' else uri end as u from asked),
    p as (select uri, regexp_extract(u, '^memory://(incidents|evidence|deltas)/([^/]*)$', 1) as store, regexp_extract(u, '^memory://(incidents|evidence|deltas)/([^/]*)$', 2) as key from w)
    select uri, coalesce(n, 0) as n, case when store <> 'deltas' then value end as value, case when store = '' then 'Unknown resource URI: ' || uri end as error from p left join latest using (store, key)""",
)
def memory_read(spark, sf):
    return read_memory(spark.createDataFrame([(a,) for a in ASKED], "uri string"), memory_rows(spark, sf))


@query(
    "memory_snapshot",
    f"""with {TRACE}, l as (select run, max(loop) as loops, count(*) filter (phase = 'error') as deltas, sum(latency_ms)::bigint as ms, arg_max(phase, loop * 10 + seq) as latest from trace group by run)
    select run, latest as alert, deltas, loops + 1 as plan_loops, ms as telemetry_ms from l""",
)
def memory_snapshot(spark, sf):
    """Alert, deltas, plan and telemetry of each run at its end."""
    by = trace(spark, sf).groupBy("run")
    return by.agg(F.max_by("phase", F.col("loop") * 10 + F.col("seq")).alias("alert"), F.count_if(F.col("phase") == "error").alias("deltas"), (F.max("loop") + 1).alias("plan_loops"), F.sum("latency_ms").alias("telemetry_ms"))


def seeded(defaults: DataFrame, seeds: DataFrame) -> DataFrame:
    """Default rows (store, key, seq, value) with seeds merged in: a seed's key replaces the default's, list items are added."""
    lists = "store = 'deltas'"
    kept = defaults.where(f"not ({lists})").join(seeds.where(f"not ({lists})").select("store", "key").distinct(), ["store", "key"], "left_anti")
    return kept.select("store", "key", "seq", "value").union(defaults.where(lists).select("store", "key", "seq", "value")).union(seeds.select("store", "key", "seq", "value"))


@query(
    "store_seeding",
    """with d as (select 'incidents' as store, user_id::varchar as key, max(event_id) as seq, 'default' as value from events group by user_id union all select 'deltas', 'recent', event_id, 'default' from events where event_id % 50 = 0),
    s as (select 'incidents' as store, user_id::varchar as key, max(event_id) as seq, 'seed' as value from events where user_id % 3 = 0 group by user_id union all select 'deltas', 'recent', event_id, 'seed' from events where event_id % 70 = 0)
    select * from s union all select * from d where store = 'deltas' union all select * from d where store <> 'deltas' and key not in (select key from s where store <> 'deltas')""",
)
def store_seeding(spark, sf):
    e = table(spark, sf, "events")
    def rows(which: Column, every: int, value: str) -> DataFrame:
        one = e.where(which).groupBy("user_id").agg(F.max("event_id").alias("seq"))
        return one.select(F.lit("incidents").alias("store"), F.col("user_id").cast("string").alias("key"), "seq", F.lit(value).alias("value")).union(e.where(F.col("event_id") % every == 0).select(F.lit("deltas"), F.lit("recent"), "event_id", F.lit(value)))
    return seeded(rows(F.lit(True), 50, "default"), rows(F.col("user_id") % 3 == 0, 70, "seed"))


def envelope(data: Column, latency_ms: Column, cost_tokens: Column | int = 10) -> Column:
    """What a tool answers; dollars are not tracked."""
    cost = cost_tokens if isinstance(cost_tokens, Column) else F.lit(cost_tokens)
    return F.struct(F.lit("ok").alias("status"), data.alias("data"), F.struct(latency_ms.alias("latency_ms"), cost.alias("cost_tokens"), F.lit(0.0).alias("cost_dollars")).alias("metrics"))


def error_response(req: Column, code: Column, message: Column) -> Column:
    return F.struct(F.lit("2.0").alias("jsonrpc"), req.alias("id"), F.struct(code.alias("code"), message.alias("message")).alias("error"))


# Messages by code.
MESSAGES = {-32700: "Parse error", -32600: "Invalid Request", -32601: "Method not found", -32602: "Invalid params", -32603: "Internal error", -32000: "Budget exhausted"}


@query(
    "envelopes",
    f"""with {SESSION} select req, case when code = 0 then 'ok' else 'error' end as status, case when code = 0 then 10 end as cost_tokens, case when code = 0 then 0.0::double end as cost_dollars,
    case code {" ".join(f"when {c} then '{m}'" for c, m in MESSAGES.items())} end as message from handled""",
)
def envelopes(spark, sf):
    rows = handled(session_requests(spark, sf))
    said = F.coalesce(*[F.when(F.col("code") == c, m) for c, m in MESSAGES.items()])
    rows = rows.withColumns({"e": F.when(F.col("code") == 0, envelope(F.col("handler"), F.lit(0))), "x": F.when(F.col("code") != 0, error_response(F.col("req"), F.col("code"), said))})
    return rows.select("req", F.coalesce("e.status", F.lit("error")).alias("status"), F.col("e.metrics.cost_tokens").alias("cost_tokens"), F.col("e.metrics.cost_dollars").alias("cost_dollars"), F.col("x.error.message").alias("message"))


@query("record_dict", "select '{\"doc_id\":' || doc_id || ',\"genre\":\"' || case when doc_id % 2 = 0 then 'statement' else 'minutes' end || '\",\"meeting_date\":\"' || strftime(date '2015-01-01' + ((doc_id // 2) * 37 % 4000)::int, '%Y-%m-%d') || '\"}' as record from documents")
def record_dict(spark, sf):
    """Manifest records: a document without its body, dates in ISO form."""
    return documents(spark, sf).select(F.to_json(F.struct("doc_id", "genre", F.date_format("meeting_date", "yyyy-MM-dd").alias("meeting_date"))).alias("record"))


@query("correlation_ids", f"with {TRACE} select count(*) as n, count(*) as n_distinct, true as has_form from (select distinct run, loop from trace)")
def correlation_ids(spark, sf):
    """A new id for each loop; ids themselves differ from run to run."""
    ids = trace(spark, sf).select("run", "loop").distinct().select(F.uuid().alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.min(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("has_form"))


@query("timing_floor", f"with {TRACE} select run, loop, floor(sum(latency_ms) / 7.0)::bigint as ms from trace group by run, loop")
def timing_floor(spark, sf):
    """Mean duration of a loop's events in whole milliseconds."""
    return trace(spark, sf).groupBy("run", "loop").agg(F.floor(F.sum("latency_ms") / 7.0).alias("ms"))
