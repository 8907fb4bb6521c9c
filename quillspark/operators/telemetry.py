"""Traces: budgets, guardrails, snapshots and consistency."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.sources.sinks import shared_root
from quillspark.sources.tables import TRACE, table, trace
from quillspark.sources.traces import read_trace

# Limits under which every outcome occurs on the trace of the test tables.
MS, TOKENS, STEPS, FAILURES = 400, 250, 5, 2
#: Dollars of a loop, and what a token of the test tables costs.
DOLLARS, PRICE = 0.2, 0.001
# Tokens that each tool costs; others cost nothing.
COSTS = (
    ("retrieve_runbook", 10), ("run_diagnostic", 15), ("summarize_incident", 20), ("create_incident", 5),
    ("add_evidence", 5), ("append_delta", 3), ("write_plan", 3), ("append_memory_delta", 3),
)
#: Event types of the test tables stand for tools.
TOOLS = {"click": "retrieve_runbook", "error": "run_diagnostic", "purchase": "summarize_incident", "signup": "create_incident"}


def so_far():
    """The events of a loop up to and with each one."""
    return Window.partitionBy("run", "loop").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def left(limit: Column, used: Column) -> Column:
    """What remains of a budget; it never falls below zero."""
    return F.greatest(F.lit(0), limit - used)


def spent(rows: DataFrame) -> DataFrame:
    """Adds sums up to and with each event of its loop."""
    return rows.withColumns(
        {
            "ms": F.sum(F.coalesce("latency_ms", F.lit(0))).over(so_far()),
            "used": F.sum(F.coalesce("tokens", F.lit(0))).over(so_far()),
            "failures": F.sum((F.col("status") != "ok").cast("long")).over(so_far()),
            "paid": F.sum(F.coalesce("dollars", F.lit(0.0)) if "dollars" in rows.columns else F.lit(0.0)).over(so_far()),
        }
    )


SPENT = f"""{TRACE}, spent as (select *, sum(latency_ms) over w as ms, sum(tokens) over w as used, count(*) filter (status <> 'ok') over w as failures from trace
  window w as (partition by run, loop order by seq rows unbounded preceding))"""


@query("budget_running", f"with {SPENT} select run, loop, seq, greatest(0, {TOKENS} - used)::bigint as tokens_left, greatest(0, {MS} - ms)::bigint as ms_left, round(greatest(0, {DOLLARS} - used * {PRICE}::double), 6) as dollars_left from spent")
def budget_running(spark, sf):
    rows = spent(trace(spark, sf).withColumn("dollars", F.col("tokens") * PRICE))
    return rows.select("run", "loop", "seq", left(F.lit(TOKENS), F.col("used")).alias("tokens_left"), left(F.lit(MS), F.col("ms")).alias("ms_left"), F.round(F.greatest(F.lit(0.0), F.lit(DOLLARS) - F.col("paid")), 6).alias("dollars_left"))


def guarded(rows: DataFrame, remote: bool, ms: int = MS, tokens: int = TOKENS) -> DataFrame:
    """(run, loop, steps, failures, reason): events kept up to the first trip, and what tripped.

    Remote: the step limit comes before a call; after it milliseconds, then
    tokens, and only a call that exhausts neither can count as a failure.
    Local: failures count first; latency trips when it is over the limit.
    """
    rows = spent(rows)
    if remote:
        ok = (F.col("ms") < ms) & (F.col("used") < tokens)
        rows = rows.withColumn("failures", F.sum(F.when(ok & (F.col("status") != "ok"), 1).otherwise(0)).over(so_far()))
        why = F.when(F.col("seq") > STEPS, "steps").when(F.col("ms") >= ms, "ms").when(F.col("used") >= tokens, "tokens").when(F.col("failures") >= FAILURES, "failures")
    else:
        why = F.when(F.col("seq") > STEPS, "steps").when(F.col("ms") > ms, "ms").when(F.col("used") >= tokens, "tokens").when(F.col("failures") >= FAILURES, "failures")
    rows = rows.withColumn("why", why)
    trip = F.min(F.when(F.col("why").isNotNull(), F.struct("seq", "why")))
    by = rows.groupBy("run", "loop").agg(trip.alias("t"), F.collect_list(F.struct("seq", "failures", "status")).alias("all"))
    # the event that meets the step limit is not called; any other tripping event is kept
    last = F.when(F.col("t.why") == "steps", F.col("t.seq") - 1).otherwise(F.coalesce("t.seq", F.lit(1 << 30)))
    by = by.withColumn("kept", F.filter("all", lambda x: x["seq"] <= last))
    return by.select("run", "loop", F.size("kept").cast("long").alias("steps"), F.coalesce(F.array_max(F.transform("kept", lambda x: x["failures"])), F.lit(0)).alias("failures"), F.exists("kept", lambda x: x["status"] != "ok").alias("any_failure"), F.coalesce("t.why", F.lit("none")).alias("reason"))


def GUARD(remote: bool) -> str:
    fails = f"count(*) filter (status <> 'ok' and ms < {MS} and used < {TOKENS}) over w" if remote else "failures"
    over = ">=" if remote else ">"
    return f"""{SPENT}, f as (select run, loop, seq, status, ms, used, {fails} as failures from spent window w as (partition by run, loop order by seq rows unbounded preceding)),
    y as (select *, case when seq > {STEPS} then 'steps' when ms {over} {MS} then 'ms' when used >= {TOKENS} then 'tokens' when failures >= {FAILURES} then 'failures' end as why from f),
    t as (select run, loop, min(seq) filter (why is not null) as trip from y group by all),
    r as (select y.run, y.loop, t.trip, max(why) filter (seq = trip) over (partition by y.run, y.loop) as reason, seq, status, failures from y join t using (run, loop)),
    guard as (select run, loop, count(*) as steps, max(failures)::bigint as failures, bool_or(status <> 'ok') as any_failure, coalesce(max(reason), 'none') as reason
      from r where trip is null or seq < trip or seq = trip and reason <> 'steps' group by all)"""


@query("act_guardrails_remote", f"with {GUARD(True)} select run, loop, steps, failures, reason from guard")
def act_guardrails_remote(spark, sf):
    return guarded(trace(spark, sf), True).select("run", "loop", "steps", "failures", "reason")


@query("act_guardrails_local", f"with {GUARD(False)} select run, loop, steps, failures, reason from guard")
def act_guardrails_local(spark, sf):
    return guarded(trace(spark, sf), False).select("run", "loop", "steps", "failures", "reason")


@query("act_status", f"with {GUARD(True)} select run, loop, case when reason <> 'none' then 'guardrail_stop' when any_failure then 'error' else 'ok' end as status from guard")
def act_status(spark, sf):
    status = F.when(F.col("reason") != "none", "guardrail_stop").when(F.col("any_failure"), "error").otherwise("ok")
    return guarded(trace(spark, sf), True).select("run", "loop", status.alias("status"))


@query("plan_truncate", f"with {TRACE} select run, loop, least(count(*), {STEPS}) as kept, count(*) > {STEPS} as is_cut from trace group by all")
def plan_truncate(spark, sf):
    n = F.count("*")
    return trace(spark, sf).groupBy("run", "loop").agg(F.least(n, F.lit(STEPS)).cast("long").alias("kept"), (n > STEPS).alias("is_cut"))


def truncated(steps: DataFrame, most: int = STEPS) -> DataFrame:
    """(run, loop, seq, kind, name, status): the steps of a plan (run, loop, seq, name) that are kept, in order, and the event of one that was too long."""
    kept = steps.where(F.col("seq") <= most).select("run", "loop", "seq", F.lit("step").alias("kind"), "name", F.lit("ok").alias("status"))
    over = steps.where(F.col("seq") == most + 1).select("run", "loop", F.lit(None).cast("long").alias("seq"), F.lit("plan_guardrail").alias("kind"), F.lit("max_steps").alias("name"), F.lit("error").alias("status"))
    long = over.select("run", "loop", F.lit("guardrail_stop").alias("_s"))
    kept = kept.join(long, ["run", "loop"], "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    return kept.unionByName(over)


@query(
    "plan_guardrail",
    f"""with {TRACE}, n as (select *, count(*) over (partition by run, loop) > {STEPS} as over from trace)
    select run, loop, seq::bigint as seq, 'step' as kind, phase as name, case when over then 'guardrail_stop' else 'ok' end as status from n where seq <= {STEPS}
    union all select run, loop, null, 'plan_guardrail', 'max_steps', 'error' from n where seq = {STEPS} + 1""",
)
def plan_guardrail(spark, sf):
    """Plans of a loop's events: the first steps, marked where the plan was cut, and an event that says so."""
    return truncated(trace(spark, sf).select("run", "loop", F.col("seq").cast("long").alias("seq"), F.col("phase").alias("name")))


@query("telemetry_snapshot", f"with {TRACE} select phase, loop, count(*) as n from trace group by grouping sets ((phase), (loop), ())")
def telemetry_snapshot(spark, sf):
    rows = trace(spark, sf)
    return rows.groupingSets([[F.col("phase")], [F.col("loop")], []], "phase", "loop").agg(F.count("*").alias("n"))


@query("last_events", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 5")
def last_events(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "user_id", "event_type")


@query("correlation_mismatch", "select rpc_id, count(distinct user_id) as correlations from (select event_id // 3 as rpc_id, user_id from events) group by rpc_id having count(distinct user_id) <> 1")
def correlation_mismatch(spark, sf):
    rows = table(spark, sf, "events").select(F.expr("event_id div 3").alias("rpc_id"), "user_id")
    return rows.groupBy("rpc_id").agg(F.count_distinct("user_id").alias("correlations")).where("correlations <> 1")


#: Payload keys whose lines follow an event's header, in this order.
PAYLOAD = ("request", "response", "errors", "plan", "steps", "results", "delta")


def replayed(rows: DataFrame) -> DataFrame:
    """(trace, idx, lines) of events (trace, idx from 0, phase, method, status, latency_ms, payload): a header, numbered from 001, and a line for each known payload key that is there, null or not."""
    head = F.format_string("[%03d] %s :: %s :: %s :: %dms", F.col("idx") + 1, "phase", "method", "status", "latency_ms")
    # a key with a null value is there and shows null
    value = lambda k: F.coalesce(F.get_json_object("payload", f"$.{k}"), F.when(F.array_contains(F.json_object_keys("payload"), k), "null"))
    lines = [F.concat(F.lit(f"      {k}: "), value(k)) for k in PAYLOAD]
    return rows.select("trace", "idx", F.array_compact(F.array(head, *lines)).alias("lines"))


#: Traces into which the events of the test tables are written.
TRACES = 16
STATUS = "case when event_type = 'error' then 'error' else 'ok' end"


def event_records(events: DataFrame) -> DataFrame:
    """Events as trace records of JSON: trace, run, order and the record."""
    payload = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.array("event_type").alias("errors"), F.struct("event_id").alias("request")))).otherwise(F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("results"))))
    return events.select(
        (F.col("user_id") % TRACES).alias("trace"), "ts", "event_id", F.col("user_id").cast("string").alias("correlation_id"), F.lit("act").alias("phase"), F.col("event_type").alias("method"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.floor("value").cast("int").alias("latency_ms"), payload.alias("payload"),
    )


def written_traces(spark, sf) -> str:
    """The folder of the events' traces as JSONL: a file for each trace, a blank line behind every error."""
    rows = event_records(table(spark, sf, "events"))
    fields = F.to_json(F.struct("correlation_id", "phase", "method", "status", "latency_ms", "payload"))
    rows = rows.withColumn("value", F.explode(F.when(F.col("status") == "error", F.array(fields, F.lit(""))).otherwise(F.array(fields))))
    path = f"{shared_root(spark)}/traces-{uuid.uuid4().hex}"
    order = ["trace", "ts", "event_id", F.desc("value")]
    rows.repartition(TRACES, "trace").sortWithinPartitions(*order).select("trace", "value").write.partitionBy("trace").text(path)
    return path


REPLAYED = f"""placed as (select *, user_id % {TRACES} as trace, row_number() over (partition by user_id % {TRACES} order by ts, event_id) - 1 as idx from events),
records as (select trace, idx, event_id, event_type, props, floor(value)::int as ms, {STATUS} as status,
  idx + coalesce(sum((event_type = 'error')::int) over (partition by trace order by idx rows between unbounded preceding and 1 preceding), 0) as line_no from placed)"""


@query("trace_scan", f"with {REPLAYED} select trace, line_no::bigint as line_no, idx, event_type as method, status, ms as latency_ms from records")
def trace_scan(spark, sf):
    """Events written as JSONL traces and scanned again: physical lines, blank ones counted, and places by time (a line's number where there is none)."""
    found = read_trace(spark, written_traces(spark, sf))
    trace = F.regexp_extract("path", "trace=([0-9]+)", 1).cast("long")
    return found.select(trace.alias("trace"), "line_no", "idx", "method", "status", "latency_ms")


@query(
    "replay_trace",
    f"""with {REPLAYED} select trace, idx, array_to_string(list_concat(['[' || lpad((idx + 1)::varchar, greatest(3, length((idx + 1)::varchar))::int, '0') || '] act :: ' || event_type || ' :: ' || status || ' :: ' || ms || 'ms'],
    case when status = 'error' then ['      request: {{"event_id":' || event_id || '}}', '      errors: ["' || event_type || '"]'] else ['      results: ' || (props->>'$.k')] end), chr(10)) as lines from records""",
)
def replay_trace(spark, sf):
    """The readable story of every trace, read from its JSONL file."""
    found = read_trace(spark, written_traces(spark, sf)).withColumn("trace", F.regexp_extract("path", "trace=([0-9]+)", 1).cast("long"))
    return replayed(found).select("trace", "idx", F.array_join("lines", "\n").alias("lines"))


def costs(spark) -> DataFrame:
    return spark.createDataFrame(list(COSTS), "tool string, cost int")


COST = "costs(tool, cost) as (values " + ", ".join(f"('{t}', {c})" for t, c in COSTS) + "), tools(event_type, tool) as (values " + ", ".join(f"('{e}', '{t}')" for e, t in TOOLS.items()) + ")"


@query("tool_cost", f"with {COST} select event_id, coalesce(cost, 0) as cost from events left join tools using (event_type) left join costs using (tool)")
def tool_cost(spark, sf):
    tool = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in TOOLS.items()])
    rows = table(spark, sf, "events").withColumn("tool", tool)
    return rows.join(F.broadcast(costs(spark)), "tool", "left").select("event_id", F.coalesce("cost", F.lit(0)).alias("cost"))
