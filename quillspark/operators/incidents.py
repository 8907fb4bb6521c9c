"""Retrieval, planning, state and request validation of incident runs.

Runs are the trace of the test tables (loops of seven events); conversations
stand for evidence.  Rows that no table holds, such as runbooks, are inline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import lookup
from quillspark.operators.telemetry import GUARD, TOOLS, guarded
from quillspark.plans.registry import query
from quillspark.sources.tables import TRACE, table, trace

# Checks in the order tried, with the verdict that each gives; any other command is healthy.
FIRST, FURTHER = "kubectl top pod", "kubectl logs deploy/staging-api --tail=50"
VERDICTS = (
    (FIRST, "inconclusive", "node-3 CPU at 88% of limit; no pod restarts; cause not identified."),
    (FURTHER, "degraded", "Repeated GC pauses; sustained CPU 92% on node-3; root cause needs human review."),
)
HEALTHY = ("healthy", "All pods healthy; CPU normalized.")
NO_RESULT = "no successful diagnostic"
# What an alert that states none has, results of a runbook search, and tool names that are no evidence.
DEFAULT_SERVICE, DEFAULT_ALERT, TOP_K = "staging-api", "ALRT-0001", 2
NO_EVIDENCE = ("retrieve_runbook", "run_diagnostic", "summarize_incident")
# Words of a symptom by class.
CRASH, CPU = "crash|crashloop|deploy|rollout|pod|fail|restart", "cpu|memory|spike"
RUNBOOKS = (
    ("rb-101", "High CPU playbook", ["Check pod CPU across nodes", "Capture logs before restart", "Restart service if CPU > 90% for 5 minutes"]),
    ("rb-202", "Crashloop restart", ["Describe pods", "Gather events", "Redeploy with rollback flag"]),
)
# Arguments of each tool as (tool, field, type, required, minimum, maximum).
FIELDS = (
    ("retrieve_runbook", "query", "string", True, None, None), ("retrieve_runbook", "top_k", "integer", False, 1, 5),
    ("run_diagnostic", "command", "string", True, None, None), ("run_diagnostic", "host", "string", True, None, None),
    ("summarize_incident", "alert_id", "string", True, None, None), ("summarize_incident", "evidence", "array", False, None, None),
    ("create_incident", "id", "string", True, None, None), ("create_incident", "title", "string", True, None, None), ("create_incident", "severity", "string", False, None, None),
    ("add_evidence", "id", "string", False, None, None), ("add_evidence", "content", "string", True, None, None), ("add_evidence", "source", "string", False, None, None),
    ("append_delta", "action", "string", True, None, None), ("append_delta", "details", "object", False, None, None),
    ("write_plan", "plan", "array", True, None, None), ("append_memory_delta", "delta", "object", True, None, None),
)


def retrieved(books: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query, rank, id, score): runbooks whose title or any step holds the query, in index order; an index of any size."""
    pieces = books.select("pos", F.explode(F.concat(F.array("title"), "steps")).alias("text"))
    found = lookup.search(pieces, queries, top_k, needle="query").join(books.select("pos", "id"), "pos")
    asked = queries.select("query", F.lower("query").alias("needle")).distinct()
    return found.join(asked, "needle").select("query", "rank", "id", (F.lit(1.0) - 0.1 * (F.col("rank") - 1)).alias("score"))


@query(
    "retrieve_topk",
    """with b(pos, id, title, steps) as (values """
    + ", ".join(f"({i}, '{a}', '{t}', ['" + "', '".join(s) + "'])" for i, (a, t, s) in enumerate(RUNBOOKS))
    + """), q(query) as (values ('CPU'), ('crash'), ('restart'), ('nothing')), h as (select query, id, row_number() over (partition by query order by pos)::int as rank from q join b
    on contains(lower(title), lower(query)) or len(list_filter(steps, lambda s: contains(lower(s), lower(query)))) > 0)
    select query, rank, id, round(1.0::double - 0.1 * (rank - 1), 6) as score from h where rank <= 3""",
)
def retrieve_topk(spark, sf):
    books = spark.createDataFrame([(i, *b) for i, b in enumerate(RUNBOOKS)], "pos int, id string, title string, steps array<string>")
    asked = spark.createDataFrame([("CPU",), ("crash",), ("restart",), ("nothing",)], "query string")
    return retrieved(books, asked, 3).withColumn("score", F.round("score", 6))


def verdict(command: Column) -> Column:
    c = F.trim(F.coalesce(command, F.lit("")))
    return F.coalesce(*[F.when(c == name, v) for name, v, _ in VERDICTS], F.lit(HEALTHY[0]))


def output(command: Column) -> Column:
    c = F.trim(F.coalesce(command, F.lit("")))
    return F.coalesce(*[F.when(c == name, out) for name, _, out in VERDICTS], F.lit(HEALTHY[1]))


#: The command that an event of the trace ran: by its token cost.
def command(tokens: Column) -> Column:
    return F.when(tokens % 3 == 0, FIRST).when(tokens % 3 == 1, f" {FURTHER} ").otherwise("uptime")


COMMAND = f"case tokens % 3 when 0 then '{FIRST}' when 1 then ' {FURTHER} ' else 'uptime' end"
VERDICT = f"case trim({COMMAND}) " + " ".join(f"when '{c}' then '{v}'" for c, v, _ in VERDICTS) + f" else '{HEALTHY[0]}' end"


@query("diagnostic_lookup", f"with {TRACE} select event_id, {VERDICT} as verdict from trace")
def diagnostic_lookup(spark, sf):
    return trace(spark, sf).select("event_id", verdict(command(F.col("tokens"))).alias("verdict"))


def diagnostic(evidence: Column) -> Column:
    """Result of the first evidence text that is a diagnostic with a result."""
    found = F.transform(F.filter(evidence, lambda x: x.startswith("diagnostic:")), lambda x: F.get_json_object(F.substring(x, 12, 1 << 30), "$.result"))
    return F.get(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def summary(alert: Column, evidence: Column) -> Column:
    """The summary text of an incident, with its diagnostic or without one."""
    d = diagnostic(evidence)
    # fixed values: the sentences of a summary
    said = F.coalesce(F.concat(F.lit("Recorded diagnostic result: "), d), F.lit("No successful diagnostic result was available; run manual diagnostics or escalate for further investigation."))
    return F.concat(F.lit("Incident "), alert, F.lit(": CPU spikes observed on staging-api. "), said, F.lit(" Recommend restart if sustained > 90% for 5 minutes. Capture logs before restart; monitor for recurrence."))


@query(
    "summarize",
    f"""with {TRACE}, f as (select run, loop, arg_min('ms ' || latency_ms, seq) filter (status = 'ok' and latency_ms > 20) as r from trace group by all)
    select run, loop, 'Incident A-' || run || ': CPU spikes observed on staging-api. ' || coalesce('Recorded diagnostic result: ' || r, 'No successful diagnostic result was available; run manual diagnostics or escalate for further investigation.')
    || ' Recommend restart if sustained > 90% for 5 minutes. Capture logs before restart; monitor for recurrence.' as summary from f""",
)
def summarize(spark, sf):
    item = F.concat(F.lit('diagnostic:{"result":"'), F.when((F.col("status") == "ok") & (F.col("latency_ms") > 20), F.concat(F.lit("ms "), F.col("latency_ms"))).otherwise(""), F.lit('"}'))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("e")))), lambda x: x["e"])
    by = trace(spark, sf).groupBy("run", "loop").agg(items.alias("evidence"))
    return by.select("run", "loop", summary(F.concat(F.lit("A-"), F.col("run")), F.col("evidence")).alias("summary"))


def summary_delta(alert: Column, evidence: Column) -> list[Column]:
    """The delta that a summary leaves behind: its note, and the evidence without bare tool names and nulls."""
    kept = F.filter(evidence, lambda x: x.isNotNull() & ~x.isin(*NO_EVIDENCE))
    note = F.concat(F.lit("Summarized "), alert, F.lit(" with "), F.size(kept).cast("string"), F.lit(" evidence items"))
    return [F.lit("summarize_incident").alias("action"), note.alias("note"), F.array_join(kept, "|").alias("evidence"), summary(alert, kept).alias("summary")]


@query(
    "summary_delta",
    f"""with {TRACE}, i as (select run, loop, seq, case when phase = 'click' then 'retrieve_runbook' when phase = 'view' then null when status = 'error' then 'diagnostic:{{"result":"ms ' || latency_ms || '"}}' else 'ref#' || tokens end as e from trace),
    k as (select run, loop, count(e) filter (e <> 'retrieve_runbook') as n, string_agg(e, '|' order by seq) filter (e <> 'retrieve_runbook') as x, arg_min(e, seq) filter (e like 'diagnostic:%') as d from i group by all)
    select run, loop, 'summarize_incident' as action, 'Summarized A-' || run || ' with ' || n || ' evidence items' as note, coalesce(x, '') as evidence, 'Incident A-' || run || ': CPU spikes observed on staging-api. ' ||
    coalesce('Recorded diagnostic result: ' || regexp_extract(d, '"result":"([^"]*)"', 1), 'No successful diagnostic result was available; run manual diagnostics or escalate for further investigation.')
    || ' Recommend restart if sustained > 90% for 5 minutes. Capture logs before restart; monitor for recurrence.' as summary from k""",
)
def summary_delta_query(spark, sf):
    item = F.when(F.col("phase") == "click", "retrieve_runbook").when(F.col("phase") == "view", F.lit(None)).when(F.col("status") == "error", F.concat(F.lit('diagnostic:{"result":"ms '), F.col("latency_ms"), F.lit('"}'))).otherwise(F.concat(F.lit("ref#"), F.col("tokens")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("e")))), lambda x: x["e"])
    by = trace(spark, sf).groupBy("run", "loop").agg(items.alias("evidence"))
    return by.select("run", "loop", *summary_delta(F.concat(F.lit("A-"), F.col("run")), F.col("evidence")))


def diagnostic_item(command: Column, host: Column, captured: Column, step: Column) -> Column:
    """A diagnostic as evidence: compact JSON with its keys in order, its output on one line and cut to 200 characters."""
    shown = F.substring(F.trim(F.regexp_replace(F.coalesce(F.nullif(captured, F.lit("")), F.lit("<no output>")), r"\s+", " ")), 1, 200)
    return F.concat(F.lit("diagnostic:"), F.to_json(F.struct(command.alias("command"), host.alias("host"), shown.alias("result"), step.alias("step")), {"ignoreNullFields": "false"}))


@query(
    "diagnostic_evidence",
    f"""with {TRACE}, i as (select run, loop, seq, case when phase = 'purchase' then 'memory://runbooks/index#rb-' || tokens % 3 when phase in ('view', 'click') then
      'diagnostic:{{"command":"' || trim({COMMAND}) || '","host":"service-' || run || '","result":"' || case tokens % 3 when 0 then '{VERDICTS[0][2]}' when 1 then '{VERDICTS[1][2]}' else '{HEALTHY[1]}' end || '","step":"step-' || tokens % 2 || '"}}' end as e from trace where status = 'ok'),
    d as (select run, loop, e, min(seq) as s from i where e is not null group by all), g as (select run, loop, string_agg(e, '|' order by s) as x from d group by all)
    select run, loop, 'memory://alerts/latest#A-' || run || coalesce('|' || x, '') as evidence from (select distinct run, loop from trace) left join g using (run, loop)""",
)
def diagnostic_evidence(spark, sf):
    """What each loop's good steps leave as evidence: the alert, runbooks found, diagnostics; every item once."""
    rows = trace(spark, sf)
    c = command(F.col("tokens"))
    found = diagnostic_item(F.trim(c), F.concat(F.lit("service-"), F.col("run")), F.concat(F.lit(" "), F.replace(output(c), F.lit(" "), F.lit("\n "))), F.concat(F.lit("step-"), F.col("tokens") % 2))
    ref = F.when(F.col("phase") == "purchase", F.concat(F.lit("memory://runbooks/index#rb-"), F.col("tokens") % 3)).when(F.col("phase").isin("view", "click"), found)
    rows = rows.withColumn("ref", F.when(F.col("status") == "ok", ref))
    by = evidence_of(rows, ["run", "loop"], "seq", F.col("ref"))
    items = F.concat(F.array(F.concat(F.lit("memory://alerts/latest#A-"), F.col("run"))), F.array_compact("evidence"))
    return by.select("run", "loop", F.array_join(items, "|").alias("evidence"))


def evidence_of(rows: DataFrame, by: list[str], order: str, refs: Column) -> DataFrame:
    """Texts of each group in order, every text once at its first place."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, refs.alias("e")))), lambda x: x["e"])
    return rows.groupBy(*by).agg(F.array_distinct(items).alias("evidence"))


@query(
    "evidence",
    f"""with {TRACE}, e as (select run, loop, phase || ':' || (tokens % 4) as e, min(seq) as s from trace where status = 'ok' group by all), g as (select run, loop, string_agg(e, '|' order by s) as x from e group by all)
    select run, loop, 'alert:' || run || '|' || x as evidence from g""",
)
def evidence(spark, sf):
    rows = trace(spark, sf).where("status = 'ok'")
    found = evidence_of(rows, ["run", "loop"], "seq", F.concat_ws(":", "phase", F.col("tokens") % 4))
    return found.select("run", "loop", F.concat(F.lit("alert:"), F.col("run"), F.lit("|"), F.array_join("evidence", "|")).alias("evidence"))


def assessed(rows: DataFrame) -> DataFrame:
    """(run, loop, status, verdict, ran, command): each loop by its last good diagnostic, ``tool`` names the step."""
    good = (F.col("tool") == "run_diagnostic") & (F.col("status") == "ok")
    by = rows.groupBy("run", "loop").agg(F.max_by(F.when(good, F.col("command")), F.when(good, F.col("seq"))).alias("command"), F.max_by("tool", "seq").alias("last"))
    v = F.when(F.col("command").isNull(), "no_diagnostic").otherwise(verdict(F.col("command")))
    by = by.withColumn("verdict", v)
    status = F.when(F.col("verdict") == "healthy", "resolved").otherwise("unresolved")
    result = F.when(F.col("command").isNull(), NO_RESULT).otherwise(F.trim(F.regexp_replace(output(F.col("command")), r"\s+", " ")))
    ran = F.when(F.col("command").isNull(), F.coalesce("last", F.lit("nothing"))).otherwise("run_diagnostic")
    return by.select("run", "loop", status.alias("status"), "verdict", ran.alias("ran"), F.trim("command").alias("command"), result.alias("result"))


def _steps(spark, sf) -> DataFrame:
    """The trace with tools and commands: views and clicks are diagnostics here."""
    tool = F.when(F.col("phase").isin("view", "click", "error"), "run_diagnostic").otherwise(F.coalesce(*[F.when(F.col("phase") == e, t) for e, t in TOOLS.items()], F.lit("append_delta")))
    return trace(spark, sf).withColumn("tool", tool).withColumn("command", command(F.col("tokens")))


RESULT = f"case when command is null then '{NO_RESULT}' " + " ".join(f"when command = '{c}' then '{o}'" for c, _, o in VERDICTS) + f" else '{HEALTHY[1]}' end"
NOTE = "'Diagnosed service-' || run || ', ran ' || coalesce(command, ran) || ', outcome ' || verdict || ': ' || result"
STEPS = f"""{TRACE}, steps as (select *, case when phase in ('view', 'click', 'error') then 'run_diagnostic' when phase = 'purchase' then 'summarize_incident' when phase = 'signup' then 'create_incident' else 'append_delta' end as tool, {COMMAND} as command from trace),
l as (select run, loop, max_by(command, seq) filter (tool = 'run_diagnostic' and status = 'ok') as command, max_by(tool, seq) as last from steps group by all),
loops as (select run, loop, last, trim(command) as command, case when command is null then 'no_diagnostic' when trim(command) = '{FIRST}' then 'inconclusive' when trim(command) = '{FURTHER}' then 'degraded' else 'healthy' end as verdict from l),
assessed as (select run, loop, case when verdict = 'healthy' then 'resolved' else 'unresolved' end as status, verdict, case when command is null then last else 'run_diagnostic' end as ran, command, {RESULT} as result from loops)"""


@query("assess_loop", f"with {STEPS} select run, loop, status, verdict, ran, command, result from assessed")
def assess_loop(spark, sf):
    return assessed(_steps(spark, sf))


@query("loop_delta", f"with {STEPS} select run, loop, 'loop_outcome' as kind, command, status as outcome, verdict, {NOTE} as note from assessed")
def loop_delta(spark, sf):
    return noted(assessed(_steps(spark, sf)))


def noted(loops: DataFrame) -> DataFrame:
    """The delta that a loop leaves behind: what was run and how it came out, the diagnostic's output at the end of its note."""
    note = F.format_string("Diagnosed service-%d, ran %s, outcome %s: %s", "run", F.coalesce("command", "ran"), "verdict", "result")
    return loops.select("run", "loop", F.lit("loop_outcome").alias("kind"), "command", F.col("status").alias("outcome"), "verdict", note.alias("note"))


@query("prior_deltas", f"with {STEPS} select a.run, a.loop, count(b.loop) as n_prior from assessed a left join assessed b on a.run = b.run and b.loop < a.loop and b.status = 'unresolved' group by all")
def prior_deltas(spark, sf):
    before = Window.partitionBy("run").orderBy("loop").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum((F.col("status") == "unresolved").cast("long")).over(before)
    return assessed(_steps(spark, sf)).select("run", "loop", F.coalesce(n, F.lit(0)).alias("n_prior"))


def incident_class(symptom: Column, severity: Column) -> Column:
    """Crash words come before load words; a high severity counts as load."""
    s = F.lower(F.trim(F.coalesce(symptom, F.lit(""))))
    return F.when(s.rlike(CRASH), "crash_or_deploy").when(s.rlike(CPU) | F.lower(F.trim(F.coalesce(severity, F.lit("")))).isin("high", "critical"), "cpu_spike").otherwise("fallback")


@query(
    "classify_incident",
    f"""select o_orderkey, case when regexp_matches(lower(trim(o_orderpriority || case when o_orderkey % 5 = 0 then ' Pod restart' when o_orderkey % 5 = 1 then ' CPU' else '' end)), '{CRASH}') then 'crash_or_deploy'
    when o_orderkey % 5 = 1 or o_orderstatus = 'F' then 'cpu_spike' else 'fallback' end as class, case when o_orderkey % 3 = 0 then 'staging-api' else 'service' end as service from orders""",
)
def classify_incident(spark, sf):
    o = table(spark, sf, "orders")
    more = F.when(F.col("o_orderkey") % 5 == 0, " Pod restart").when(F.col("o_orderkey") % 5 == 1, " CPU").otherwise("")
    severity = F.when(F.col("o_orderstatus") == "F", "HIGH ").otherwise("low")
    stated = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(" service ")
    return o.select("o_orderkey", incident_class(F.concat("o_orderpriority", more), severity).alias("class"), defaulted(stated, "staging-api").alias("service"))


def defaulted(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def tight(budget: Column, least: int = 20) -> Column:
    """Whether a budget (tokens and ms, as texts) is nearly used up; what cannot be read is zero, no budget at all is never tight."""
    low = lambda c: F.coalesce(budget[c].try_cast("int"), F.lit(0)) <= least
    return budget.isNotNull() & (low("tokens") | low("ms"))


@query(
    "budget_tight",
    """select event_id, event_id % 13 <> 0 and (coalesce(try_cast(case when event_id % 11 = 0 then 'x' else props->>'$.k' end as int), 0) <= 20 or coalesce(try_cast(floor(value)::bigint::varchar as int), 0) <= 20) as is_tight from events""",
)
def budget_tight(spark, sf):
    tokens = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    budget = F.when(F.col("event_id") % 13 != 0, F.struct(tokens.alias("tokens"), F.floor("value").cast("long").cast("string").alias("ms")))
    return table(spark, sf, "events").select("event_id", tight(budget).alias("is_tight"))


def alert_context(symptom: Column, severity: Column, service: Column, id: Column) -> list[Column]:
    """An alert as the planner reads it: words in lower case, a service and an id where none is stated."""
    word = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return [word(symptom).alias("symptom"), word(severity).alias("severity"), defaulted(service, DEFAULT_SERVICE).alias("service"), defaulted(id, DEFAULT_ALERT).alias("alert_id")]


@query(
    "alert_context",
    f"""select o_orderkey, lower(trim(o_orderpriority)) as symptom, case when o_orderstatus = 'F' then '' else lower(o_orderstatus) end as severity,
    case when o_custkey % 4 < 2 then '{DEFAULT_SERVICE}' else 'customer ' || o_custkey end as service, case when o_orderkey % 5 = 0 then '{DEFAULT_ALERT}' else 'A-' || o_orderkey end as alert_id from orders""",
)
def alert_context_query(spark, sf):
    service = F.when(F.col("o_custkey") % 4 == 0, F.lit(None)).when(F.col("o_custkey") % 4 == 1, "  ").otherwise(F.concat(F.lit(" customer "), F.col("o_custkey")))
    id = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("A-"), F.col("o_orderkey"), F.lit(" ")))
    severity = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit(" "), F.col("o_orderstatus")))
    return table(spark, sf, "orders").select("o_orderkey", *alert_context(F.concat(F.lit(" "), F.col("o_orderpriority")), severity, service, id))


def planned(rows: DataFrame) -> DataFrame:
    """Steps of the plan for (class, is_tight, ran_first): short when tight or for crashes, else with a check."""
    short = F.col("is_tight") & F.col("class").isin("cpu_spike", "fallback") | (F.col("class") == "crash_or_deploy")
    names = F.when(short, F.array(F.lit("retrieve_runbook"), F.lit("summarize_incident"))).otherwise(F.array(F.lit("retrieve_runbook"), F.lit("run_diagnostic"), F.lit("summarize_incident")))
    rows = rows.select("*", F.posexplode(names).alias("p", "name"))
    return rows.withColumn("step_id", F.concat(F.lit("step-"), F.col("p") + 1)).withColumn(
        "argument",
        F.when(F.col("name") == "run_diagnostic", F.when(F.col("ran_first"), FURTHER).otherwise(FIRST)).when(F.col("name") == "retrieve_runbook", F.when(F.col("class") == "crash_or_deploy", "crash").otherwise("cpu")),
    ).drop("p")


@query(
    "plan_steps",
    f"""with o as (select o_orderkey, case o_orderkey % 3 when 0 then 'crash_or_deploy' when 1 then 'cpu_spike' else 'fallback' end as class, o_orderkey % 2 = 0 as is_tight, o_orderkey % 5 < 2 as ran_first from orders),
    n as (select *, case when is_tight or class = 'crash_or_deploy' then ['retrieve_runbook', 'summarize_incident'] else ['retrieve_runbook', 'run_diagnostic', 'summarize_incident'] end as names from o),
    u as (select *, unnest(names) as name, generate_subscripts(names, 1) as p from n)
    select o_orderkey, 'step-' || p as step_id, name, case when name = 'run_diagnostic' then case when ran_first then '{FURTHER}' else '{FIRST}' end when name = 'retrieve_runbook' then case when class = 'crash_or_deploy' then 'crash' else 'cpu' end end as argument from u""",
)
def plan_steps(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k, F.when(k % 3 == 0, "crash_or_deploy").when(k % 3 == 1, "cpu_spike").otherwise("fallback").alias("class"), (k % 2 == 0).alias("is_tight"), (k % 5 < 2).alias("ran_first"))
    return planned(rows).select("o_orderkey", "step_id", "name", "argument")


def decided(loops: DataFrame) -> DataFrame:
    """After every loop: resolve when it was, escalate when no check is left unrun so far, else continue with the next one."""
    so_far = Window.partitionBy("run").orderBy("loop").rowsBetween(Window.unboundedPreceding, 0)
    ran = F.collect_set("command").over(so_far)
    left = F.array_except(F.array(F.lit(FIRST), F.lit(FURTHER)), F.col("ran"))
    rows = loops.withColumn("ran", ran)
    action = F.when(F.col("status") == "resolved", "resolve").when(F.size(left) == 0, "escalate").otherwise("continue")
    return rows.select("run", "loop", action.alias("action"), F.when(action == "continue", F.get(left, F.lit(0))).alias("next_check"))


DECIDED = f"""{STEPS}, ran as (select a.*, (select count(*) from assessed b where b.run = a.run and b.loop <= a.loop and b.command = '{FIRST}') > 0 as f, (select count(*) from assessed b where b.run = a.run and b.loop <= a.loop and b.command = '{FURTHER}') > 0 as g from assessed a),
decided as (select run, loop, case when status = 'resolved' then 'resolve' when f and g then 'escalate' else 'continue' end as action, case when status = 'resolved' or f and g then null when f then '{FURTHER}' else '{FIRST}' end as next_check from ran)"""


@query("decide", f"with {DECIDED} select * from decided")
def decide(spark, sf):
    return decided(assessed(_steps(spark, sf)))


#: Loops that a run may take.
MAX_LOOPS = 3


@query(
    "terminal_state",
    f"""with {DECIDED}, {GUARD(True).removeprefix(TRACE + ", ")}, each as (select run, loop, action, case when reason in ('ms', 'tokens') then reason || '_budget_exceeded' end as spent from decided join guard using (run, loop) where loop < {MAX_LOOPS}),
    z as (select run, min(loop) filter (action <> 'continue' or spent is not null) as stop, count(*) as n from each group by run)
    select z.run, case when spent is null and action = 'resolve' then 'resolved' else 'escalated' end as state, coalesce(stop + 1, n)::bigint as loops, coalesce(spent, action, 'max_loops_reached') as reason
    from z left join each e on e.run = z.run and e.loop = z.stop""",
)
def terminal_state(spark, sf):
    spent = guarded(trace(spark, sf), True).select("run", "loop", F.when(F.col("reason").isin("ms", "tokens"), F.concat("reason", F.lit("_budget_exceeded"))).alias("spent"))
    return terminal(decided(assessed(_steps(spark, sf))).join(spent, ["run", "loop"], "left"), MAX_LOOPS)


def terminal(decisions: DataFrame, max_loops: int) -> DataFrame:
    """Where each run ends: at the first loop that used up a budget, which comes before its decision, or decided to stop, or at the last loop allowed.

    ``spent`` names the budget that a loop used up, if any.
    """
    within = decisions.where(F.col("loop") < max_loops)
    stop = F.min(F.when((F.col("action") != "continue") | F.col("spent").isNotNull(), F.struct("loop", "action", "spent")))
    by = within.groupBy("run").agg(stop.alias("s"), F.count("*").alias("n"))
    state = F.when(F.col("s.spent").isNull() & (F.col("s.action") == "resolve"), "resolved").otherwise("escalated")
    return by.select("run", state.alias("state"), F.coalesce(F.col("s.loop") + 1, "n").alias("loops"), F.coalesce("s.spent", "s.action", F.lit("max_loops_reached")).alias("reason"))


def planned_again(loops: DataFrame, max_loops: int = MAX_LOOPS) -> DataFrame:
    """(run, loop, step_id, name, arguments, rationale, cites) of every loop's plan.

    Loops (run, loop, class, is_tight, alert_id, service, status, command, note)
    follow each other in a run, at most ``max_loops`` of them: earlier unresolved
    ones are cited, and the second check comes once the first was among theirs.
    """
    before = Window.partitionBy("run").orderBy("loop").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("status") == "unresolved"
    cite = F.concat(F.lit("loop-"), F.col("loop") + 1, F.lit(": "), F.col("note"))
    rows = loops.where(F.col("loop") < max_loops).withColumns({"cites": F.coalesce(F.collect_list(F.when(open_, cite)).over(before), F.array()), "ran_first": F.coalesce(F.max(open_ & (F.col("command") == FIRST)).over(before), F.lit(False))})
    # fixed values: the sentences of a rationale
    again = F.concat(F.lit("Prior loop was unresolved ("), F.array_join("cites", "; "), F.lit("); re-reading the runbook and running one further check."))
    first = F.concat(F.lit("First pass on "), F.col("alert_id"), F.lit(": "), F.col("class"), F.lit(" playbook."))
    steps = planned(rows.withColumn("rationale", F.when(F.size("cites") > 0, again).otherwise(first)))
    js = lambda *cols: F.to_json(F.struct(*cols))
    arguments = (
        F.when(F.col("name") == "retrieve_runbook", js(F.col("argument").alias("query"), F.lit(TOP_K).alias("top_k")))
        .when(F.col("name") == "run_diagnostic", js(F.col("argument").alias("command"), F.col("service").alias("host")))
        .otherwise(js("alert_id", F.array().cast("array<string>").alias("evidence")))
    )
    return steps.select("run", "loop", "step_id", "name", arguments.alias("arguments"), "rationale", F.size("cites").alias("cites"))


CLASS = "case run % 3 when 0 then 'crash_or_deploy' when 1 then 'cpu_spike' else 'fallback' end"


@query(
    "plan_details",
    f"""with {STEPS}, b as (select *, 'A-' || run as alert_id, 'service-' || run as service, {CLASS} as class, run % 5 = 4 as is_tight, {NOTE} as note from assessed where loop < {MAX_LOOPS}),
    c as (select b.*, (select string_agg('loop-' || (x.loop + 1) || ': ' || x.note, '; ' order by x.loop) from b x where x.run = b.run and x.loop < b.loop and x.status = 'unresolved') as cited,
      (select count(*) from b x where x.run = b.run and x.loop < b.loop and x.status = 'unresolved') as cites, (select count(*) from b x where x.run = b.run and x.loop < b.loop and x.status = 'unresolved' and x.command = '{FIRST}') > 0 as ran_first from b),
    n as (select *, case when is_tight or class = 'crash_or_deploy' then ['retrieve_runbook', 'summarize_incident'] else ['retrieve_runbook', 'run_diagnostic', 'summarize_incident'] end as names from c),
    u as (select *, unnest(names) as name, generate_subscripts(names, 1) as p from n)
    select run, loop, 'step-' || p as step_id, name, case name when 'retrieve_runbook' then '{{"query":"' || case when class = 'crash_or_deploy' then 'crash' else 'cpu' end || '","top_k":{TOP_K}}}'
      when 'run_diagnostic' then '{{"command":"' || case when ran_first then '{FURTHER}' else '{FIRST}' end || '","host":"' || service || '"}}' else '{{"alert_id":"' || alert_id || '","evidence":[]}}' end as arguments,
    coalesce('Prior loop was unresolved (' || cited || '); re-reading the runbook and running one further check.', 'First pass on ' || alert_id || ': ' || class || ' playbook.') as rationale, cites::int as cites from u""",
)
def plan_details(spark, sf):
    loops = assessed(_steps(spark, sf))
    loops = loops.join(noted(loops).select("run", "loop", "note"), ["run", "loop"])
    kind = F.when(F.col("run") % 3 == 0, "crash_or_deploy").when(F.col("run") % 3 == 1, "cpu_spike").otherwise("fallback")
    return planned_again(loops.select("*", kind.alias("class"), (F.col("run") % 5 == 4).alias("is_tight"), F.concat(F.lit("A-"), F.col("run")).alias("alert_id"), F.concat(F.lit("service-"), F.col("run")).alias("service")))


def route(uri: Column) -> Column:
    """Name of the store that a memory address leads to; null for an unknown one."""
    alias = F.regexp_replace(uri, "^memory://memory/deltas", "memory://deltas/recent")
    return (
        F.when(alias.startswith("memory://incidents/"), "incidents").when(alias.startswith("memory://evidence/"), "evidence").when(alias.startswith("memory://deltas/recent"), "deltas")
        .when(alias == "memory://plans/current", "plan").when(alias == "memory://alerts/latest", "alert").when(alias == "memory://runbooks/index", "runbooks")
    )


ADDRESSES = ("memory://incidents/1", "memory://evidence/2", "memory://memory/deltas", "memory://deltas/recent?cursor=4", "memory://plans/current", "memory://alerts/latest", "memory://runbooks/index", "memory://other")


@query("memory_get", "select * from (values " + ", ".join(f"('{a}', {r})" for a, r in zip(ADDRESSES, ("'incidents'", "'evidence'", "'deltas'", "'deltas'", "'plan'", "'alert'", "'runbooks'", "null"), strict=True)) + ") v(uri, store)")
def memory_get(spark, sf):
    return spark.createDataFrame([(a,) for a in ADDRESSES], "uri string").select("uri", route(F.col("uri")).alias("store"))


def upserted(updates: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """The latest value of every field by key, over the updates (a map of texts) that name it; a null that is named counts."""
    picks = []
    for f in fields:
        there = F.map_contains_key("fields", f)
        picks.append(F.max(F.when(there, F.struct(F.col(seq), F.element_at("fields", f).alias("v"))))["v"].alias(f))
    return updates.groupBy(key).agg(*picks)


@query(
    "incident_upsert",
    """with u as (select user_id, event_id, event_type as title, case when event_id % 4 = 0 then null else event_type end as severity, event_id % 3 <> 1 as has_title, event_id % 2 = 0 as has_severity from events),
    t as (select user_id, max(event_id) filter (has_title) as t, max(event_id) filter (has_severity) as s from u group by user_id)
    select t.user_id, a.title, b.severity from t left join u a on a.event_id = t.t left join u b on b.event_id = t.s""",
)
def incident_upsert(spark, sf):
    e = table(spark, sf, "events")
    title = F.when(F.col("event_id") % 3 != 1, F.create_map(F.lit("title"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))
    severity = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("severity"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")))).otherwise(F.create_map().cast("map<string,string>"))
    return upserted(e.select("user_id", "event_id", F.map_concat(title, severity).alias("fields")), "user_id", "event_id", ["title", "severity"])


@query("evidence_latest", "select conv_id, arg_max(text, turn) as content, count(*) as n from conversations group by conv_id")
def evidence_latest(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("content"), F.count("*").alias("n"))


@query("first_result", "select conv_id, arg_min(text, turn) filter (role = 'assistant') as first_result from conversations group by conv_id")
def first_result(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_result"))


# Requests: JSON texts of an event log, made from the events table.


def requests(spark, sf) -> DataFrame:
    """(req, raw): one JSON-RPC request an event, of ten kinds, good and bad."""
    e = F.col("event_id")
    def call(args: str, id_: str = "%d") -> Column:
        return F.format_string('{"jsonrpc":"2.0","id":' + id_ + ',"method":"callTool","params":{"name":"retrieve_runbook","arguments":' + args + '}}', e)
    kinds = [
        call('{"query":"cpu"}'), call('{"query":"cpu","top_k":"2"}'), call('{"query":"cpu","top_k":true}'), call('{"query":"cpu","top_k":6}'), call('{"top_k":2}'),
        F.lit("{not json"), F.lit("[1]"), F.format_string('{"jsonrpc":"1.0","id":%d,"method":"initialize"}', e),
        F.format_string('{"jsonrpc":"2.0","id":%d,"method":"nothing"}', e), F.format_string('{"jsonrpc":"2.0","id":%d,"method":"initialize","params":"bad_string"}', e),
    ]
    raw = F.element_at(F.array(*kinds), (e % len(kinds) + 1).cast("int"))
    return table(spark, sf, "events").select(e.alias("req"), raw.alias("raw"))


def field_type(json: Column, path: str) -> Column:
    """JSON type of a field: string, integer, boolean, array, object, other, or null where it is missing."""
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind.isNotNull(), "other")


def argument_errors(arguments: Column, tool: str) -> Column:
    """Errors of a call's arguments, as ``field: message`` in order of the fields; unknown fields do not matter."""
    errors = []
    for t, field, kind, required, low, high in FIELDS:
        if t != tool:
            continue
        have = field_type(arguments, f"$.{field}")
        value = F.try_variant_get(F.try_parse_json(arguments), f"$.{field}", "long")
        e = F.when(have.isNull(), F.lit(f"{field}: Missing required field") if required else F.lit(None)).when(have != kind, f"{field}: Expected {kind}")
        e = e.when(value < low, f"{field}: Must be >= {low}") if low is not None else e
        e = e.when(value > high, f"{field}: Must be <= {high}") if high is not None else e
        errors.append(e)
    return F.array_compact(F.array(*errors))


@query(
    "validate_arguments",
    """select event_id as req, case event_id % 10 when 1 then 'top_k: Expected integer' when 2 then 'top_k: Expected integer' when 3 then 'top_k: Must be <= 5' when 4 then 'query: Missing required field' else '' end as errors
    from events where event_id % 10 < 5""",
)
def validate_arguments(spark, sf):
    rows = requests(spark, sf).withColumn("a", F.get_json_object("raw", "$.params.arguments")).where("a is not null")
    return rows.select("req", F.array_join(argument_errors(F.col("a"), "retrieve_runbook"), "; ").alias("errors"))


METHODS = ("initialize", "getResource", "callTool")


def outcome(rows: DataFrame, budget: Column, harness: bool = False) -> DataFrame:
    """(req, code, is_logged): how a session answers each raw request, by the first rule that holds.

    A harness session answers every error with one code and neither validates
    nor checks budgets.
    """
    v = F.try_parse_json("raw")
    rows = rows.withColumns(
        {
            "_o": F.schema_of_variant(v).startswith("OBJECT"),
            "_v": F.get_json_object("raw", "$.jsonrpc"),
            "_m": F.get_json_object("raw", "$.method"),
            "_p": field_type(F.col("raw"), "$.params"),
            "_bad": v.isNull(),
            "_e": F.size(argument_errors(F.coalesce(F.get_json_object("raw", "$.params.arguments"), F.lit("{}")), "retrieve_runbook")) > 0,
        }
    )
    known = F.col("_m").isin(*METHODS)
    if harness:
        code = F.when(F.col("_bad") | ~F.col("_o") | F.col("_m").isNull() | ~known, -32601)
    else:
        code = (
            F.when(F.col("_bad"), -32700).when(~F.col("_o") | (F.coalesce("_v", F.lit("")) != "2.0") | F.col("_m").isNull(), -32600)
            .when(F.col("_p").isNotNull() & (F.col("_p") != "object"), -32602).when(~known, -32601)
            .when((F.col("_m") == "callTool") & (budget <= 0), -32000).when((F.col("_m") == "callTool") & F.col("_e"), -32602)
        )
    code = F.coalesce(code, F.lit(0))
    logged = ~(F.col("_bad") | ~F.coalesce("_o", F.lit(False)) | (F.coalesce("_v", F.lit("")) != "2.0") | F.col("_m").isNull() | (F.col("_p").isNotNull() & (F.col("_p") != "object")))
    return rows.select("req", code.alias("code"), logged.alias("is_logged"))


@query(
    "rpc_outcome",
    """select event_id as req, case event_id % 10 when 5 then -32700 when 6 then -32600 when 7 then -32600 when 8 then -32601 when 9 then -32602
    else case when event_id % 7 = 0 then -32000 when event_id % 10 = 0 then 0 else -32602 end end as code, event_id % 10 not in (5, 6, 7, 9) as is_logged from events""",
)
def rpc_outcome(spark, sf):
    return outcome(requests(spark, sf), F.col("req") % 7)


@query("rpc_outcome_harness", "select event_id as req, case when event_id % 10 in (5, 6, 8) then -32601 else 0 end as code from events")
def rpc_outcome_harness(spark, sf):
    return outcome(requests(spark, sf), F.lit(1), harness=True).select("req", "code")


@query(
    "rpc_pairing",
    """with q as (select event_id as id, ts from events where event_id % 2 = 0), r as (select event_id - 1 as id, ts from events where event_id % 2 = 1)
    select q.id, case when r.id is null then 'missing' when epoch_us(r.ts) - epoch_us(q.ts) > 10000000 then 'timeout' else 'ok' end as outcome from q left join r using (id)""",
)
def rpc_pairing(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return paired(e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("us").alias("sent")), e.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("id"), F.col("us").alias("got")), 10_000_000)


def paired(asked: DataFrame, answered: DataFrame, limit_us: int) -> DataFrame:
    """Requests with their responses: answered in time, late, or not at all."""
    return asked.join(answered, "id", "left").select("id", F.when(F.col("got").isNull(), "missing").when(F.col("got") - F.col("sent") > limit_us, "timeout").otherwise("ok").alias("outcome"))


def checked(exchanges: DataFrame, limit_us: int) -> DataFrame:
    """(id, outcome, result) of exchanges (id, method, sent, got, raw), the answer as it came, by the first rule that holds.

    ``timeout``: none came, or too late; ``malformed``: no JSON; ``missing_id``;
    ``id_mismatch``; ``error``: it names one; ``missing_result``: null counts as none.
    """
    v = F.try_parse_json("raw")
    id_ = F.get_json_object("raw", "$.id")
    keys = F.coalesce(F.json_object_keys("raw"), F.array())
    rows = exchanges.withColumns({"_bad": v.isNull(), "_id": id_, "_k": keys, "_r": F.get_json_object("raw", "$.result")})
    outcome = (
        F.when(F.col("got").isNull() | (F.col("got") - F.col("sent") > limit_us), "timeout").when(F.col("_bad"), "malformed").when(~F.array_contains("_k", "id"), "missing_id")
        .when(~F.col("_id").eqNullSafe(F.col("id").cast("string")), "id_mismatch").when(F.array_contains("_k", "error"), "error").when(F.col("_r").isNull(), "missing_result").otherwise("ok")
    )
    return rows.select("id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("_r")).alias("result"))


@query(
    "rpc_checks",
    """with q as (select event_id as id, ts, event_type from events where event_id % 2 = 0), r as (select event_id - 1 as id, ts, event_type, props, floor(value)::bigint % 10 as kind from events where event_id % 2 = 1),
    j as (select q.id, r.id as rid, epoch_us(r.ts) - epoch_us(q.ts) > 60000000 as late, r.event_type as t, kind, props from q left join r using (id)),
    o as (select *, case when rid is null or late then 'timeout' when kind = 5 then 'malformed' when kind = 4 then 'missing_id' when kind = 3 then 'id_mismatch' when t = 'error' then 'error' when kind = 6 then 'missing_result' else 'ok' end as outcome from j)
    select id, outcome, case when outcome = 'ok' then '{"k":' || (props->>'$.k') || '}' end as result from o""",
)
def rpc_checks(spark, sf):
    """Each even event asks, the next one answers: with its properties, or in one of the ways in which an answer fails."""
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    kind, id_ = F.floor("value").cast("long") % 10, F.col("event_id") - 1
    result = F.concat(F.lit('"result":{"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    body = F.when(F.col("event_type") == "error", F.lit('"error":{"code":1}')).when(kind == 6, F.lit('"result":null')).otherwise(result)
    raw = F.when(kind == 5, F.lit("{oops")).when(kind == 4, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit('{"id":'), F.when(kind == 3, id_ + 1).otherwise(id_), F.lit(","), body, F.lit("}")))
    answers = e.where("event_id % 2 = 1").select(id_.alias("id"), F.col("us").alias("got"), raw.alias("raw"))
    asked = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("method"), F.col("us").alias("sent"))
    return checked(asked.join(answers, "id", "left"), 60_000_000)
