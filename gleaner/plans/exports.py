"""Queries that run the export, the training format and the scorers' input rules over traces made of ``customer``: the key
chooses a trace's case, and a case stands beside what must become of it, so the SQL follows from the same list."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import evaluation as ev
from gleaner.operators import export as ex
from gleaner.operators import formats as fm
from gleaner.operators import home_expectations as he
from gleaner.operators import inventory as iv
from gleaner.operators import schemas as sc
from gleaner.operators import training as tn
from gleaner.operators import traces as tr
from gleaner.operators.records import CATALOG_MARK
from gleaner.plans.conversations import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tool(name: str, properties: dict, required: list[str]) -> dict:
    return {"type": "function", "function": {"name": name, "parameters": {"type": "object", "properties": properties, "required": required}}}


WEATHER = _tool("get_weather", {"lang": {"type": "string", "enum": ["zh", "en"]}, "place": {"type": "string"}, "days": {"type": "integer"}}, ["lang"])
SWITCH = _tool("hass_set_state", {"entity_id": {"type": "string"}, "state": {"type": "object", "required": ["type"], "properties": {"type": {"type": "string", "enum": ["turn_on", "turn_off"]}}}}, ["entity_id", "state"])
LOCAL = _tool("local_only", {}, [])
TARGET = json.dumps([WEATHER, SWITCH])


def say(role: str, content: str | None = None, calls: list | None = None, answers: str | None = None) -> dict:
    made = [{"id": i, "type": "function", "function": {"name": n, "arguments": a}} for i, n, a in calls] if calls else None
    return {"role": role, "content": content, "tool_calls": made, "tool_call_id": answers}


def trace(name: str = "get_weather", arguments: str = '{"place": "c{g}", "lang": "zh"}', call: str = "x9", system: str = "old prompt") -> list[dict]:
    return [say("system", system), say("user", "weather {g}?"), say("assistant", None, [(call, name, arguments)]), say("tool", "sunny {g}", None, call), say("assistant", "It is sunny in c{g}.")]


def put(k: int, message: dict, messages: list[dict] | None = None) -> list[dict]:
    out = list(messages or trace())
    out[k] = message
    return out


def case(reason: str | None = None, messages: list[dict] | None = None, failed: bool = False, complete: bool = True, internal: list[int] | None = None, tools=(WEATHER, LOCAL), checks: list | None = None, seed: str = "s{n}",
         scenario: str = "weather", catalog: str | None = None, review: tuple | None = None, need: bool = False, score: str | None = None, turns=("weather {g}?",), plain: bool = False) -> dict:
    status = "fail" if failed else "pass"
    checks = [("1:C01", status, [(3, "sunny")])] if checks is None else checks
    made = [{"key": k, "status": s, "evidence": [{"message_index": i, "quote": q} for i, q in e]} for k, s, e in checks]
    return {
        "reason": reason, "failed": failed, "scenario": scenario, "review": review, "plain": plain, "row": {
            "messages": messages or trace(), "context": {"trace_complete": complete, "internal_message_indices": internal, "system_prompt_sha256": None, "public_catalog": catalog},
            "seed": {"seed_id": "s{n}", "template_id": "S01", "user_turns": list(turns)}, "tools": json.dumps(list(tools)) if tools is not None else None,
            "score": {"seed_id": seed, "template_id": "S01", "status": score or status, "checks": made}, "expected": ["1:C01"], "require_review": need,
        }}


_HOME = json.dumps([{"entity_id": "light.{g}", "name": "灯", "controllable": True}], ensure_ascii=False)
#: Cases by the customer's key modulo their number. ``plain`` cases pass with equal rows inside a group of customers.
CASES = [
    case(plain=True),
    case(messages=trace(call="other"), plain=True),
    case("incomplete_trace", complete=False),
    case("runtime_injected_messages", internal=[1]),
    case("missing_initial_system", messages=trace()[1:], checks=[("1:C01", "pass", [(2, "sunny")])]),
    case("invalid_system", messages=put(0, say("system"))),
    case("invalid_message_role", messages=put(1, say("robot", "weather {g}?"))),
    case("missing_tool_response", messages=[*trace()[:3], *trace()[4:]], checks=[("1:C01", "pass", [(3, "sunny")])]),
    case("invalid_user_order", messages=[*trace()[:4], say("user", "again"), trace()[4]]),
    case("invalid_assistant_order", messages=[*trace(), say("assistant", "more")]),
    case("invalid_tool_calls", messages=put(1, say("user", "weather {g}?", [("q", "get_weather", '{"lang":"zh"}')]))),
    case("duplicate_or_missing_tool_id", messages=[*trace()[:4], say("assistant", None, [("x9", "get_weather", '{"lang":"en"}')])]),
    case("empty_message", messages=put(4, say("assistant", ""))),
    case("orphan_or_duplicate_tool_response", messages=put(3, say("tool", "sunny {g}", None, "nobody"))),
    case("unfinished_conversation", messages=trace()[:4]),
    case("user_turns_mismatch", turns=("other",)),
    case("unknown_tool", messages=trace("invented")),
    case(None, messages=trace("invented"), failed=True),
    case("arguments_not_integer", messages=trace(arguments='{"lang":"zh","days":true}')),
    case("arguments_invalid_enum", messages=trace(arguments='{"lang":"xx"}')),
    case("target_tool_incompatible:tool_missing_from_target_list", messages=trace("local_only", "{}")),
    case("missing_home_tool_snapshot", tools=None, scenario="home_switch"),
    case("invalid_tool_definitions", tools=({"type": "other"},)),
    case("duplicate_or_missing_tool_name", tools=(WEATHER, WEATHER)),
    case("score_identity_mismatch", seed="else"),
    case("incomplete_or_duplicate_score_checks", checks=[]),
    case("unresolved_score", checks=[("1:C01", "error", [(3, "sunny")])]),
    case("score_without_evidence", checks=[("1:C01", "pass", [])]),
    case("invalid_score_evidence", checks=[("1:C01", "pass", [(9, "sunny")])]),
    case("stale_score_evidence", checks=[("1:C01", "pass", [(3, "rain")])]),
    case("inconsistent_score_status", failed=True, score="pass"),
    case("missing_evidence_review", need=True),
    case("evidence_review:guess", review=("quarantine", "guess")),
    case("missing_evidence_review_reason", review=("accept", " ")),
    case("invalid_evidence_review_decision", review=("maybe", "x")),
    case(plain=True, review=("accept", "fine"), need=True),
    case("missing_visible_catalog", scenario="home_switch", catalog="[]"),
    case("catalog_mismatch", scenario="home_switch", messages=trace(system=f"old {CATALOG_MARK}{_HOME}"), catalog="[]"),
    case(None, scenario="home_switch", messages=trace(system=f"old {CATALOG_MARK}{_HOME}"), catalog=_HOME),
    case(plain=True, checks=[("1:C01", "pass", [(2, '"name": "get_weather"')])]),
]
N = len(CASES)
ROW = f"struct<messages:{tr.MESSAGES},context:{ex.CONTEXT},seed:{ex.SEED},tools:string,score:{ex.SCORE},expected:array<string>,require_review:boolean>"
#: So many customers tell of the same place.
GROUP = 3 * N


def _choose(values: list) -> Column:
    """The value of a row's case; null where the case has none."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("n") % N).cast("int"))


def entries(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.expr(f"c_custkey div {GROUP}").cast("string").alias("g"))
    text = F.replace(F.replace(_choose([json.dumps(x["row"], ensure_ascii=False) for x in CASES]), F.lit("{n}"), F.col("n").cast("string")), F.lit("{g}"), F.col("g"))
    e = c.withColumn("scenario", _choose([x["scenario"] for x in CASES])).withColumn("x", F.from_json(text, ROW))
    e = e.select(F.concat_ws(":", "scenario", F.lpad(F.col("n").cast("string"), 9, "0")).alias("id"), "n", "g", F.lpad(F.col("n").cast("string"), 9, "0").alias("sample_id"), "scenario", "x.*")
    return e.withColumn("tools", sc.definitions(F.col("tools")))


def exported(spark, d) -> DataFrame:
    e = entries(spark, d)
    decision, why = (_choose([x["review"][k] if x["review"] else None for x in CASES]) for k in (0, 1))
    reviews = e.select("id", decision.alias("decision"), why.alias("reason"), ex.sample_digest(e).alias("source_sample_sha256")).where("decision IS NOT NULL")
    return ex.export(e, TARGET, "new prompt\n", reviews)


def _sql_case(values: list) -> str:
    parts = " ".join(f"WHEN {k} THEN '" + str(v).replace("'", "''") + "'" for k, v in enumerate(values) if v is not None)
    return f"CASE c_custkey % {N} {parts} END"


EXPORTED = f"""k AS (SELECT c_custkey, c_custkey // {GROUP} AS g, lpad(c_custkey::VARCHAR, 9, '0') AS sample_id, {_sql_case([x['scenario'] for x in CASES])} AS scenario, {_sql_case([x['reason'] for x in CASES])} AS reason,
  {_sql_case([1 if x['failed'] else None for x in CASES])} IS NOT NULL AS failed, {_sql_case([1 if x['plain'] else None for x in CASES])} IS NOT NULL AS plain FROM customer),
 r AS (SELECT *, scenario || ':' || sample_id AS id, CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN failed THEN 'failed_sample' ELSE 'passed_sample' END AS route,
   CASE WHEN plain THEN 'plain ' || g WHEN scenario = 'home_switch' THEN 'home ' || g ELSE id END AS digest FROM k),
 f AS (SELECT *, min(id) FILTER (WHERE route = 'passed_sample') OVER (PARTITION BY digest) AS low FROM r),
 e AS (SELECT *, CASE WHEN route = 'passed_sample' AND id <> low THEN 'duplicate' ELSE route END AS disposition, CASE WHEN route = 'passed_sample' AND id <> low THEN low END AS duplicate_of FROM f)"""


@query(f"WITH {EXPORTED} SELECT id, scenario, reason, disposition, duplicate_of FROM e")
def prj_export(spark, d):
    return exported(spark, d).select("id", "scenario", "reason", "disposition", "duplicate_of")


@query(f"""WITH {EXPORTED} SELECT scenario, count(*) AS rows, count(*) FILTER (WHERE disposition = 'passed_sample') AS passed_sample, count(*) FILTER (WHERE disposition = 'failed_sample') AS failed_sample,
  count(*) FILTER (WHERE disposition = 'duplicate') AS duplicate, count(*) FILTER (WHERE disposition = 'quarantine') AS quarantine, true AS sound FROM e GROUP BY 1""")
def agg_export_counts(spark, d):
    return ex.disposition_problem(exported(spark, d))


@query(f"""WITH {EXPORTED} SELECT c_custkey AS n, 'call_1' AS call_id, '{{"lang":"zh","place":"c' || g || '"}}' AS arguments, 'call_1' AS answers, 'user,assistant,tool,assistant' AS roles FROM e WHERE plain""")
def prj_normalize_messages(spark, d):
    e = entries(spark, d).where(F.array_contains(F.array(*[F.lit(k) for k, x in enumerate(CASES) if x["plain"]]), (F.col("n") % N).cast("int")))
    m = tr.normalized(F.col("messages"))
    call = F.get(F.get(F.col("m"), F.lit(1))["tool_calls"], F.lit(0))
    return e.select("n", m.alias("m")).select("n", call["id"].alias("call_id"), call["function"]["arguments"].alias("arguments"), F.get("m", F.lit(2))["tool_call_id"].alias("answers"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query(f"WITH {EXPORTED} SELECT id, CASE WHEN scenario = 'home_switch' AND reason = 'missing_home_tool_snapshot' THEN 'missing_snapshot' ELSE 'saved_trace' END AS provenance FROM e")
def prj_tool_provenance(spark, d):
    e = entries(spark, d)
    return e.select("id", tr.tool_provenance(F.col("scenario"), F.coalesce(F.size("tools") > 0, F.lit(False))).alias("provenance"))


_STRUCTURE = ["incomplete_trace", "runtime_injected_messages", "missing_initial_system", "invalid_system", "invalid_message_role", "missing_tool_response", "invalid_user_order", "invalid_assistant_order", "invalid_tool_calls",
              "duplicate_or_missing_tool_id", "empty_message", "orphan_or_duplicate_tool_response", "unfinished_conversation", "user_turns_mismatch"]


@query(f"WITH {EXPORTED} SELECT c_custkey AS n, CASE WHEN reason IN ({', '.join(repr(x) for x in _STRUCTURE)}) THEN reason END AS reason FROM e")
def flt_trace_structure(spark, d):
    e = entries(spark, d)
    state = tr.trace_state(F.col("messages"), F.col("context"), F.col("seed.user_turns"), F.col("tools"), F.lit(False))
    return e.select("n", state["reason"].alias("reason"))


_DEFINITIONS = ["missing_home_tool_snapshot", "invalid_tool_definitions", "duplicate_or_missing_tool_name"]


@query(f"WITH {EXPORTED} SELECT c_custkey AS n, CASE WHEN reason IN ({', '.join(repr(x) for x in _DEFINITIONS)}) THEN reason END AS reason FROM e")
def flt_tool_definitions(spark, d):
    return entries(spark, d).select("n", sc.definition_problem(F.col("tools")).alias("reason"))


_SCORES = ["score_identity_mismatch", "incomplete_or_duplicate_score_checks", "unresolved_score", "score_without_evidence", "invalid_score_evidence", "stale_score_evidence", "inconsistent_score_status"]


@query(f"""WITH {EXPORTED} SELECT c_custkey AS n, CASE WHEN reason IN ({', '.join(repr(x) for x in _SCORES)}) THEN reason END AS reason FROM e""")
def flt_score_integrity(spark, d):
    return entries(spark, d).select("n", ex.score_code(F.col("score"), F.col("expected"), F.col("seed"), F.col("messages")).alias("reason"))


@query(f"WITH {EXPORTED} SELECT c_custkey AS n, CASE WHEN reason = 'unknown_tool' OR failed AND reason IS NULL THEN 'invented:tool_missing_from_target_list' WHEN reason LIKE 'target%' THEN 'local_only:tool_missing_from_target_list' "
       "WHEN reason = 'arguments_not_integer' OR reason = 'arguments_invalid_enum' THEN 'get_weather:' || reason ELSE '' END AS issues FROM e")
def flt_target_compat(spark, d):
    target = F.from_json(F.lit(spark.range(1).select(F.to_json(sc.definitions(F.lit(TARGET)))).first()[0]), sc.TOOLS)
    issues = ex.target_issues(F.col("messages"), target)
    return entries(spark, d).select("n", F.array_join(F.transform(issues, lambda i: F.concat_ws(":", i["tool"], i["reason"])), ",").alias("issues"))


@query(f"WITH {EXPORTED} SELECT id, CASE WHEN reason IN ('missing_evidence_review', 'evidence_review:guess', 'missing_evidence_review_reason', 'invalid_evidence_review_decision') THEN reason END AS reason FROM e")
def flt_evidence_review(spark, d):
    e = entries(spark, d)
    decision, why = (_choose([x["review"][k] if x["review"] else None for x in CASES]) for k in (0, 1))
    review = F.when(decision.isNotNull(), F.struct(decision.alias("decision"), why.alias("reason"), ex.sample_digest(e).alias("source_sample_sha256")))
    return e.select("id", ex.review_code(review, ex.sample_digest(e), F.col("require_review")).alias("reason"))


@query(f"""WITH {EXPORTED}, s AS (SELECT scenario, CASE WHEN reason = 'missing_initial_system' THEN 1 WHEN reason = 'invalid_user_order' THEN 2 WHEN reason = 'invalid_message_role' THEN 0 WHEN reason = 'runtime_injected_messages' THEN 0 ELSE 1 END AS turns FROM e)
  SELECT coalesce(scenario, 'all') AS scenario, count(*) AS samples, count(*) FILTER (WHERE turns = 1) AS single_turn, count(*) FILTER (WHERE turns > 1) AS multi_turn, count(*) FILTER (WHERE turns = 0) AS zero_turn FROM s GROUP BY GROUPING SETS ((scenario), ())""")
def agg_structure(spark, d):
    return iv.structure(entries(spark, d))


@query(f"""WITH {EXPORTED}, c AS (SELECT scenario, CASE WHEN reason IN ('invalid_tool_calls', 'duplicate_or_missing_tool_id') THEN 2 ELSE 1 END AS v FROM e)
  SELECT coalesce(scenario, 'all') AS scenario, 'calls' AS measure, count(v) AS count, min(v) AS min, median(v) AS median, quantile_disc(v, 0.9)::DOUBLE AS p90, max(v) AS max FROM c GROUP BY GROUPING SETS ((scenario), ())""")
def agg_inventory(spark, d):
    return iv.lengths(entries(spark, d)).where("measure = 'calls'")


@query(f"WITH {EXPORTED} SELECT c_custkey AS n, CASE WHEN reason IN ('orphan_or_duplicate_tool_response') THEN 'x9:open' WHEN reason IN ('missing_tool_response') THEN 'x9:open' WHEN reason = 'duplicate_or_missing_tool_id' THEN 'x9:ok,x9:ok' "
       f"WHEN reason = 'invalid_tool_calls' THEN 'q:open,x9:ok' WHEN c_custkey % {N} = 1 THEN 'other:ok' ELSE 'x9:ok' END AS links FROM e")
def jn_call_result(spark, d):
    e = entries(spark, d).select(F.col("n").alias("sample_id"), "messages")
    calls = tr.calls_of(e).select("sample_id", "call_number", "call_id", F.col("message_index").alias("at"))
    answers = tr.messages_of(e).where("role = 'tool'").select("sample_id", F.col("tool_call_id").alias("call_id"), F.lit(True).alias("answered")).distinct()
    j = calls.join(answers, ["sample_id", "call_id"], "left")
    link = F.concat_ws(":", "call_id", F.when(F.col("answered"), "ok").otherwise("open"))
    return j.groupBy(F.col("sample_id").alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("call_number", link.alias("l")))), lambda x: x["l"]), ",").alias("links"))


@query(f"WITH {EXPORTED} SELECT c_custkey AS n, sha256('[{{\"id\": \"x9\", \"type\": \"function\", \"function\": {{\"name\": \"get_weather\", \"arguments\": \"{{\\\"place\\\": \\\"c' || g || '\\\", \\\"lang\\\": \\\"zh\\\"}}\"}}}}]') AS quote, 'sunny ' || g AS answer FROM e WHERE c_custkey % {N} = 0")
def chk_evidence(spark, d):
    e = entries(spark, d).where(f"n % {N} = 0")
    found = ex.evidence(F.col("messages"), F.array(F.lit(2), F.lit(3), F.lit(2)))
    return e.select("n", found.alias("e")).select("n", F.sha2(F.get("e", F.lit(0))["quote"], 256).alias("quote"), F.get("e", F.lit(1))["quote"].alias("answer"))


# ---- training format ----

LINES = [json.dumps(WEATHER), json.dumps(SWITCH)]


def training_rows(spark, d) -> DataFrame:
    """Normalised passing rows with their rendering."""
    x = exported(spark, d).where("disposition = 'passed_sample'").select(F.col("id").alias("row_index"), "messages", F.array(*map(F.lit, LINES)).alias("tools"))
    return x.withColumn("rendered", tn.render(F.col("messages"), F.col("tools")))


_CALLED = "'<tool_call>' || chr(10) || '<function=get_weather>' || chr(10) || '<parameter=place>' || chr(10) || 'c' || g || chr(10) || '</parameter>' || chr(10) || '<parameter=lang>' || chr(10) || 'zh' || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>'"
_HEAD = "'" + f"<|im_start|>system\n{tn.TOOLS_HEAD}\n{LINES[0]}\n{LINES[1]}{tn.TOOLS_TAIL}\n\nnew prompt".replace("'", "''") + "'"
_CATALOG = "' [{\"entity_id\": \"light.' || g || '\", \"name\": \"灯\", \"controllable\": true}]'"
_RENDERED = f"""x AS (SELECT *, {_HEAD} || CASE WHEN scenario = 'home_switch' THEN chr(10) || chr(10) || '{CATALOG_MARK}' || substr({_CATALOG}, 2) ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'weather ' || g || '?<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || {_CALLED} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || 'sunny ' || g || chr(10) || '</tool_response><|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || 'It is sunny in c' || g || '.<|im_end|>' || chr(10) AS rendered FROM e WHERE disposition = 'passed_sample')"""


@query(f"WITH {EXPORTED}, {_RENDERED} SELECT id AS row_index, sha256(rendered) AS rendered FROM x")
def fmt_render_tools(spark, d):
    return training_rows(spark, d).select("row_index", F.sha2("rendered", 256).alias("rendered"))


@query(f"WITH {EXPORTED} SELECT id AS row_index, CASE c_custkey % 3 WHEN 1 THEN 'tool_argument_value_mismatch' WHEN 2 THEN 'assistant_content_mismatch' END AS problem FROM e WHERE disposition = 'passed_sample'")
def fmt_verify_render(spark, d):
    n = F.substring_index("row_index", ":", -1).cast("long") % 3
    changed = F.when(n == 1, F.replace("rendered", F.lit("=lang>\nzh"), F.lit("=lang>\nen"))).when(n == 2, F.replace("rendered", F.lit("</think>\n\nIt is"), F.lit("</think>\n\nIt was"))).otherwise(F.col("rendered"))
    return training_rows(spark, d).select("row_index", tn.render_problem(changed, F.col("messages"), F.col("tools")).alias("problem"))


@query("""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '<think>' || text ELSE text END AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(t, '<|im_start|>') OR contains(t, '<|im_end|>') OR contains(t, '<|endoftext|>') THEN 'raw_chat_control_marker' WHEN contains(t, '<think>') OR contains(t, '</think>') THEN 'reasoning_data_requires_separate_policy' END AS problem FROM w""")
def flt_reasoning(spark, d):
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<think>"), "text")).otherwise(F.col("text"))
    null = F.lit(None)
    message = F.struct(F.lit("assistant").alias("role"), t.alias("content"), null.cast(tr.CALLS).alias("tool_calls"), null.cast("string").alias("tool_call_id"))
    return table(spark, d, "documents").select("doc_id", tn.input_problem(F.array(message), F.array(F.lit("{}"))).alias("problem"))


@query("""SELECT p_partkey AS row_index, CASE p_partkey % 4 WHEN 1 THEN 'trainer_changed_labels' WHEN 2 THEN 'padding_contributes_to_loss' END AS problem FROM part WHERE p_partkey % 4 IN (1, 2)""")
def fmt_batch_check(spark, d):
    p, n = table(spark, d, "part"), F.col("p_partkey") % 4
    f = p.select(F.col("p_partkey").alias("row_index"), F.expr("p_partkey div 8").alias("batch"), F.transform(F.sequence(F.lit(1), F.col("p_size") % 7 + 1), lambda x: x.cast("long")).alias("input_ids"))
    f = f.withColumn("labels", F.col("input_ids")).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1).cast("long")))
    batch = fm.pad(f.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(0).cast("long")))).withColumn("labels", F.concat("labels", F.array(F.lit(-100).cast("long")))), "batch").withColumn("n", F.col("row_index") % 4)
    size = F.size("labels")
    labels = F.when(F.col("n") == 1, F.transform("labels", lambda _: F.lit(-7).cast("long"))).when(F.col("n") == 2, F.concat(F.slice("labels", 1, size - 1), F.array(F.lit(5).cast("long")))).otherwise(F.col("labels"))
    return tn.batch_problems(batch.withColumn("labels", labels), f.select("row_index", "input_ids", "attention_mask", "labels"))


# ---- scorers' input ----


def _talk(kind: str) -> list[dict]:
    """Two turns, changed as a kind says."""
    m = [say("system", "p"), say("user", "a"), say("assistant", None, [("1", "get_weather", "{}")]), say("tool", "t", None, "1"), say("assistant", "fine"), say("user", "b"), say("assistant", "bye")]
    changed = {
        "robot": put(1, say("robot", "a"), m), "cut": put(4, say("assistant", "so...(truncated)"), m), "open": [*m[:3], *m[5:]], "early": put(0, say("assistant", "hi"), m), "again": put(6, say("assistant", "x", [("1", "f", "{}")]), m),
        "link": put(3, say("tool", "t", None, "2"), m), "silent": m[:6], "lost": [*m[:3], *m[4:]], "nobody": m[:1],
    }
    return changed.get(kind, m)


KINDS = ["ok", "robot", "cut", "open", "early", "again", "link", "silent", "lost", "nobody"]
_WEATHER_CODES = [None, "invalid_message", "truncated_message", "missing_tool_result", "invalid_message_order", "duplicate_tool_call_id", "tool_call_id_mismatch", "missing_final_reply", "missing_tool_result", "user_turn_mismatch"]
_HOME_CODES = [None, "invalid_message", None, "missing_tool_result", "invalid_message", "duplicate_tool_call", "orphan_tool_result", "missing_final_reply", "missing_tool_result", "missing_user_turn"]


def talks(spark, d) -> DataFrame:
    kinds = F.array(*[F.lit(json.dumps(_talk(k))) for k in KINDS])
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.from_json(F.get(kinds, (F.col("s_suppkey") % len(KINDS)).cast("int")), tr.MESSAGES).alias("messages"))


def _by_kind(codes: list) -> str:
    return f"CASE s_suppkey % {len(KINDS)} " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(codes) if c) + " END"


@query(f"SELECT s_suppkey AS n, CASE WHEN s_suppkey % 7 = 3 THEN 'unknown_template' WHEN s_suppkey % 7 = 4 THEN 'default_city_mismatch' ELSE {_by_kind(_WEATHER_CODES)} END AS reason FROM supplier")
def flt_weather_trace(spark, d):
    n = F.col("n") % 7
    context = F.struct(F.lit("2026-01-01").alias("base_date"), F.lit("Asia/Shanghai").alias("timezone"), F.when(n == 4, "北京").otherwise("杭州").alias("default_city"), F.lit(True).alias("trace_complete"))
    seed = F.struct(F.when(n == 3, "S99").otherwise("S02").alias("template_id"), F.array(F.lit("R01")).alias("scenario_ids"), F.lit("杭州").alias("default_city"), F.array(F.lit("a"), F.lit("b")).alias("user_turns"))
    return talks(spark, d).select("n", ev.weather_trace(F.col("messages"), context, seed).alias("reason"))


@query(f"SELECT s_suppkey AS n, CASE WHEN s_suppkey % 7 = 3 THEN 'invalid_sample_schema' ELSE {_by_kind(_HOME_CODES)} END AS reason FROM supplier")
def flt_home_trace(spark, d):
    context = F.struct((F.col("n") % 7 != 3).alias("trace_complete"), F.lit(None).cast("array<int>").alias("internal_message_indices"), F.array(F.struct(F.lit("x").alias("entity_id"))).alias("public_catalog"))
    return talks(spark, d).select("n", ev.home_trace(F.col("messages"), context, F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("string")).alias("reason"))


# ---- home expectations ----

CATALOG = "array<struct<entity_id:string,name:string,aliases:array<string>>>"
_DEVICES = json.dumps([{"entity_id": "light.a", "name": "台灯", "aliases": ["小灯"]}, {"entity_id": "light.b", "name": "客厅台灯"}, {"entity_id": "fan.c", "name": "风扇", "aliases": []}])
REPLIES = [("1. 客厅台灯\n2. 风扇", "light.b,fan.c"), ("请选择：；1、小灯；2）fan.c", "light.a,fan.c"), ("2. 台灯\n1. 风扇", ""), ("1. 台灯\n2. 小灯", ""), ("风扇还是小灯？", "fan.c,light.a"), ("light.a台灯", "light.a"), ("没有", "")]


def _pick(values: list, n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


@query("SELECT p_partkey AS n, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(REPLIES)) + " END AS shown FROM part")
def chk_displayed_candidates(spark, d):
    n = F.col("p_partkey")
    shown = he.candidates(_pick([t for t, _ in REPLIES], n), F.from_json(F.lit(_DEVICES), CATALOG))
    return table(spark, d, "part").select(n.alias("n"), F.array_join(shown, ",").alias("shown"))


#: template, variant, turn, and what is expected: action, target, read and control policy.
TURNS = [
    ("T01", "basic", 1, "control_device", "light.a=on", "required", "once_if_unmet"), ("T01", "basic", 2, "control_device", "light.a=on", "current_or_previous", "once_if_unmet"), ("T02", "basic", 1, "query_state", "light.a=", "required", "forbidden"),
    ("T05", "basic", 1, "control_device", "fan.c=off", "required", "once_if_unmet"), ("T07", "basic", 1, "clarify", "=off", "optional", "forbidden"), ("T08", "missing_both", 1, "clarify", "=", "optional", "forbidden"),
    ("T08", "missing_both", 2, "clarify", "light.a=", "optional", "forbidden"), ("T11", "basic", 1, "clarify", "=on", "optional", "forbidden"), ("T11", "basic", 2, "control_device", "fan.c=on", "current_or_previous", "once_if_unmet"),
    ("T17", "no_action", 1, "no_action", "", "forbidden", "forbidden"), ("T17", "cancel_after_execution", 1, "control_device", "fan.c=off", "required", "once_if_unmet"), ("T18", "basic", 1, "unsupported", "", "optional", "forbidden"),
    ("T20", "query_after_error", 2, "query_state", "light.a=", "required", "forbidden"),
]


def _turn_case(k: int) -> str:
    return f"CASE p_partkey % {len(TURNS)} " + " ".join(f"WHEN {i} THEN '{t[k]}'" for i, t in enumerate(TURNS)) + " END"


@query(f"SELECT p_partkey::VARCHAR AS sample_id, {_turn_case(3)} AS action, {_turn_case(4)} AS target, {_turn_case(5)} AS read_policy, {_turn_case(6)} AS control_policy FROM part")
def chk_expectation_home(spark, d):
    n = F.col("p_partkey")
    devices = lambda e, s: F.array(F.struct(F.lit(e).alias("entity_id"), F.lit(s).alias("desired_state")))
    selector = F.struct(F.lit("displayed_index").alias("kind"), F.lit(2).alias("index"), F.lit(None).cast("string").alias("entity_id"))
    seed = F.struct(_pick([t[0] for t in TURNS], n).alias("template_id"), _pick([t[1] for t in TURNS], n).alias("variant_id"), F.lit("single").alias("request_form"), F.lit(None).cast("string").alias("other_request"),
                    devices("light.a", "on").alias("target"), devices("fan.c", "off").alias("first_target"), selector.alias("selector"))
    turns = table(spark, d, "part").select(n.alias("sample_id"), seed.alias("seed"), _pick([t[2] for t in TURNS], n).alias("turn"), F.from_json(F.lit(_DEVICES), CATALOG).alias("catalog"), F.lit("1. 客厅台灯\n2. 风扇").alias("previous_reply"), F.lit(False).alias("environment_changed"))
    out = he.expectations(turns)
    target = F.array_join(F.transform("target", lambda t: F.concat(F.coalesce(t["entity_id"], F.lit("")), F.lit("="), F.coalesce(t["desired_state"], F.lit("")))), ",")
    return out.select("sample_id", "action", target.alias("target"), "read_policy", "control_policy")
