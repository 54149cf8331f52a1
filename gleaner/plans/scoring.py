"""Queries that run the rule checks, verdict validation and preset operators over turns and records made of the driver's
tables; which case a row is follows from its key, so the SQL states each case's result."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gleaner.operators import home_checks as hc
from gleaner.operators import presets as pr
from gleaner.operators import records as rc
from gleaner.operators import weather_checks as wc
from gleaner.plans.conversations import messages, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def case(n, *values):
    """The value of case n modulo their number."""
    return F.element_at(F.array(*values), (n % len(values) + 1).cast("int"))


def weather_turns(spark, d):
    """An order is a turn about its customer's city: queried well, not at all, needlessly, reused, for another city."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n, city, day = F.col("o_orderkey"), F.col("c_name"), F.col("o_orderdate").cast("date")
    null = F.lit(None)
    seed = F.struct(
        *[F.lit(None).cast(t).alias(k) for k, t in (("default_city", "string"), ("target_adm", "string"), ("first_city", "string"), ("first_day", "int"), ("province", "string"), ("ambiguous_name", "string"),
                                                    ("invalid_location", "string"), ("clarification_kind", "string"), ("days_ago", "int"), ("days_ahead", "int"), ("target_days", "array<int>"))],
        city.alias("target_city"), F.lit(1).alias("target_day"))
    good = F.to_json(F.struct(city.alias("location"), F.lit("zh").alias("lang")))
    none = F.array().cast("array<string>")
    one = F.array(good)
    tomorrow = F.array(F.date_add(day, 1).cast("string"))
    return o.select(
        n.alias("sample_id"), case(n, *map(F.lit, ("S02", "S02", "S03", "S07", "S02", "S07"))).alias("template_id"), case(n, *map(F.lit, (1, 1, 1, 2, 1, 2))).alias("turn"), day.alias("base_date"), seed.alias("seed"),
        case(n, one, none, one, none, F.array(F.lit('{"location":"elsewhere","day":1}')), none).alias("calls"), case(n, F.concat(city, F.lit("市")), null, city, city, city, city).alias("report_city"),
        case(n, tomorrow, none, tomorrow, tomorrow, tomorrow, none).alias("report_dates"), none.alias("first_report_dates"), F.array(F.concat(F.lit("in "), city)).alias("replies"),
    )


@query("""SELECT o_orderkey AS sample_id, CASE o_orderkey % 6 WHEN 1 THEN 'missing_call' WHEN 2 THEN 'forbidden_call' WHEN 5 THEN 'dates_not_covered' END AS reason FROM orders""")
def chk_C01(spark, d):
    t = wc.call_behaviour(wc.expectation(weather_turns(spark, d)))
    return t.select("sample_id", F.col("c01.reason").alias("reason"))


@query("""SELECT o_orderkey AS sample_id, CASE o_orderkey % 6 WHEN 4 THEN 'unknown_field；missing_lang；location_is_not_the_target' ELSE '' END AS problems FROM orders""")
def chk_C02(spark, d):
    t = wc.arguments(wc.expectation(weather_turns(spark, d)))
    return t.select("sample_id", F.array_join("c02.problems", "；").alias("problems"))


@query("""SELECT o_orderkey AS sample_id, CASE o_orderkey % 6 WHEN 1 THEN 'fail' ELSE 'pass' END AS status FROM orders""")
def chk_C03(spark, d):
    return wc.city_kept(weather_turns(spark, d)).select("sample_id", F.col("c03.status").alias("status"))


@query("""SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 6 = 2 THEN 'chat_about_weather' ELSE 'answer_weather' END AS action,
  CASE o_orderkey % 6 WHEN 2 THEN 'forbidden' WHEN 3 THEN 'reuse_allowed' WHEN 5 THEN 'reuse_allowed' ELSE 'required' END AS call_mode, strftime(o_orderdate::DATE + 1, '%Y-%m-%d') AS dates FROM orders""")
def chk_expectation_weather(spark, d):
    t = wc.expectation(weather_turns(spark, d))
    return t.select("sample_id", "expected.action", "expected.call_mode", F.array_join("expected.dates", ",").alias("dates"))


@query("""WITH t AS (SELECT o_orderkey AS sample_id, o_orderkey % 6 AS c FROM orders), x(c, check_id, reason) AS (VALUES
   (0, 'C05', NULL), (0, 'C01', NULL), (0, 'C02', NULL), (0, 'C03', NULL), (1, 'C05', NULL), (1, 'C01', NULL), (1, 'C02', 'no_weather_call'), (1, 'C03', 'no_new_weather_report'),
   (2, 'C05', 'template_turn_not_applicable'), (2, 'C01', NULL), (2, 'C02', 'template_turn_not_applicable'), (2, 'C03', 'template_turn_not_applicable'),
   (3, 'C05', NULL), (3, 'C01', NULL), (3, 'C02', 'no_weather_call'), (3, 'C03', NULL), (4, 'C05', NULL), (4, 'C01', NULL), (4, 'C02', NULL), (4, 'C03', NULL), (5, 'C05', NULL), (5, 'C01', NULL), (5, 'C02', 'no_weather_call'), (5, 'C03', NULL))
  SELECT sample_id, check_id, reason FROM t JOIN x USING (c)""")
def chk_plan(spark, d):
    t = wc.expectation(weather_turns(spark, d)).select(
        "sample_id", "template_id", "turn", F.array(F.lit("R01"), F.lit("O02"), F.lit("R01")).alias("scenario_ids"), "expected.call_mode", F.size("calls").alias("n_calls"), F.col("report_city").isNotNull().alias("has_report"))
    return wc.candidate_checks(t).select("sample_id", "check_id", "reason")


CALL = "array<struct<name:string,arguments:string,index:int,result_index:int,content:string>>"


def home_turns(spark, d):
    """A part is a turn about light.a: done well, not read, blind, already on, refused, or with odd arguments."""
    def snap(at, state):
        return {"name": hc.READ, "arguments": "{}", "index": at, "result_index": at + 1, "content": json.dumps({"connected": True, "outdated": False, "highlight": [{"entity_id": "light.a", "s": state}]})}

    def put(at, content="ok"):
        return {"name": hc.WRITE, "arguments": '{"entity_id":"light.a","state":{"type":"turn_on"}}', "index": at, "result_index": at + 1, "content": content}

    odd = {"name": hc.READ, "arguments": '{"max_highlight":0}', "index": 2, "result_index": 3, "content": "x"}
    cases = [[snap(2, "off"), put(4), snap(6, "on")], [], [put(2), snap(4, "on")], [snap(2, "on"), put(4), snap(6, "on")], [snap(2, "off"), put(4, hc.REFUSALS[1])], [odd]]
    calls = F.from_json(case(F.col("p_partkey"), *[F.lit(json.dumps(c)) for c in cases]), CALL)
    target = F.array(F.struct(F.lit("light.a").alias("entity_id"), F.lit("on").alias("desired_state")))
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("sample_id"), F.lit(1).alias("turn"), calls.alias("calls"), F.lit(None).cast(CALL[6:-1]).alias("previous_read"), target.alias("targets"),
        F.lit("required").alias("read_policy"), F.lit("once_if_unmet").alias("control_policy"), F.array(F.lit("light.a")).alias("controllable"))


@query("""SELECT p_partkey::VARCHAR AS sample_id, CASE p_partkey % 6 WHEN 1 THEN 'required_read_missing' WHEN 2 THEN 'control_before_read；control_without_preconditions' WHEN 3 THEN 'already_as_wanted' ELSE '' END AS problems FROM part""")
def chk_HC01(spark, d):
    return hc.protocols(home_turns(spark, d)).select("sample_id", F.array_join("hc01", "；").alias("problems"))


@query("""SELECT p_partkey::VARCHAR AS sample_id, CASE p_partkey % 6 WHEN 5 THEN 'invalid_snapshot_arguments' ELSE '' END AS problems FROM part""")
def chk_HC02(spark, d):
    return hc.arguments(home_turns(spark, d)).select("sample_id", F.array_join("hc02", "；").alias("problems"))


@query("SELECT p_partkey::VARCHAR AS sample_id, p_partkey % 6 = 3 AS ignored FROM part")
def chk_HC03(spark, d):
    return hc.ignored_state(home_turns(spark, d)).select("sample_id", F.col("hc03").alias("ignored"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations)
  SELECT conv_id::VARCHAR AS sample_id, turn::VARCHAR AS key, CASE WHEN turn % 4 = 3 THEN 'missing_judge_item' WHEN turn % 4 = 2 THEN 'invalid_judge_status' WHEN turn % 4 = 1 AND turn % 3 = 0 AND coalesce(prior, -1) < 0 THEN 'invalid_judge_evidence'
    WHEN turn % 4 = 1 AND turn % 3 <> 0 THEN 'invalid_judge_evidence' END AS code FROM m WHERE role = 'assistant'""")
def flt_judge_response(spark, d):
    m = messages(spark, d).withColumn("sample_id", F.col("sample_id").cast("string"))
    a, i = m.where("role = 'assistant'"), F.col("message_index")
    requests = a.select("sample_id", i.cast("string").alias("key"), F.array(i).alias("reply_indices"), F.lit("none").alias("policy"))
    own = F.struct(i.alias("message_index"), F.substring("content", 1, 9).alias("quote"))
    bad = F.struct(i.alias("message_index"), F.concat("content", F.lit("#")).alias("quote"))
    evidence = F.array(F.when((i % 4 == 1) & (i % 3 != 0), bad).otherwise(own))
    results = a.where("message_index % 4 <> 3").select("sample_id", i.cast("string").alias("key"), F.when(i % 4 == 2, "maybe").otherwise("pass").alias("status"), F.lit("why").alias("reason"), evidence.alias("evidence"))
    return rc.judgments(requests, results, m).select("sample_id", "key", "code")


@query("""WITH p AS (SELECT r_name AS scenario, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT r_name AS scenario, s_nationkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  a AS (SELECT scenario, count(DISTINCT id) AS planned FROM p GROUP BY 1), b AS (SELECT scenario, count(*) AS saved, count(*) - count(DISTINCT id) AS repeated FROM s GROUP BY 1)
  SELECT scenario, planned, coalesce(saved, 0) AS saved, 0::BIGINT AS unknown, coalesce(repeated, 0) AS repeated, CASE WHEN scenario <> 'ASIA' AND saved = planned AND repeated = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM a LEFT JOIN b USING (scenario)""")
def agg_generation_accounting(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    planned = n.select(F.col("r_name").alias("scenario"), F.col("n_nationkey").alias("sample_id"))
    saved = table(spark, d, "supplier").join(planned, F.col("s_nationkey") == F.col("sample_id")).select("scenario", "sample_id")
    codes = table(spark, d, "region").select(F.col("r_name").alias("scenario"), F.when(F.col("r_name") == "ASIA", 1).otherwise(0).alias("returncode"))
    return rc.accounting(planned, saved, codes)


@query("""SELECT p_brand AS preset, min('{"size":' || (p_size % 2) || ',"type":"x"}') AS config, count(DISTINCT p_size % 2) > 1 AS conflict FROM part GROUP BY 1""")
def src_preset_library(spark, d):
    config = F.concat(F.lit('{ "type": "x", "size": '), (F.col("p_size") % 2).cast("string"), F.lit("}"))
    return pr.library(table(spark, d, "part").select(F.col("p_brand").alias("preset"), config.alias("config")))


@query("""WITH RECURSIVE g AS (SELECT DISTINCT p_brand AS t, p_partkey // 3 AS g FROM part), k AS (SELECT *, row_number() OVER (ORDER BY t, g) - 1 AS k FROM g),
  c AS (SELECT k, p_partkey AS seed_id, p_brand AS t, p_partkey // 3 AS g, p_partkey % 3 + 1 AS p, ((p_partkey % 3 - k) % 3 + 3) % 3 AS turn, p_partkey % 997 AS w, p_partkey % 997 IN (SELECT p_partkey % 997 FROM part WHERE p_partkey % 13 = 0) AS old FROM part JOIN k ON p_brand = t AND p_partkey // 3 = g),
  n AS (SELECT k, list({'turn': turn, 'seed': seed_id, 'p': p, 'w': w, 'old': old} ORDER BY turn, seed_id) AS cs FROM c GROUP BY 1),
  s AS (SELECT -1::BIGINT AS k, 0::BIGINT AS seed_id, 0::BIGINT AS p, false AS reused, []::BIGINT[] AS used
    UNION ALL SELECT n.k, x.seed, x.p, x.bad, list_append(used, x.w) FROM (SELECT n.k AS k2, used, list_transform(cs, lambda y: {'bad': y.old OR list_contains(used, y.w), 'turn': y.turn, 'seed': y.seed, 'p': y.p, 'w': y.w}) AS ys FROM s JOIN n ON n.k = s.k + 1) q
      JOIN n ON n.k = q.k2, LATERAL (SELECT list_min(q.ys) AS x) z)
  SELECT t AS template_id, g AS variable_group_id, seed_id, 'P' || p AS question_pattern_id, reused FROM s JOIN k USING (k)""")
def smp_rotate_pattern(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.col("p_brand").alias("template_id"), F.expr("p_partkey div 3").alias("variable_group_id"), F.col("p_partkey").alias("seed_id"),
                 F.concat(F.lit("P"), (F.col("p_partkey") % 3 + 1).cast("string")).alias("question_pattern_id"), F.array((F.col("p_partkey") % 997).cast("string")).alias("user_turns"))
    return pr.rotate_patterns(s, s.where("seed_id % 13 = 0")).select("template_id", "variable_group_id", "seed_id", "question_pattern_id", "reused")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'missing_visible_catalog' WHEN 2 THEN 'catalog_mismatch' WHEN 3 THEN 'invalid_public_catalog' END AS code,
  CASE s_suppkey % 4 WHEN 0 THEN sha256('prompt' || chr(10) || chr(10) || '本次可信设备目录（controllable为允许开关，未列设备不在本次允许范围）：' || ' [{"entity_id":"' || s_suppkey || '","name":"' || s_name || '","controllable":true}]') END AS system FROM supplier""")
def prj_system_rebuild(spark, d):
    n, name = F.col("s_suppkey"), F.col("s_name")
    cat = lambda v: F.concat(F.lit('[{"entity_id":"'), n.cast("string"), F.lit('","name":"'), name, F.lit(f'","controllable":{v}}}]'))
    m = F.lit(rc.CATALOG_MARK)
    system = case(n, F.concat(F.lit("old"), m, F.lit(" "), cat("true")), cat("true"), F.concat(m, cat("true")), F.concat(m, cat("1")))
    public = case(n, cat("true"), cat("true"), F.lit("[]"), cat("1"))
    r = rc.rebuild_system(system, public, "prompt \n", F.lit(True))
    return table(spark, d, "supplier").select("s_suppkey", r["code"].alias("code"), F.sha2(r["system"], 256).alias("system"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 30 <= 16 THEN 'positive' ELSE 'negative' END AS kind FROM part""")
def prj_sample_type(spark, d):
    return table(spark, d, "part").select("p_partkey", rc.sample_type(F.format_string("T%02d", F.col("p_partkey") % 30)).alias("kind"))


@query("""SELECT event_type || '-' || user_id AS rule, count(*) AS triggers, true AS used FROM events WHERE value > 99 GROUP BY 1
  UNION ALL SELECT DISTINCT event_type || '-' || user_id, 0, false FROM events WHERE event_type || '-' || user_id NOT IN (SELECT event_type || '-' || user_id FROM events WHERE value > 99)""")
def jn_rule_records(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("rule_id"), "value")
    return rc.unused_rules(e.select("sample_id", "rule_id").distinct(), e.where("value > 99")).select(F.col("rule_id").alias("rule"), "triggers", "used")
