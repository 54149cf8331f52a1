"""Scorers' input rules, plans, simulator rules and the registry."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluation as ev
from gleaner.operators import traces as tr
from gleaner.operators.home_checks import READ, WRITE


def msg(role, content=None, calls=None, answers=None):
    return (role, content, [(i, t, (n, "{}")) for i, t, n in calls] if calls else None, answers)


def base():
    return [msg("system", "p"), msg("user", "a"), msg("assistant", None, [("1", "function", "get_weather")]), msg("tool", "t", None, "1"), msg("assistant", "fine"), msg("user", "b"), msg("assistant", "bye")]


def put(k, m):
    b = base()
    b[k] = m
    return b


W = f"name string, messages {tr.MESSAGES}, context struct<base_date:string,timezone:string,default_city:string,trace_complete:boolean>, seed struct<template_id:string,scenario_ids:array<string>,default_city:string,user_turns:array<string>>"


def weather(name, messages=None, day="2026-01-01", zone="Asia/Shanghai", city="杭州", whole=True, template="S02", scenes=("R01",), turns=("a", "b")):
    return (name, base() if messages is None else messages, (day, zone, city, whole), (template, list(scenes), "杭州", list(turns)))


def test_weather_input(spark):
    rows = [
        weather("ok"), weather("unknown_template", template="S99"), weather("missing_scenario_mapping", scenes=()), weather("missing_scenario_mapping/2", scenes=("R01", "X")), weather("invalid_sample_schema", day=""), weather("invalid_sample_schema/2", day="2026-13-01"),
        weather("invalid_sample_schema/3", zone="Mars/Base"), weather("incomplete_message_trace", whole=False), weather("default_city_mismatch", city="北京"), weather("invalid_sample_schema/4", []), weather("invalid_message", put(1, msg("robot", "a"))),
        weather("invalid_message/2", put(3, msg("tool", None, None, "1"))), weather("truncated_message", put(4, msg("assistant", "so...(truncated)"))), weather("missing_tool_result", [*base()[:3], *base()[5:]]), weather("missing_tool_result/2", put(3, msg("assistant", "early"))),
        weather("missing_tool_result/3", base()[:3]), weather("invalid_message_order", put(0, msg("assistant", "hi"))), weather("invalid_tool_call", put(2, msg("assistant", None, [("1", "other", "get_weather")]))),
        weather("duplicate_tool_call_id", put(6, msg("assistant", None, [("1", "function", "x")]))), weather("tool_call_id_mismatch", put(3, msg("tool", "t", None, "2"))), weather("user_turn_mismatch", turns=("a",)), weather("missing_final_reply", base()[:6]),
        weather("missing_final_reply/2", [*base()[:4], *base()[5:]]),
    ]
    df = spark.createDataFrame(rows, W)
    got = {r[0]: r[1] for r in df.select("name", ev.weather_trace(F.col("messages"), F.col("context"), F.col("seed"))).collect()}
    assert got == {n: None if n == "ok" else n.split("/")[0] for n in got} and len(got) == len(rows)


def test_home_input(spark):
    def home(name, messages=None, whole=True, internal=None, catalog=("x", "y"), turns=("a", "b"), bad=None):
        return (name, base() if messages is None else messages, (whole, internal, [(c,) for c in catalog] if catalog is not None else None), list(turns), bad)

    inner = [*base()[:5], msg("user", "hook"), msg("assistant", "aside"), *base()[5:]]
    late = [*base()[:3], msg("assistant", "soon"), msg("user", "b"), msg("tool", "t", None, "1"), msg("assistant", "bye")]
    rows = [
        home("ok"), home("ok/2", inner, internal=[5]), home("invalid_sample_schema", whole=False), home("invalid_sample_schema/2", catalog=("x", "x")), home("invalid_sample_schema/3", catalog=None), home("invalid_sample_schema/4", bad="invalid_target"),
        home("invalid_message_trace", []), home("invalid_message", put(1, msg("robot", "a"))), home("invalid_message/2", put(0, msg("assistant", "hi"))), home("duplicate_tool_call", put(6, msg("assistant", "x", [("1", "function", "f")]))),
        home("duplicate_tool_call/2", put(2, msg("assistant", "x", [("", "function", "f")]))), home("orphan_tool_result", put(3, msg("tool", "t", None, "9"))), home("orphan_tool_result/2", late), home("missing_user_turn", [msg("system", "p")]),
        home("user_turn_mismatch", turns=("b", "a")), home("missing_tool_result", [*base()[:3], *base()[4:]]), home("missing_final_reply", base()[:6]), home("missing_final_reply/2", [*base()[:4], *base()[5:]]),
    ]
    df = spark.createDataFrame(rows, f"name string, messages {tr.MESSAGES}, context struct<trace_complete:boolean,internal_message_indices:array<int>,public_catalog:array<struct<entity_id:string>>>, turns array<string>, bad string")
    got = {r[0]: r[1] for r in df.select("name", ev.home_trace(F.col("messages"), F.col("context"), F.col("turns"), F.col("bad"))).collect()}
    assert got == {n: None if n.startswith("ok") else n.split("/")[0] for n in got} and len(got) == len(rows)


def test_home_plan(spark):
    t = spark.createDataFrame([("a", "T01", None, 1, ["HS01"], 0, False), ("b", "T17", "no_action", 1, ["HS07", "HS03"], 1, True), ("b", "T17", "no_action", 2, ["HS07"], 1, False), ("c", "T09", None, 1, ["HS11"], 2, False)],
                              "sample_id string, template_id string, variant_id string, turn int, scenario_ids array<string>, n_calls int, has_snapshot boolean")
    got = {(r["sample_id"], r["turn"], r["check_id"]): (r["scenario_ids"], r["reason"]) for r in ev.home_candidates(t).collect()}
    assert {k[2]: v[1] for k, v in got.items() if k[0] == "a"} == {"HC01": None, "HC02": "no_tool_call", "HC03": "no_snapshot_result", "HC05": None, "HC06": None, "HC07": None}
    assert got["b", 1, "HC03"] == (["HS03"], "template_turn_not_applicable") and got["b", 1, "HC05"] == (["HS07"], "template_turn_not_applicable") and got["b", 1, "HC04"] == (["HS03", "HS07"], None)
    assert got["c", 1, "HC03"][1] == "no_snapshot_result" and got["c", 1, "HC04"][1] is None
    plan = ev.home_candidates(t)
    samples = spark.createDataFrame([("a", ["HS01", "HS02"]), ("c", ["HS11"])], "sample_id string, scenario_ids array<string>")
    assert [tuple(r) for r in ev.plan_problems(plan, samples).collect()] == [("a", "empty_scenario_result")]


def test_simulator_rules(spark):
    rules = [("s1", "r", "p", None, "light.a", None, "turn_on", None, "accepted", None), ("s2", "r", "p", None, "light.a", None, "turn_on", None, "accepted", None), *[(f"u{k}", "r", "p", 2, "light.a", "灯", "turn_on", 1, "rejected", None) for k in range(6)]]
    records = [
        ("s1", "r", 1, WRITE, "light.a", "turn_on"), ("s2", None, 1, WRITE, "light.a", "turn_on"), ("u0", None, 1, WRITE, "light.a", "turn_on"), ("u0", None, 3, WRITE, "light.a", "turn_on"), ("u1", None, 2, WRITE, "light.a", "turn_off"), ("u2", None, 2, WRITE, "light.b", "turn_on"),
        ("u3", None, 2, READ, None, None), ("u4", None, 2, "other", None, None), ("u5", None, 1, READ, None, None),
    ]
    r = spark.createDataFrame(rules, "sample_id string, rule_id string, preset string, turn int, entity_id string, entity_name string, action string, occurrence int, outcome string, apply boolean")
    rec = spark.createDataFrame(records, "sample_id string, rule_id string, turn int, tool string, entity_id string, action string")
    cases = {(x["turn"], x["entity_name"], x["apply"]): (x["configured"], x["triggered"], x["unused"], x["trigger_rate"]) for x in ev.coverage(r, rec).collect()}
    assert cases == {(1, "light.a", True): (2, 1, 1, 0.5), (2, "灯", False): (6, 0, 6, 0.0)}
    why = {x["sample_id"]: (x["reason"], x["other_turns"]) for x in ev.unused_reasons(r, rec).collect()}
    assert why == {
        "s2": ("control_did_not_match_rule", []), "u0": ("matching_control_in_other_turn", [1, 3]), "u1": ("control_did_not_match_rule", []), "u2": ("controlled_other_device", []), "u3": ("snapshot_without_target_control", []),
        "u4": ("no_target_control", []), "u5": ("no_real_tool_call", [])}
    total = ev.coverage_totals(r, rec).first()
    assert (total["configured_samples"], total["triggered_samples"], total["samples_with_unused_rules"], total["unused_rule_occurrences"]) == (8, 1, 7, 7)


def test_groups_order_and_registry(spark):
    s = spark.createDataFrame([("positive", "pass"), ("positive", "fail"), ("positive", "error")], "sample_type string, status string")
    assert {r["sample_type"]: (r["count"], r["pass_rate"]) for r in ev.groups(s).collect()} == {"positive": (2, 0.5), "negative": (0, None)}
    c = spark.createDataFrame([("a", 10, "C01", "pass"), ("a", 2, "C02", "pass"), ("a", 2, "C01", "fail")], "sample_id string, turn int, check_id string, status string")
    assert [x["key"] for x in ev.ordered(c).first()["checks"]] == ["2:C01", "2:C02", "10:C01"]
    e = spark.createDataFrame([("HC05",), ("HC07",), ("HC04",)], "c string").withColumn("e", F.struct(F.lit("clarify").alias("action"), F.lit("x").alias("target"), F.lit("r").alias("read_policy"), F.lit("c").alias("control_policy"), F.lit(None).cast("string").alias("other_request")))
    assert [r[0] for r in e.select(ev.judge_expected(F.col("c"), F.col("e"))).collect()][:2] == ['{"action":"clarify","target":"x","other_request":null}', "{}"]
    assert set(ev.SCORERS) == {"weather", "home_switch"}
    with pytest.raises(ValueError, match="scorer_exists"):
        ev.register(ev.SCORERS["weather"])
