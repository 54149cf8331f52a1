"""Weather and home rules on hand-made turns."""

import datetime as dt
import json

from gleaner.operators import home_checks as hc
from gleaner.operators import weather_checks as wc

SEED = "default_city string, target_city string, target_adm string, target_day int, target_days array<int>, first_city string, first_day int, province string, ambiguous_name string, invalid_location string, clarification_kind string, days_ago int, days_ahead int"
TURN = f"sample_id string, template_id string, turn int, base_date date, seed struct<{SEED.replace(' ', ':').replace(',:', ',')}>, calls array<string>, report_city string, report_dates array<string>, first_report_dates array<string>, replies array<string>"
NAMES = [f.split()[0] for f in SEED.split(", ")]


def turn(name, template, n=1, calls=(), city=None, dates=None, replies=(), first=None, **seed):
    return (name, template, n, dt.date(2026, 1, 1), tuple(seed.get(k) for k in NAMES), list(calls), city, dates, first, list(replies))


def weather(spark, rows):
    return {r["sample_id"]: r for r in wc.score(spark.createDataFrame(rows, TURN)).collect()}


def test_expected_actions(spark):
    got = weather(spark, [
        turn("plain", "S02", target_city="上海", target_day=1), turn("default", "S01", default_city="杭州", target_city="x", target_day=0), turn("days", "S13", target_city="上海", target_days=[0, 2]),
        turn("date", "S07", target_city="上海", target_day=1), turn("date2", "S07", 2, target_city="上海", target_day=1), turn("prov", "S11", target_city="吉林", province="吉林省"), turn("amb", "S12", ambiguous_name="朝阳", target_adm="北京"),
        turn("wrong", "S15", invalid_location="啊城"), turn("cancel", "S24", 2, target_city="上海", target_day=1, clarification_kind="date"), turn("past", "S08", days_ago=3, target_city="上海"),
        turn("edge", "S10", 2, target_city="上海", first=["2026-01-06", "2026-01-07"]), turn("chat", "S03", target_city="上海"),
    ])
    e = {k: r["expected"] for k, r in got.items()}
    assert (e["plain"]["action"], e["plain"]["call_mode"], e["plain"]["dates"]) == ("answer_weather", "required", ["2026-01-02"])
    assert (e["default"]["city"], e["default"]["default_mode"]) == ("杭州", True)
    assert e["days"]["dates"] == ["2026-01-01", "2026-01-03"]
    assert (e["date"]["action"], e["date"]["call_mode"], e["date"]["dates"]) == ("clarify_date", None, [])
    assert e["date2"]["call_mode"] == "reuse_allowed"
    assert (e["prov"]["action"], e["prov"]["city"], e["prov"]["adm"], e["prov"]["known_location"]) == ("clarify_province_city", None, "吉林省", "吉林省")
    assert (e["amb"]["action"], e["amb"]["adm"], e["amb"]["known_location"]) == ("clarify_ambiguous_city", None, "朝阳")
    assert (e["wrong"]["action"], e["wrong"]["known_location"]) == ("request_location_correction", "啊城")
    assert (e["cancel"]["action"], e["cancel"]["call_mode"], e["cancel"]["dates"]) == ("cancel_request", "forbidden", [])
    assert e["past"]["dates"] == ["2025-12-29"] and e["chat"]["call_mode"] == "forbidden"
    assert (e["edge"]["action"], e["edge"]["dates"]) == ("answer_forecast_boundary", ["2026-01-07", "2026-01-08"])


def test_weather_rules(spark):
    call = lambda **a: json.dumps(a, ensure_ascii=False)
    good = call(location="上海", lang="zh")
    rows = [
        turn("ok", "S02", calls=[good], city="上海市", replies=["上海明天晴"], target_city="上海", target_day=1), turn("none", "S02", target_city="上海", target_day=1), turn("talk", "S03", calls=[good], target_city="上海"),
        turn("reuse", "S07", 2, city="上海", dates=["2026-01-02"], target_city="上海市", target_day=1), turn("gap", "S07", 2, city="上海", dates=["2026-01-01"], target_city="上海", target_day=1), turn("other", "S07", 2, city="北京", dates=["2026-01-02"], target_city="上海", target_day=1),
        turn("edge", "S10", 2, city="上海", dates=["2026-01-07"], first=["2026-01-07"], target_city="上海"),
        turn("args", "S02", calls=[call(location="北京", day=1), "[]", call(location="北京", lang=" ")], target_city="上海", target_day=1, city="上海", replies=["北京晴"]),
        turn("def", "S01", calls=[call(lang="zh", adm="浙江")], default_city="杭州", target_day=0), turn("adm", "S02", calls=[call(location="朝阳", lang="zh")], target_city="朝阳区", target_adm="北京", target_day=0),
        turn("qual", "S02", calls=[call(location="朝阳", adm="北京市", lang="zh")], target_city="朝阳区", target_adm="北京", target_day=0),
    ]
    got = weather(spark, rows)
    c01 = {k: r["c01"]["reason"] for k, r in got.items()}
    assert [c01[k] for k in ("ok", "none", "talk", "reuse", "gap", "other", "edge")] == [None, "missing_call", "forbidden_call", None, "dates_not_covered", "no_reusable_report", None]
    c02 = {k: r["c02"]["problems"] for k, r in got.items()}
    assert c02["ok"] == [] and c02["qual"] == [] and c02["def"] == ["default_city_must_omit_location", "adm_not_given_by_user"]
    assert c02["args"] == ["unknown_field", "missing_lang", "location_is_not_the_target", "arguments_not_object"]
    assert c02["adm"] == ["location_is_not_the_target", "ambiguous_place_without_region"]
    assert got["ok"]["c03"]["status"] == "pass" and got["args"]["c03"]["status"] == got["none"]["c03"]["status"] == "fail"


def test_check_selection(spark):
    t = spark.createDataFrame([("a", "S24", 1, ["T04", "G02", "O04"], None, 0, False), ("a", "S24", 2, ["T04", "G02", "O04"], "forbidden", 0, False), ("b", "S15", 2, ["O02", "L01"], "required", 1, True)],
                              "sample_id string, template_id string, turn int, scenario_ids array<string>, call_mode string, n_calls int, has_report boolean")
    got = {(r["sample_id"], r["turn"], r["check_id"]): (r["scenario_ids"], r["reason"]) for r in wc.candidate_checks(t).collect()}
    assert got == {
        ("a", 1, "C04"): (["T04"], None), ("a", 1, "C05"): (["T04"], "template_turn_not_applicable"), ("a", 1, "C07"): (["O04"], None), ("a", 2, "C01"): (["G02"], None), ("a", 2, "C04"): (["G02"], None),
        ("a", 2, "C07"): (["O04"], None), ("b", 2, "C03"): (["O02"], None), ("b", 2, "C05"): (["O02"], None), ("b", 2, "C01"): (["L01"], None), ("b", 2, "C02"): (["L01"], None),
    }


CALL = "struct<name:string,arguments:string,index:int,result_index:int,content:string>"
HOME = f"sample_id string, turn int, calls array<{CALL}>, previous_read {CALL}, targets array<struct<entity_id:string,desired_state:string>>, read_policy string, control_policy string, controllable array<string>"


def snap(at, connected=True, **states):
    return (hc.READ, "{}", at, at + 1, json.dumps({"connected": connected, "outdated": False, "highlight": [{"entity_id": k.replace("_", "."), "s": v} for k, v in states.items()]}))


def put(at, entity, act, content="ok"):
    return (hc.WRITE, json.dumps({"entity_id": entity, "state": {"type": act}}), at, at + 1, content)


def home(name, calls, targets=(("light.a", "on"),), read="required", control="once_if_unmet", previous=None):
    return (name, 1, calls, previous, list(targets), read, control, ["light.a", "light.b", "fan.c"])


def test_home_rules(spark):
    ab = (("light.a", "on"), ("light.b", "on"))
    rows = [
        home("good", [snap(2, light_a="off"), put(4, "light.a", "turn_on"), snap(6, light_a="on")]), home("noread", []), home("blind", [put(2, "light.a", "turn_on"), snap(4, light_a="on")]),
        home("met", [snap(2, light_a="on"), put(4, "light.a", "turn_on"), snap(6, light_a="on")]), home("unconfirmed", [snap(2, light_a="off"), put(4, "light.a", "turn_on")]), home("missing", [snap(2, light_a="off")]),
        home("idle", [snap(2, light_a="on")], (), "forbidden", "forbidden"), home("refused", [snap(2, light_a="off"), put(4, "light.a", "turn_on", "设置失败，错误码: 401")]),
        home("twice", [snap(2, light_a="off"), put(4, "light.a", "turn_on"), put(6, "light.a", "turn_on"), snap(8, light_a="on")]),
        home("two", [snap(2, light_a="off", light_b="off"), put(4, "light.a", "turn_on"), snap(6, light_a="on", light_b="off"), put(8, "light.b", "turn_on"), snap(10, light_a="on", light_b="on")], ab),
        home("rush", [snap(2, light_a="off", light_b="off"), put(4, "light.a", "turn_on"), put(6, "light.b", "turn_on"), snap(8, light_a="on", light_b="off")], ab),
        home("stop", [snap(2, light_a="off", light_b="off"), put(4, "light.a", "turn_on"), snap(6, light_a="off", light_b="off"), put(8, "light.b", "turn_on"), snap(10, light_b="on")], ab),
        home("reuse", [], read="current_or_previous", control="forbidden", previous=snap(1, light_a="on")), home("stale", [], read="current_or_previous", control="forbidden", previous=snap(1, False, light_a="on")),
        home("offline", [snap(2, False, light_a="off"), put(4, "light.a", "turn_on"), snap(6, light_a="on")]), home("fan", [snap(2, fan_c="off"), put(4, "fan.c", "turn_on"), snap(6, fan_c="on")], (("fan.c", "on"),)),
        home("odd", [(hc.READ, '{"max_highlight":0}', 2, 3, "x"), (hc.READ, '{"max_highlight":80}', 4, 5, "x"), (hc.WRITE, '{"entity_id":"light.a","state":"on"}', 6, 7, "x"), ("other", "{}", 8, 9, "x"), (hc.WRITE, "[]", 10, 11, "x")]),
    ]
    t = spark.createDataFrame(rows, HOME)
    hc01 = {r["sample_id"]: r["hc01"] for r in hc.protocols(t).collect()}
    assert hc01 == {
        "good": [], "noread": ["required_read_missing"], "blind": ["control_before_read", "control_without_preconditions"], "met": ["already_as_wanted"], "unconfirmed": ["no_read_after_control"], "missing": ["needed_control_missing"],
        "idle": ["call_in_idle_turn"], "refused": [], "twice": ["over_budget", "device_controlled_twice"], "two": [], "rush": ["second_before_confirmation"], "stop": ["went_on_unconfirmed"],
        "reuse": [], "stale": ["no_state_to_reuse"], "offline": ["control_without_preconditions"], "fan": [],
        "odd": ["over_budget", "foreign_tool", "no_read_after_control", "control_without_preconditions"],
    }
    rest = {r["sample_id"]: (r["hc02"], r["hc03"]) for r in hc.ignored_state(hc.arguments(t)).collect()}
    assert rest["good"] == ([], False) and rest["met"] == ([], True) and rest["offline"] == ([], True) and rest["blind"] == ([], False)
    assert rest["fan"] == (["device_not_allowed"], False)
    assert rest["odd"][0] == ["invalid_snapshot_arguments", "outside_switch_contract", "unknown_tool", "arguments_not_object"]
