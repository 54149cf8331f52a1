"""Semantics that the driver's tables can't show: tool calls, links, scores, reports, files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import aggregates as ag
from gleaner.operators import formats as fm
from gleaner.operators import seeds as sd
from gleaner.operators import traces as tr
from gleaner.sources import files

SCHEMA = f"sample_id string, seed struct<user_turns:array<string>>, context struct<trace_complete:boolean,system_prompt_sha256:string,internal_message_indices:array<int>>, messages {tr.MESSAGES}"


def msg(role, content=None, calls=None, answers=None):
    return (role, content, [(i, "function", (n, a)) for i, n, a in calls] if calls else None, answers)


def base():
    return [msg("system", "prompt"), msg("user", "weather?"), msg("assistant", None, [("x9", "get_weather", '{"lang": "zh_CN"}')]), msg("tool", "sunny", None, "x9"), msg("assistant", "It is sunny")]


def trace(name, messages=None, complete=True, internal=None, turns=("weather?",), sha=None):
    return (name, (list(turns),), (complete, sha, internal), base() if messages is None else messages)


def replaced(k, m):
    b = base()
    b[k] = m
    return b


CASES = {
    None: trace("ok"),
    "incomplete_trace": trace("a", complete=False),
    "runtime_injected_messages": trace("b", internal=[1]),
    "missing_initial_system": trace("c", base()[1:]),
    "invalid_system": trace("d", replaced(0, msg("system", None))),
    "system_hash_mismatch": trace("e", sha="0" * 64),
    "missing_tool_response": trace("f", base()[:3] + base()[4:]),
    "orphan_or_duplicate_tool_response": trace("g", replaced(3, msg("tool", "sunny", None, "other"))),
    "unfinished_conversation": trace("h", base()[:4]),
    "user_turns_mismatch": trace("i", turns=("other",)),
    "invalid_message_role": trace("j", replaced(1, msg("robot", "weather?"))),
    "empty_message": trace("k", replaced(4, msg("assistant", ""))),
    "invalid_user_order": trace("l", [msg("system", "p"), msg("user", "weather?"), msg("user", "again"), msg("assistant", "x")]),
    "invalid_assistant_order": trace("m", [msg("system", "p"), msg("user", "weather?"), msg("assistant", "x"), msg("assistant", "y")]),
    "invalid_tool_calls": trace("n", replaced(1, msg("user", "weather?", [("q", "get_weather", "{}")]))),
    "invalid_tool_type": trace("o", replaced(2, ("assistant", None, [("x9", "other", ("get_weather", "{}"))], None))),
    "duplicate_or_missing_tool_id": trace("p", replaced(2, msg("assistant", None, [("", "get_weather", "{}")]))),
}


def test_each_structure_rule(spark):
    rows = spark.createDataFrame(list(CASES.values()), SCHEMA)
    got = {r["sample_id"]: r["reason"] for r in tr.validate(rows).collect()}
    assert got == {t[0]: code for code, t in CASES.items()}


def test_normalised_messages(spark):
    two = [msg("system", "p"), msg("user", "u"), msg("assistant", None, [("b", "f", '{"z":1,"a":2}'), ("a", "g", "{}")]), msg("tool", "1", None, "a"), msg("tool", "2", None, "b"), msg("assistant", "done")]
    out = tr.normalize(spark.createDataFrame([trace("t", two)], SCHEMA)).first()["messages"]
    assert [m["role"] for m in out] == ["user", "assistant", "tool", "tool", "assistant"]
    assert [(c["id"], c["function"]["name"], c["function"]["arguments"]) for c in out[1]["tool_calls"]] == [("call_1", "f", '{"a":2,"z":1}'), ("call_2", "g", "{}")]
    assert [m["tool_call_id"] for m in out[2:4]] == ["call_2", "call_1"]


def test_strict_argument_types(spark):
    tools = spark.createDataFrame([("f", "b", "boolean", True, None), ("f", "s", "string", False, ['"on"', '"off"']), ("f", "i", "integer", False, None), ("f", "l", "array", False, None)], "name string, param string, type string, required boolean, enum array<string>")
    cases = {
        '{"b":true}': None, '{"b":"false"}': "arguments_not_boolean", '{"b":0}': "arguments_not_boolean", "{}": "arguments_missing_required", '{"b":true,"x":1}': "arguments_unknown_property",
        '{"b":true,"s":1}': "arguments_not_string", '{"b":true,"s":"up"}': "arguments_invalid_enum", '{"b":true,"s":"on"}': None, '{"b":true,"i":true}': "arguments_not_integer",
        '{"b":true,"i":1.0}': "arguments_not_integer", '{"b":true,"l":{}}': "arguments_not_array", "[]": "arguments_not_object", "nope": "arguments_not_object",
    }
    calls = spark.createDataFrame([("f", a) for a in cases] + [("g", "{}")], "name string, arguments string")
    got = {(r["name"], r["arguments"]): r["issue"] for r in tr.argument_issues(calls, tools).collect()}
    assert got == {**{("f", a): i for a, i in cases.items()}, ("g", "{}"): "unknown_tool"}


def test_disposition_of_a_batch(spark):
    rows = spark.createDataFrame([("a", "x", None, False), ("b", "x", None, False), ("c", "x", None, True), ("d", "y", "runtime_injected_messages", False), ("e", "x", None, False)], "id string, digest string, reason string, failed boolean")
    got = {r["id"]: (r["disposition"], r["duplicate_of"]) for r in tr.disposition(rows).collect()}
    assert got == {"a": ("passed_sample", None), "b": ("duplicate", "a"), "c": ("failed_sample", None), "d": ("quarantine", None), "e": ("duplicate", "a")}


def test_distribution_and_empty_population(spark):
    ten = spark.range(1, 11).agg(*ag.distribution("id")).first()
    assert (ten["count"], ten["min"], ten["median"], ten["p90"], ten["max"]) == (10, 1, 5.5, 9, 10)
    none = spark.range(0).agg(*ag.distribution("id")).first()
    assert tuple(none) == (0, None, None, None, None)


def test_repeats(spark):
    rows = [("p", r, "pass") for r in range(1, 5)] + [("f", r, "fail") for r in range(1, 5)] + [("m", r, "pass" if r % 2 else "fail") for r in range(1, 5)] + [("i", r, "fail") for r in range(1, 4)] + [("e", r, "error") for r in range(1, 5)]
    attempts = spark.createDataFrame(rows, "task string, repeat int, status string")
    got = {r["task"]: r["category"] for r in ag.repeats(attempts, attempts.select("task").distinct()).collect()}
    assert got == {"p": "all_pass", "f": "all_fail", "m": "mixed", "i": "incomplete", "e": "incomplete"}


def test_quotas(spark):
    counts = spark.createDataFrame([("S01", 80), ("S02", 20)], "t string, n long")
    assert {r["t"]: r["quota"] for r in sd.largest_remainder(counts, "t", "n", 10).collect()} == {"S01": 7, "S02": 3}


def test_seed_fingerprints(spark):
    rows = [(1, "g", "P1", ["a  b"], "北京市", 1), (2, "h", "P2", ["a　b "], "北京市", 1), (3, "g", "P1", ["c"], "上海市", 1)]
    s = spark.createDataFrame(rows, "seed_id int, variable_group_id string, question_pattern_id string, user_turns array<string>, target_city string, target_day int")
    r = sd.wording_fingerprint(sd.semantic_fingerprint(s)).orderBy("seed_id").collect()
    assert r[0]["semantic"] == r[1]["semantic"] != r[2]["semantic"] and r[0]["wording"] == r[1]["wording"] != r[2]["wording"]


def test_padding_keeps_a_labelled_pad_id(spark):
    rows = spark.createDataFrame([(1, [5, 0], [-100, 0]), (1, [3], [3])], "b int, input_ids array<bigint>, labels array<bigint>")
    got = sorted((r["input_ids"], r["labels"], r["attention_mask"]) for r in fm.pad(rows, "b").collect())
    assert got == [([3, 0], [3, -100], [1, 0]), ([5, 0], [-100, 0], [1, 1])]
    assert fm.encoded_steps(606, 1, 8, 2.0, 0.05) == (152, 8)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "base", "day"), [("2026-1-5", "2026-03-01", "2026-01-05"), ("12月31日", "2026-01-01", "2025-12-31"), ("1月1日", "2025-12-31", "2026-01-01"), ("6月1日", "2026-01-01", None), ("2月30日", "2026-02-20", None), ("none", "2026-01-01", None)])
def test_dates(spark, text, base, day):
    got = one(spark, tx.resolve_date(F.lit(text), F.lit(base).cast("date")))
    assert got == (dt.date.fromisoformat(day) if day else None)


def test_places(spark):
    lit = F.lit
    assert one(spark, tx.same_city(lit(" 北京 市"), lit("北京")))
    assert not one(spark, tx.same_city(lit(None).cast("string"), lit("北京")))
    assert one(spark, tx.same_adm(lit("吉林省"), lit("吉林市")))
    assert one(spark, tx.same_qualified_location(lit("朝阳"), lit("朝阳区"), lit("北京"), lit("北京市")))
    assert not one(spark, tx.same_qualified_location(lit("朝阳"), lit("朝阳区"), lit("辽宁"), lit("北京市")))
    assert one(spark, tx.city_in_reply(lit("北京市"), lit("北京今天晴"))) and not one(spark, tx.city_in_reply(lit("北京市"), lit("上海")))


def test_weather_reports(spark):
    head, section = "您查询的位置是：北京市\n", "未来7天预报：\n"
    cases = {
        "hello": None, head: "missing_forecast_section", head + section: "empty_forecast", head + section + "1月2日：晴，气温 5~1°": "invalid_temperature_range",
        head + section + "1月2日 晴": "invalid_forecast_row", head + section + "8月2日：晴，气温 1~5°": "invalid_forecast_date", head + section + "1月2日：晴，气温 1~5°\n2026-01-02：雨，气温 1~5°": "duplicate_forecast_date",
    }
    rows = spark.createDataFrame([(t,) for t in cases] + [(head + section + "1月2日：多云，气温 -3.5至5℃\n（如需更多：x",)], "t string").select("t", tx.parse_report(F.col("t"), F.lit("2026-01-01").cast("date")).alias("r")).collect()
    for r in rows[:-1]:
        assert (r["r"] and r["r"]["error"]) == cases[r["t"]], r["t"]
    good = rows[-1]["r"]
    assert (good["city"], good["error"], [tuple(x) for x in good["forecast"]]) == ("北京市", None, [(dt.date(2026, 1, 2), "多云", -3.5, 5.0)])


def test_files(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"sample_id":"a","n":1}\n\n')
    with pytest.raises(files.SourceError):
        files.read_jsonl(spark, str(p), "sample_id string, n int")
    assert files.read_jsonl(spark, str(p), "sample_id string, n int", strict=False).count() == 1
    with pytest.raises(files.SourceError):
        files.read_sources(spark, [{"path": str(p), "scenario": "x"}] * 2, "sample_id string, n int")
    df = spark.createDataFrame([("é", 1), (None, 2)], "b string, a int")
    out = str(tmp_path / "out")
    assert files.save_once(df, out) and not files.save_once(df, out)
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']
    with pytest.raises(files.SourceError):
        files.save_once(df.limit(1), out)
    before = spark.createDataFrame(files.manifest(spark, out).collect())
    assert files.verify(spark, out, before).count() == 0
    changed = before.withColumn("sha256", F.lit("0"))
    assert {r["problem"] for r in files.verify(spark, out, changed).collect()} == {"changed"}
    log = tmp_path / "log.txt"
    log.write_text("start loaded=1\nstart loaded=2 loaded=3\n")
    assert [r["match"] for r in files.scan_log(spark, str(log), "start", r"loaded=(\d)").collect()] == ["2", "3"]
