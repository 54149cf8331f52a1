"""The export: the batch of five, schemas with nested objects, and reasons in the order of the messages."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import export as ex
from gleaner.operators import schemas as sc
from gleaner.operators import traces as tr
from gleaner.plans import registry

WEATHER = {"type": "function", "function": {"name": "get_weather", "parameters": {"type": "object", "properties": {"lang": {"type": "string", "enum": ["zh_CN", "en"]}, "now": {"type": "boolean"}}, "required": ["lang"]}}}
SET = {"type": "function", "function": {"name": "set", "parameters": {"type": "object", "required": ["entity_id", "state"], "properties": {
    "entity_id": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "state": {"type": "object", "required": ["type"], "properties": {"type": {"type": "string", "enum": ["turn_on", "turn_off"]}, "level": {"type": "integer"}}}}}}}


def msg(role, content=None, calls=None, answers=None):
    return (role, content, [(i, "function", (n, a)) for i, n, a in calls] if calls else None, answers)


def base(name="get_weather", arguments='{"lang": "zh_CN"}', call="x9"):
    return [msg("system", "old"), msg("user", "weather?"), msg("assistant", None, [(call, name, arguments)]), msg("tool", "sunny", None, call), msg("assistant", "It is sunny")]


def score(status="pass", seed="s", quote="sunny", at=3, keys=("1:C01",)):
    return (seed, "T", status, [(k, status, [(at, quote)]) for k in keys])


def entry(name, messages=None, sc_=None, internal=None, tools=(WEATHER,), review=False, scenario="weather", expected=("1:C01",), turns=("weather?",)):
    return (f"{scenario}:{name}", scenario, messages or base(), (True, internal, None, None), ("s", "T", list(turns)), json.dumps(list(tools)) if tools is not None else None, sc_ or score(), list(expected), review)


SCHEMA = f"id string, scenario string, messages {tr.MESSAGES}, context {ex.CONTEXT}, seed {ex.SEED}, tools string, score {ex.SCORE}, expected array<string>, require_review boolean"


def run(spark, rows, target=(WEATHER,), reviews=None):
    e = spark.createDataFrame(rows, SCHEMA).withColumn("tools", sc.definitions(F.col("tools")))
    return {r["id"].split(":")[1]: r for r in ex.export(e, json.dumps(list(target)), "new prompt \n", reviews).collect()}


def test_the_batch_of_five(spark):
    extra = {**WEATHER, "function": {**WEATHER["function"], "name": "other"}}
    rows = [
        entry("a"), entry("b", base(call="y1")), entry("c", base("invented_tool"), score("fail")), entry("d", internal=[2]), entry("e", tools=(WEATHER, extra)),
    ]
    got = run(spark, rows)
    assert {k: (r["disposition"], r["duplicate_of"]) for k, r in got.items()} == {
        "a": ("passed_sample", None), "b": ("duplicate", "weather:a"), "c": ("failed_sample", None), "d": ("quarantine", None), "e": ("duplicate", "weather:a")}
    assert got["d"]["reason"] == "runtime_injected_messages" and [tuple(i) for i in got["c"]["invalid_actions"]] == [("invented_tool", "unknown_tool")]
    assert [tuple(i) for i in got["c"]["target_invalid_actions"]] == [("invented_tool", "tool_missing_from_target_list")] and got["c"]["failed_checks"] == ["1:C01"]
    assert got["a"]["messages"][0]["content"] == "new prompt" and got["a"]["messages"][2]["tool_calls"][0]["id"] == "call_1" and got["a"]["tool_provenance"] == "saved_trace"
    narrow = run(spark, rows, target=(SET,))
    assert [narrow[k]["disposition"] for k in "abde"] == ["quarantine"] * 4 and narrow["a"]["reason"] == "target_tool_incompatible:tool_missing_from_target_list"
    df = spark.createDataFrame([(r["id"], r["scenario"], r["disposition"]) for r in got.values()], "id string, scenario string, disposition string")
    assert [tuple(r) for r in ex.row_index(df).collect()] == [("weather:a", 0)]
    total = ex.disposition_problem(df).first()
    assert (total["rows"], total["passed_sample"], total["failed_sample"], total["duplicate"], total["quarantine"], total["sound"]) == (5, 1, 1, 2, 1, True)


def test_reasons_in_order(spark):
    bad_call = base(arguments='{"lang":"zh_CN","now":0}')
    two = base()
    two[3] = msg("tool", "sunny", None, "nobody")
    two[4] = msg("assistant", "")
    late = [*base()[:4], msg("assistant", None, [("x9", "get_weather", '{"lang":"en"}')]), msg("tool", "t", None, "q")]
    rows = [
        entry("strict", bad_call), entry("lenient", bad_call, score("fail")), entry("none", tools=None, scenario="home_switch"), entry("shape", tools=({"type": "x"},)), entry("same", tools=(WEATHER, WEATHER)),
        entry("noscore", sc_=("x", "T", "pass", [])), entry("part", expected=("1:C01", "1:C02")), entry("stale", sc_=score(quote="rain")), entry("odd", sc_=score(at=9)), entry("call", sc_=score(quote='"name": "get_weather"', at=2)),
        entry("status", sc_=("s", "T", "pass", [("1:C01", "fail", [(3, "sunny")])])), entry("first", two), entry("again", late), entry("json", base(arguments="{nope")),
    ]
    got = {k: r["reason"] for k, r in run(spark, rows).items()}
    assert got == {
        "strict": "arguments_not_boolean", "lenient": None, "none": "missing_home_tool_snapshot", "shape": "invalid_tool_definitions", "same": "duplicate_or_missing_tool_name", "noscore": "score_identity_mismatch",
        "part": "incomplete_or_duplicate_score_checks", "stale": "stale_score_evidence", "odd": "invalid_score_evidence", "call": None, "status": "inconsistent_score_status", "first": "orphan_or_duplicate_tool_response",
        "again": "duplicate_or_missing_tool_id", "json": "invalid_arguments_json",
    }


def test_reviews_can_only_demote(spark):
    rows = [entry(k, review=k != "e", turns=("weather?",)) for k in "abcdef"] + [entry("bad", base("invented_tool"), score("fail"), review=True)]
    e = spark.createDataFrame(rows, SCHEMA)
    sha = {r["id"]: r["d"] for r in e.select("id", ex.sample_digest(e).alias("d")).collect()}
    said = [("a", "accept", "fine", None), ("b", "quarantine", "guess", None), ("c", "accept", " ", None), ("d", "maybe", "x", None), ("f", "accept", "fine", "0")]
    reviews = spark.createDataFrame([(f"weather:{k}", d, why, s or sha[f"weather:{k}"]) for k, d, why, s in said], "id string, decision string, reason string, source_sample_sha256 string")
    got = {k: r["reason"] for k, r in run(spark, rows, reviews=reviews).items()}
    assert got == {"a": None, "b": "evidence_review:guess", "c": "missing_evidence_review_reason", "d": "invalid_evidence_review_decision", "e": None, "f": "evidence_review_source_mismatch", "bad": None}


@pytest.mark.parametrize(("arguments", "code"), [
    ('{"entity_id":"a","state":{"type":"turn_on"}}', None), ('{"entity_id":"a","state":{"type":"dim"}}', "arguments_invalid_enum"), ('{"entity_id":"a","state":{}}', "arguments_missing_required"),
    ('{"entity_id":"a","state":{"type":"turn_on","x":1}}', "arguments_unknown_property"), ('{"entity_id":"a","state":"on"}', "arguments_not_object"), ('{"entity_id":"a","state":{"type":"turn_on","level":true}}', "arguments_not_integer"),
    ('{"entity_id":"a","state":{"type":"turn_off"},"tags":["x",1]}', "arguments_not_string"), ('{"entity_id":"a","state":{"type":"turn_off"},"tags":{}}', "arguments_not_array"), ('{"entity_id":null,"state":{"type":"turn_off"}}', "arguments_not_string"), ('[]', "arguments_not_object"),
])
def test_nested_arguments(spark, arguments, code):
    df = spark.createDataFrame([(arguments, json.dumps([SET]))], "a string, t string")
    assert df.select(sc.issue(F.lit("set"), F.col("a"), sc.definitions(F.col("t")))).first()[0] == code


def test_evidence_quotes(spark):
    long = "x" * 600
    df = spark.createDataFrame([([*base(), msg("user", long)],)], f"m {tr.MESSAGES}")
    got = [tuple(e) for e in df.select(ex.evidence(F.col("m"), F.array(F.lit(2), F.lit(4), F.lit(2), F.lit(5)))).first()[0]]
    calls = json.dumps([{"id": "x9", "type": "function", "function": {"name": "get_weather", "arguments": '{"lang": "zh_CN"}'}}], ensure_ascii=False)
    assert got == [(2, calls), (4, "It is sunny"), (5, long[:500])]


def test_home_catalog_and_hash(spark):
    from gleaner.operators.records import CATALOG_MARK

    catalog = json.dumps([{"entity_id": "light.a", "name": "灯", "controllable": True}], ensure_ascii=False)
    m = base()
    m[0] = msg("system", f"old\n\n{CATALOG_MARK}\n{catalog}")
    good = list(entry("h", m, scenario="home_switch"))
    good[3] = (True, None, hashlib.sha256(m[0][1].encode()).hexdigest(), catalog)
    other = [*good]
    other[0], other[3] = "home_switch:x", (True, None, None, "[]")
    got = run(spark, [tuple(good), tuple(other)])
    assert got["h"]["disposition"] == "passed_sample" and got["h"]["messages"][0]["content"] == f"new prompt\n\n{CATALOG_MARK}\n{catalog}"
    assert got["x"]["reason"] == "catalog_mismatch"


@pytest.mark.parametrize(("name", "most"), [("prj_export", 60_000), ("fmt_render_tools", 120_000), ("flt_target_compat", 120_000)])
def test_plans_stay_small(spark, name, most):
    """Rules read what is settled; no plan repeats its own input in each of them."""
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < most


def first_fault(value, schema):
    """The rules by the book, as a generator of faults in the order in which a reader meets them."""
    kind = schema.get("type")
    fits = {"object": dict, "array": list, "string": str}.get(kind)
    if fits and not isinstance(value, fits) or kind == "boolean" and value is not True and value is not False or kind == "integer" and type(value) is not int:
        yield f"arguments_not_{kind}"
    if kind == "object":
        known = schema.get("properties", {})
        if not set(schema.get("required", [])) <= set(value):
            yield "arguments_missing_required"
        if not set(value) <= set(known):
            yield "arguments_unknown_property"
        for k, v in value.items():
            yield from first_fault(v, known[k])
    if kind == "array":
        for v in value:
            yield from first_fault(v, schema.get("items", {}))
    if "enum" in schema and value not in schema["enum"]:
        yield "arguments_invalid_enum"


def test_schemas_of_any_depth_against_a_walk(spark):
    draw = random.Random(12)

    def schema(depth):
        kind = draw.choice(["object", "object", "array", "array", "string", "integer", "boolean", None] if depth else ["string", "integer", "boolean"])
        s = {"type": kind} if kind else {}
        if kind == "object":
            s["properties"] = {k: schema(depth - 1) for k in draw.sample(["a", "b.c", "[]", "é", "z"], draw.randrange(1, 4))}
            s["required"] = [k for k in s["properties"] if draw.random() < 0.5]
        elif kind == "array" and draw.random() < 0.9:
            s["items"] = schema(depth - 1)
        elif kind in ("string", "integer") and draw.random() < 0.4:
            s["enum"] = ["x", "y", 1, 2]
        return s

    def value(s, depth):
        if draw.random() < 0.04 or not s.get("type"):
            return draw.choice([None, 1, 1.0, "x", True, [], {}, {"a": [1]}, "1", 10**25, -0.5])
        if s["type"] == "object":
            found = {k: value(v, depth - 1) for k, v in s["properties"].items() if k in s["required"] or draw.random() < 0.6}
            items = list(found.items()) + ([("more", 1)] if draw.random() < 0.03 else [])
            draw.shuffle(items)
            return dict(items[1:] if draw.random() < 0.03 else items)
        if s["type"] == "array":
            return [value(s.get("items", {}), depth - 1) for _ in range(draw.randrange(4))]
        return {"string": draw.choice(["x", "y", "w"]) if draw.random() < 0.2 else "x", "integer": draw.choice([1, 2, 7]) if draw.random() < 0.2 else 2, "boolean": draw.random() < 0.5}[s["type"]]

    tools, rows = [], []
    for k in range(25):
        s = {"type": "object", "properties": {"top": schema(5)}, "required": ["top"]}
        tools.append({"type": "function", "function": {"name": f"t{k}", "parameters": s}})
        for _ in range(20):
            v = value(s, 6)
            rows.append((f"t{k}", json.dumps(v, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])), next(first_fault(v, s), None)))
    df = spark.createDataFrame(rows, "name string, arguments string, want string").withColumn("tools", sc.definitions(F.lit(json.dumps(tools))))
    got = df.select("name", "arguments", "want", sc.issue(F.col("name"), F.col("arguments"), F.col("tools")).alias("issue")).collect()
    assert [(r["name"], r["arguments"], r["issue"]) for r in got if r["issue"] != r["want"]] == []
    assert len({r["issue"] for r in got}) >= 8
    null = df.limit(1).select(sc.issue(F.lit("t0"), F.lit(None).cast("string"), F.col("tools")).alias("a"), sc.issue(F.lit("t0"), F.lit("no json"), F.col("tools")).alias("b"), sc.issue(F.lit("else"), F.lit("{}"), F.col("tools")).alias("c")).first()
    assert tuple(null) == ("arguments_not_object", "arguments_not_object", "unknown_tool")


ODD = {"type": "object", "properties": {"a": {"type": "string"}, "it's": {"type": "boolean"}, "n": {"type": "object", "properties": {"x": {"type": "string"}, "'": {"type": "integer"}}}, "e": {"enum": ["'m", 'q"u', "\\", "é\n", None, {"a": [1, "'z"]}]}}}


@pytest.mark.parametrize(("arguments", "code"), [
    ('{"n":{"x":1E400}}', "arguments_not_string"), (' \n\t{"a":"x"} ', None), ('{"n":{"x":"{\\"","\'":3}}', None), ('{"n":{"x":"\\\\\\"["},"a":1}', "arguments_not_string"), ('{"it\'s":true}', None), ('{"it\'s":"true"}', "arguments_not_boolean"),
    *[('{"e":%s}' % json.dumps(v), None) for v in ODD["properties"]["e"]["enum"]], *[('{"e":%s}' % json.dumps(v), "arguments_invalid_enum") for v in ("m", "''m", "'", "", "null", {"a": [1, "z"]})],
    ('{"n":{"\'":1.0}}', "arguments_not_integer"), ('{"a":"' + '\\"{' * 20_000 + '"}', None), ('{"zz":1,"a":2}', "arguments_unknown_property"), ("'a'", "arguments_not_object"), ('"{}"', "arguments_not_object"),
])
def test_marks_of_strings_change_no_value(spark, arguments, code):
    tools = json.dumps([{"type": "function", "function": {"name": "f", "parameters": ODD}}])
    df = spark.createDataFrame([(arguments, tools)], "a string, t string")
    assert df.select(sc.issue(F.lit("f"), F.col("a"), sc.definitions(F.col("t")))).first()[0] == code


def test_arguments_are_parsed_once_and_not_written_again(spark):
    """Of a level, one parse of members and one of items; no value's canonical form but where an enum asks for it."""
    df = spark.createDataFrame([("{}", "[]")], "a string, t string").select("a", F.get(sc.definitions(F.col("t")), F.lit(0))["specs"].alias("specs"))
    plan = df.select(sc.argument_problem(F.col("a"), F.col("specs")).alias("p"))._jdf.queryExecution().analyzed().toString().split("\n+- ")[0]
    assert plan.count("from_json(") == 2
