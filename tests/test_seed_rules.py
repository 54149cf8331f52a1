"""Seed contracts, preset eligibility, template rules, quotas and variants."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import home_seeds as hs
from gleaner.operators import presets as pr
from gleaner.operators import seeds as sd
from gleaner.sources import files

DEV = "array<struct<entity_id:string,desired_state:string>>"
S = (f"name string, design_version string, template_id string, variant_id string, request_form string, question_pattern_id string, preset string, seed_id string, variable_group_id string, user_turns array<string>, "
     f"scenario_ids array<string>, target {DEV}, first_target {DEV}, selector struct<kind:string,index:int,entity_id:string>, fields array<string>, scenes array<array<string>>")


def seed(name, tid="T01", variant=None, form=None, pattern="P1", preset="p", turns=("do",), scenes=(("HS01",),), ids=("HS01",), target=(("a", "on"),), first=None, selector=None, fields=("seed_id",), version="v"):
    return (name, version, tid, variant, form, pattern, preset, "s", "g", list(turns), list(ids), list(target) if target is not None else None, first, selector, list(fields), [list(x) for x in scenes] if scenes else None)


def test_home_seed_rules(spark):
    rows = [
        seed("ok"), seed("invalid_version_or_template", version="old"), seed("invalid_version_or_template/2", scenes=None), seed("deprecated_field", fields=("seed_id", "random_seed")), seed("invalid_question_pattern", pattern="P4"), seed("invalid_question_pattern/2", pattern=None),
        seed("missing_identity", preset=""), seed("invalid_request_form", form="mixed"), seed("invalid_request_form/2", "T18", form="three"), seed("missing_target_selector", "T11"), seed("query_after_error_shape", "T20", "query_after_error"),
        seed("turn_count_mismatch", turns=("a", "b")), seed("turn_count_mismatch/2", turns=(" ",)), seed("scenario_set_mismatch", ids=("HS02",)), seed("ok/2", "T19", form="two_devices", target=(("a", "on"), ("b", "off")), ids=("HS14",)),
        seed("ok/3", "T18", form="mixed", ids=("HS15", "HS01")), seed("invalid_target", target=(("a", "on"), ("b", "on"), ("c", "on"))), seed("invalid_target/2", target=None), seed("invalid_target_state", target=(("a", "dim"),)), seed("invalid_entity_id", target=(("", "on"),)),
        seed("duplicate_target", "T13", target=(("a", "on"), ("a", "off"))), seed("invalid_selector", "T11", selector=("displayed_index", 3, None), target=((None, "on"),)), seed("ok/4", "T11", selector=("displayed_index", 2, None), target=((None, "on"),)),
        seed("invalid_selector/2", "T11", selector=("exclude", None, ""), target=((None, "on"),)), seed("missing_first_target", "T05"), seed("missing_first_target/2", "T07", "change_action"), seed("target_count_mismatch", "T13"), seed("prefilled_choice", "T11", selector=("displayed_index", 2, None)),
        seed("target_state_mismatch", "T02"), seed("target_state_mismatch/2", target=(("a", None),)), seed("ok/5", "T02", target=(("a", None),)), seed("ok/6", "T17", target=(), first=[("a", "on")]), seed("entity_not_in_preset", target=(("z", "on"),)),
        seed("entity_not_in_preset/2", "T11", selector=("exclude", None, "z"), target=((None, "on"),)),
    ]
    df = spark.createDataFrame(rows, S)
    got = {r[0]: r[1] for r in df.select("name", hs.problem("v", F.array(F.lit("a"), F.lit("b")))).collect()}
    assert got == {n: None if n.startswith("ok") else n.split("/")[0] for n in got} and len(got) == len(rows)


def test_rows_that_are_or_hold_a_seed(spark):
    raws = ['{"template_id":"S01","x":1}', '{"seed":{"template_id":"S02"},"messages":[]}', '{"seed":null,"template_id":"S03"}', "[1]", '{"x":1}', "no"]
    got = hs.polymorphic(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()
    assert [(r["seed"], r["problem"]) for r in got] == [('{"template_id":"S01","x":1}', None), ('{"template_id":"S02"}', None)] + [(None, "seed_without_template")] * 4


def test_which_presets_suit_a_template(spark):
    lamp, plug, fixed = ("灯", True), ("插座", True), ("开关", False)
    presets = [("two", False, [lamp, lamp], False, 0), ("pair", False, [lamp, plug], False, 0), ("three", False, [lamp] * 3, False, 0), ("none", False, [fixed], False, 0), ("down", True, [lamp], True, 0), ("fault", True, [lamp], False, 2)]
    p = spark.createDataFrame(presets, "preset string, special boolean, devices array<struct<name:string,controllable:boolean>>, faulty boolean, n_rules int")
    t = spark.createDataFrame([("T01", None), ("T05", None), ("T07", None), ("T11", "exclude"), ("T14", None), ("T17", "no_action"), ("T19", None), ("T20", None)], "template_id string, variant_id string")
    got = {}
    for r in hs.eligible(p, t).where("eligible").collect():
        got.setdefault(r["template_id"], set()).add(r["preset"])
    assert got == {"T01": {"two", "pair", "three"}, "T05": {"two", "pair", "three"}, "T07": {"two", "three"}, "T11": {"two"}, "T14": {"three"}, "T17": {"two", "pair", "three"}, "T19": {"down"}, "T20": {"fault"}}


def test_weather_templates(spark):
    good = [["a"], ["b"], ["c", "d"]]
    rows = [(0, "S01", good, 1, 1, ["R01"]), (1, "S02", [["a"], ["a"], ["b"]], 1, 1, ["R01"]), (2, "S09", good, 1, 1, ["R01"]), (3, "S04", [["a"], [""], ["b"]], 1, 1, ["R01"]), (4, "S05", good, 0, 1, ["R01"]), (5, "S06", good[:2], 1, 1, ["R01"])]
    df = spark.createDataFrame(rows, "place int, template_id string, patterns array<array<string>>, n_variables int, n_constraints int, scenario_ids array<string>")
    got = {tuple(r) for r in hs.template_problems(df, ["S01", "S02", "S03", "S04", "S05", "S06"], {k: [1] for k in hs.LEXICON[1:]}).collect()}
    assert got == {("S02", "equal_patterns"), ("S09", "template_ids_differ"), ("S04", "empty_pattern"), ("S05", "missing_parts"), ("S06", "not_three_patterns"), ("S03", "template_missing"), (None, "lexicon_lacks:default_cities")}


def test_quotas_with_collisions_and_refill(spark):
    c = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "old"), ("a", 4, "y"), ("a", 5, "z"), ("b", 1, "x")], "t string, k int, f string").withColumn("quota", F.lit(2))
    old = spark.createDataFrame([("old",)], "f string")
    got = {(r["t"], r["k"]): (r["state"], r["place"]) for r in sd.fill_quota(c, "t", ["k"], semantic="f", excluded=old).collect()}
    assert got == {("a", 1): ("accepted", 1), ("a", 2): ("evaluation_semantic", None), ("a", 3): ("source_semantic", None), ("a", 4): ("accepted", 2), ("a", 5): ("not_needed", None), ("b", 1): ("accepted", 1)}
    quotas = spark.createDataFrame([("a", 3), ("b", 1)], "t string, quota int")
    batch = lambda n: spark.createDataFrame([("a", 0, f"f{n}"), ("a", 1, "same"), ("b", 0, "b")], "t string, k int, f string")
    done = sd.fill_until(batch, quotas, "t", ["k"], "f", old, 5)
    assert {(r["t"], r["f"], r["attempt"]) for r in done.where("state = 'accepted'").collect()} == {("a", "f0", 0), ("a", "same", 0), ("a", "f1", 1), ("b", "b", 0)}
    with pytest.raises(ValueError, match="quota_shortage: a lacks 1"):
        sd.fill_until(lambda n: batch(0), quotas, "t", ["k"], "f", old, 3)


def test_apportioned_groups(spark):
    counts = spark.createDataFrame([("S01", 80), ("S02", 20)], "t string, n long")
    assert {r["t"]: r["quota"] for r in sd.apportion(counts, "t", "n", 0.3).collect()} == {"S01": 7, "S02": 3}
    assert {r["t"]: r["quota"] for r in sd.apportion(counts, "t", "n", 0.01).collect()} == {"S01": 1, "S02": 1}
    with pytest.raises(ValueError):
        sd.apportion(counts, "t", "n", 0.0)


def test_median_prefers(spark):
    df = spark.createDataFrame([("g", "a-P1"), ("g", "b-P2"), ("g", "c-P2"), ("h", "d-P1"), ("h", "e-P3")], "g string, id string")
    assert {r["g"]: r["id"] for r in sd.median_pick(df, "id", "g", F.col("id").endswith("P2")).collect()} == {"g": "c-P2", "h": "e-P3"}


def test_variants_move_faults(spark):
    dev = [("light.a", "灯", None, "r", "on", True), ("light.b", "灯", None, "r", "off", True), ("light.c", "灯", None, "r", "on", True), ("fan.d", "扇", None, "r", "on", False)]
    df = spark.createDataFrame([("p", dev, ["light.a"]), ("q", dev, [])], f"preset string, devices {pr.DEVICES}, locked array<string>")
    rows = pr.expand(df).collect()
    old = {d[0]: d[4] for d in dev}
    for r in rows:
        now = {d["entity_id"]: d["state"] for d in r["devices"]}
        flipped = {e: ("off" if old[e] == "on" else "on") if e in r["changed"] else old[e] for e in old}
        if r["moved_from"]:
            assert int(r["preset"][-2:]) % 2 == 0 and r["moved_from"] == "light.a" and r["moved_to"] in ("light.b", "light.c")
            a, b = r["moved_from"], r["moved_to"]
            flipped[a], flipped[b] = flipped[b], flipped[a]
        assert now == flipped and "light.a" not in (r["changed"] if r["derived_from"] == "p" else []) and "fan.d" not in r["changed"]
    assert sum(r["moved_from"] is not None for r in rows) == 4
    text = json.dumps({"light.a": {"to": "light.b", "note": "light.a now"}, "x": ["light.b"]})
    out = spark.createDataFrame([(text,)], "t string").select(pr.remap_json(F.col("t"), {"light.a": "light.b", "light.b": "light.a"}), pr.swap(F.col("t"), F.lit("light.a"), F.lit("light.b"))).first()
    assert json.loads(out[0]) == json.loads(out[1]) == {"light.b": {"to": "light.a", "note": "light.a now"}, "x": ["light.a"]}


def test_globs_and_documents(spark, tmp_path):
    for name, rows in (("a", '{"x":1}\n{"x":2}\n'), ("b", "\n")):
        (tmp_path / f"{name}-seeds.json").write_text(rows)
    rows = files.read_many(spark, str(tmp_path / "*-seeds.json"), "x int")
    assert {(r["file"][-12:], r["rows"]) for r in files.file_counts(spark, str(tmp_path / "*-seeds.json"), rows).collect()} == {("a-seeds.json", 2), ("b-seeds.json", 0)}
    (tmp_path / "c-seeds.json").write_text("broken\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_many(spark, str(tmp_path / "*-seeds.json"), "x int").collect()
    files.write_json_pretty([{"é": 1}], str(tmp_path / "out.json"))
    assert (tmp_path / "out.json").read_text() == '[\n  {\n    "é": 1\n  }\n]\n'
    with pytest.raises(FileExistsError):
        files.write_json_pretty([], str(tmp_path / "out.json"))
