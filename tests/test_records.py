"""Judge verdicts, score integrity, systems, presets and generated seeds."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import presets as pr
from gleaner.operators import records as rc
from gleaner.operators import weather_seeds as ws

PROOF = "array<struct<message_index:int,quote:string>>"


def test_judgments(spark):
    messages = spark.createDataFrame([("s", 0, "system", "rules"), ("s", 1, "user", "ask"), ("s", 2, "assistant", "claim")], "sample_id string, message_index int, role string, content string")
    keys = ["ok", "fact", "nobasis", "stale", "noreply", "odd", "missing", "twice"]
    requests = spark.createDataFrame([("s", k, [2], "claim_and_basis_v1") for k in keys], "sample_id string, key string, reply_indices array<int>, policy string")
    both, claim = [(1, "ask"), (2, "claim")], [(2, "claim")]
    rows = [("ok", "pass", "r", claim), ("fact", "fail", "r", both), ("nobasis", "fail", "r", claim), ("stale", "pass", "r", [(2, "other")]), ("noreply", "pass", "r", [(1, "ask")]),
            ("odd", "maybe", "r", claim), ("twice", "pass", "r", claim), ("twice", "pass", "r", claim), ("new", "pass", "r", claim)]
    results = spark.createDataFrame([("s", *r) for r in rows], f"sample_id string, key string, status string, reason string, evidence {PROOF}")
    got = {r["key"]: (r["code"], r["status"]) for r in rc.judgments(requests, results, messages).collect()}
    assert got == {
        "ok": (None, "pass"), "fact": (None, "fail"), "nobasis": ("missing_factuality_basis", None), "stale": ("invalid_judge_evidence", None), "noreply": ("invalid_judge_evidence", None),
        "odd": ("invalid_judge_status", None), "missing": ("missing_judge_item", None), "twice": ("invalid_judge_key", None), "new": ("invalid_judge_key", None),
    }


def test_score_integrity(spark):
    names = ["good", "noscore", "who", "part", "open", "bare", "empty", "stale", "status"]
    samples = spark.createDataFrame([(n, "seed", "S01") for n in names], "sample_id string, seed_id string, template_id string")
    scores = spark.createDataFrame([(n, "x" if n == "who" else "seed", "S01", "pass" if n == "status" else "fail") for n in names if n != "noscore"], "sample_id string, seed_id string, template_id string, status string")
    expected = spark.createDataFrame([(n, k) for n in names for k in ("1:C01", "1:C02")], "sample_id string, key string")
    proof = {"bare": [], "empty": [(0, "")], "stale": [(0, "gone")]}
    checks = spark.createDataFrame([(n, k, "error" if n == "open" else s, proof.get(n, [(0, "text")])) for n in names for k, s in (("1:C01", "pass"), ("1:C02", "fail")) if not (n == "part" and k == "1:C02")], f"sample_id string, key string, status string, evidence {PROOF}")
    messages = spark.createDataFrame([(n, 0, "some text") for n in names], "sample_id string, message_index int, text string")
    got = {r["sample_id"]: r["code"] for r in rc.score_integrity(samples, scores, expected, checks, messages).collect()}
    assert got == {"good": None, "noscore": "missing_score", "who": "score_identity_mismatch", "part": "incomplete_or_duplicate_score_checks", "open": "unresolved_score", "bare": "score_without_evidence",
                   "empty": "invalid_score_evidence", "stale": "stale_score_evidence", "status": "inconsistent_score_status"}


def test_system_is_rebuilt(spark):
    m, cat = rc.CATALOG_MARK, '[{"entity_id":"light.a","name":"A","controllable":true}]'
    rows = [("plain", "x", None, False), ("home", f"old{m}\n {cat}", cat, True), ("twice", f"{m}{m}{cat}", cat, True), ("other", f"{m}{cat}", "[]", True), ("loose", m + cat.replace("true", '"yes"'), cat.replace("true", '"yes"'), True), ("extra", m + cat.replace('"name"', '"state":"on","name"'), cat.replace('"name"', '"state":"on","name"'), True)]
    df = spark.createDataFrame(rows, "id string, s string, c string, h boolean").select("id", rc.rebuild_system(F.col("s"), F.col("c"), "prompt \n", F.col("h")).alias("r"))
    got = {r["id"]: (r["r"]["system"], r["r"]["code"]) for r in df.collect()}
    assert got == {"plain": ("prompt", None), "home": (f"prompt\n\n{m}\n {cat}", None), "twice": (None, "missing_visible_catalog"), "other": (None, "catalog_mismatch"), "loose": (None, "invalid_public_catalog"), "extra": (None, "invalid_public_catalog")}


def test_scenarios_and_types(spark):
    rows = [("T19", 1, "two_devices", ["HS01", "HS02"]), ("T18", 1, "two_devices", ["HS01"]), ("T18", 2, "two_devices", ["HS01"]), ("T01", 1, "mixed", ["HS15", "HS01"])]
    df = spark.createDataFrame(rows, "t string, n int, f string, s array<string>").select("t", "n", rc.turn_scenarios(F.col("s"), F.col("n"), F.col("t"), F.col("f")).alias("x"), rc.sample_type(F.col("t")).alias("y"))
    assert [(r["x"], r["y"]) for r in df.collect()] == [(["HS02", "HS14"], "negative"), (["HS01"], "negative"), (["HS14"], "negative"), (["HS15", "HS01"], "positive")]


def test_accounting_and_batches(spark):
    planned = spark.createDataFrame([("w", "a"), ("w", "b"), ("h", "c"), ("x", "d")], "scenario string, sample_id string")
    saved = spark.createDataFrame([("w", "a"), ("w", "b"), ("h", "c"), ("h", "c"), ("h", "z")], "scenario string, sample_id string")
    codes = spark.createDataFrame([("w", 0), ("h", 0), ("x", 1)], "scenario string, returncode int")
    got = {r["scenario"]: (r["saved"], r["unknown"], r["repeated"], r["status"]) for r in rc.accounting(planned, saved, codes).collect()}
    assert got == {"w": (2, 0, 0, "complete"), "h": (3, 1, 1, "incomplete"), "x": (0, 0, 0, "incomplete")}
    t, m = spark.createDataFrame([(0,), (1,), (5,)], "row_index int"), spark.createDataFrame([(0,), (2,), (5,)], "row_index int")
    assert {(r["row_index"], r["problem"]) for r in rc.batch_problems(t, m).collect()} == {(1, "missing_metadata"), (2, "missing_row"), (5, "index_out_of_range")}
    assert rc.markdown([{"a": None, "b": 0.5, "c": "x|y"}], ["a", "b", "c"]).splitlines()[-1] == "| — | 50.0% | x\\|y |"


def devices(*states):
    return [(f"light.{i}", f"L{i}", [], None, s, True) for i, s in enumerate(states)]


def test_presets(spark):
    p = spark.createDataFrame([("a", devices("on", "off")), ("b", devices("on", "off")), ("c", devices("off", "off")), ("d", devices("on", "off")[::-1])], f"preset string, devices {pr.DEVICES}")
    i = {r["preset"]: r["identity"] for r in pr.identity(p).collect()}
    assert i["a"] == i["b"] and len({i["a"], i["c"], i["d"]}) == 3  # names don't count, states and order do
    seeds = spark.createDataFrame([(1, "a", "f"), (2, "b", "f"), (3, "c", "f")], "seed_id int, preset string, semantic string")
    g = {r["seed_id"]: r["grounded"] for r in pr.grounded_fingerprint(seeds, p).collect()}
    assert g[1] == g[2] != g[3]
    lib = spark.createDataFrame([("x", '{"a":1,"b":2}'), ("x", '{"b":2,"a":1}'), ("y", "{}"), ("y", '{"z":1}')], "preset string, config string")
    assert {r["preset"]: r["conflict"] for r in pr.library(lib).collect()} == {"x": False, "y": True}
    v = pr.expand(p.withColumn("locked", F.array(F.lit("light.0")))).collect()
    assert v == pr.expand(p.withColumn("locked", F.array(F.lit("light.0")))).collect() and len({r["preset"] for r in v}) == len(v) > 8
    assert all("light.0" not in r["changed"] and {d["entity_id"] for d in r["devices"]} == {"light.0", "light.1"} for r in v)
    row = p.select(pr.public_catalog(F.col("devices"), F.array(F.lit("light.1"))).alias("c")).first()["c"]
    assert [d.asDict().keys() for d in row] == [{"entity_id", "name", "aliases", "room", "controllable"}]
    assert p.select(pr.remap(F.array(F.lit("x"), F.lit("y")), {"x": "y", "y": "x"}).alias("r")).first()["r"] == ["y", "x"]


WORDS = {
    "default_cities": ["a", "b", "c"], "province_cities": [("p", "a"), ("q", "b")], "ambiguous_places": [("n", "x", "nx"), ("n", "y", "ny")], "invalid_places": ["mars"], "weather_remarks": ["hot", "cold", "wet"],
    "other_requests": ["sing", "joke", "rhyme"], "vague_dates": ["then"], "cancel_texts": ["stop"], "detail_questions": [("rain", "when"), ("wind", "where")],
}
TURNS = {
    "S01": ("default_city query_kind", ["{query_text}?"]), "S02": ("default_city target_city query_kind date_mode target_day", ["{target_city}{day_text}{query_text}"]), "S03": ("weather_remark", ["{weather_remark}"]), "S04": ("other_request", ["{other_request}"]),
    "S05": ("target_city query_kind target_day date_mode other_request request_order", ["{first_clause}/{second_clause}"]), "S06": ("target_city query_kind start_day day_count", ["{target_city}{start_text}{day_count}"]),
    "S07": ("target_city query_kind vague_date_text target_day", ["{target_city}{vague_date_text}", "{day_text}"]), "S08": ("target_city query_kind days_ago", ["{past_text}{target_city}"]), "S09": ("target_city query_kind days_ahead", ["{future_text}{target_city}"]),
    "S10": ("target_city", ["{target_city}"]), "S11": ("province target_city query_kind target_day", ["{province}", "{target_city}"]), "S12": ("ambiguous_name target_adm target_city query_kind target_day", ["{ambiguous_name}", "{target_adm}"]),
    "S13": ("target_adm target_city query_kind target_day", ["{target_adm}{target_city}"]), "S15": ("invalid_location target_city query_kind target_day", ["{invalid_location}", "{target_city}"]), "S19": ("target_city query_kind first_day target_day", ["{first_day_text}", "{day_text}"]),
    "S20": ("first_city target_city query_kind target_day", ["{first_city}", "{target_city}"]), "S22": ("target_city target_day requested_field detail_question", ["{detail_question}"]),
    "S24": ("clarification_kind province target_city vague_date_text cancel_text", ["{clarification_subject}", "{cancel_text}"]),
}


def seed_templates(spark, names):
    rows = [(n, TURNS[n][0].split(), [[f"{k}{t}" for t in TURNS[n][1]] for k in "xyz"], ["R01", "O04"], n == "S24") for n in names]
    return spark.createDataFrame(rows, "template_id string, variables array<string>, patterns array<array<string>>, scenario_ids array<string>, target_only boolean")


def test_seeds_of_every_template_differ_by_group_and_hold_together(spark):
    s = ws.generate(seed_templates(spark, TURNS), spark.createDataFrame([tuple(WORDS.values())], ws.LEXICON), 3)
    rows = s.collect()
    assert len(rows) == len(TURNS) * 3 * 3 and len({r["seed_id"] for r in rows}) == len(rows) and sorted(map(repr, rows)) == sorted(map(repr, s.collect()))
    by = {}
    for r in rows:
        by.setdefault(r["template_id"], {}).setdefault(r["variable_group_id"], []).append(r)
        assert all("{" not in t for t in r["user_turns"]) and len(r["user_turns"]) == len(TURNS[r["template_id"]][1]) and len(set(r["scenario_ids"])) == len(r["scenario_ids"])
        v = r["variables"]
        if r["template_id"] in ("S02", "S05", "S06", "S11", "S12", "S15", "S22") and r["target_city"]:
            assert r["target_city"] != r["default_city"]
        if r["template_id"] == "S06":
            assert r["target_days"] == list(range(int(v["start_day"]), int(v["start_day"]) + int(v["day_count"]))) and 2 <= int(v["day_count"]) <= 4 and r["target_days"][-1] <= 6
        if r["template_id"] == "S11":
            assert (v["province"], r["target_city"]) in WORDS["province_cities"] and {"L04", "M01", "F01"} & set(r["scenario_ids"])
        if r["template_id"] == "S19":
            assert int(v["first_day"]) != r["target_day"]
        if r["template_id"] == "S24":
            assert ("L04" in r["scenario_ids"]) == (v["clarification_kind"] == "city") == r["variable_group_id"].endswith(("1", "3")) and r["target_only"] and r["expect_follow"]
    for groups in by.values():
        chosen = [repr((sorted(g[0]["variables"].items()), g[0]["default_city"], g[0]["target_city"], g[0]["target_day"])) for g in groups.values()]
        assert len(groups) == 3 and len(set(chosen)) == 3
    assert {r["target_day"] for g in list(by["S02"].values()) for r in g} == {0, 1, 6}


def test_too_few_words_are_an_error(spark):
    words = spark.createDataFrame([tuple(WORDS.values())], ws.LEXICON)
    assert ws.generate(seed_templates(spark, ["S03"]), words, 3).count() == 9
    with pytest.raises(ValueError, match="too few words.*S03"):
        ws.generate(seed_templates(spark, ["S03", "S06"]), words, 4, rounds=12)
    fixed = ws.generate(seed_templates(spark, ["S01"]), words, 5, default_city="Z").collect()  # five kinds of questions in a fixed city
    assert {r["default_city"] for r in fixed} == {"Z"} and len({r["variables"]["query_kind"] for r in fixed}) == 5
    lacking = seed_templates(spark, ["S03"]).withColumn("patterns", F.array(F.array(F.lit("{nothing}"))))
    with pytest.raises(Exception, match="lacks a variable"):
        ws.generate(lacking, words, 1).collect()


def test_rotation_of_wordings(spark):
    s = ws.generate(seed_templates(spark, ["S01", "S02"]), spark.createDataFrame([tuple(WORDS.values())], ws.LEXICON), 6)
    worded = s.withColumn("user_turns", F.array("seed_id"))
    got = pr.rotate_patterns(worded, worded.limit(0)).orderBy("template_id", "variable_group_id").collect()
    assert [r["question_pattern_id"] for r in got][:4] == ["P1", "P2", "P3", "P1"] and not any(r["reused"] for r in got)
    old = worded.where("seed_id = 'S01-G01-P1'")
    assert pr.rotate_patterns(worded, old).where("variable_group_id = 'S01-G01'").first()["question_pattern_id"] == "P2"
