"""Structure of traces, topics and reports."""

from gleaner.operators import inventory as iv
from gleaner.operators import reports as rp
from gleaner.operators import traces as tr


def test_inventory_of_two_traces(spark):
    def m(role, content=None, calls=None):
        return (role, content, [(i, "function", (n, a)) for i, n, a in calls] if calls else None, None)

    a = [m("system", "abc"), m("user", "u"), m("assistant", None, [("1", "f", "{}"), ("2", "f", '{"k":1}')]), m("tool", "t"), m("assistant", "x")]
    b = [*a, m("user", "hook")]
    df = spark.createDataFrame([("w", "a", a, (None, "r1"), 0), ("w", "b", b, ([5], ""), 0), ("h", "c", [], (None, None), 1)], f"scenario string, sample_id string, messages {tr.MESSAGES}, context struct<internal_message_indices:array<int>,run_id:string>, source_index int")
    got = {r["scenario"]: (r["samples"], r["single_turn"], r["multi_turn"], r["zero_turn"]) for r in iv.structure(df).collect()}
    assert got == {"w": (2, 2, 0, 0), "h": (1, 0, 0, 1), "all": (3, 2, 0, 1)}
    rows = {(r["scenario"], r["measure"]): tuple(r)[2:] for r in iv.lengths(df).collect()}
    assert rows["w", "messages"] == (2, 5, 5.5, 6, 6) and rows["w", "argument_characters"] == (4, 2, 4.5, 7, 7) and rows["all", "calls"] == (3, 0, 2.0, 2, 2) and rows["h", "body_characters"] == (1, 0, 0.0, 0, 0)
    assert {(r["scenario"], r["turns"], r["samples"]) for r in iv.turn_counts(df).collect()} == {("w", 1, 2), ("h", 0, 1)}
    assert {(r["source_index"], r["run_id"], r["samples"]) for r in iv.run_ids(df, "none").collect()} == {(0, "r1", 1), (0, "none", 1), (1, "none", 1)}


def test_topics_overlap(spark):
    r = spark.createDataFrame([("1", "h", "T03", "basic", "x", "d1", False), ("2", "h", "T03", "other", "x", "d1", True), ("3", "h", "T07", "basic", "y", "d2", False)], "id string, scenario string, template_id string, variant_id string, semantic string, dialogue string, failed boolean")
    t = spark.createDataFrame([("ref", "h", "T03"), ("ctl", "h", "T03"), ("ctl", "h", "T07"), ("w", "w", "T03")], "topic string, scenario string, template_id string")
    assert {tuple(x) for x in iv.topics(r, t).collect()} == {("ref", 2, 1, 1, 1, 2, 1), ("ctl", 3, 2, 2, 2, 2, 1)}


def test_reports():
    assert rp.cell(None) == "—" and rp.cell(0.5) == "50.0%" and rp.cell("a|b\nc") == "a\\|b c" and rp.cut("abcdef", 4) == "abc…"
    assert rp.reconciliation(5, 2, 3, 2).endswith("produced 2 + missing 1") and "does not" in rp.reconciliation(5, 2, 2, 2)
    text = rp.preparation(3, [{"disposition": "passed_sample", "traces": 2}], [{"scenario": "w", "samples": 3, "single_turn": 1, "multi_turn": 2, "zero_turn": 0}], [], [{"reason": "r", "traces": 1}])
    assert "3 traces: 2 for training, 0 failed" in text and "| w | 3 | 1 | 2 | 0 |" in text and "- `r`: 1" in text
    s = rp.scoring([{"check_id": "C01", "passed": 1, "failed": 0, "pass_rate": None}], [], [], [{"combination": "b", "samples": 1}, {"combination": "a", "samples": 1}], (1, 0, 1, 1))
    assert "| C01 | 1 | 0 | — |" in s and s.index("| a | 1 |") < s.index("| b | 1 |")
    assert "1 of 4 attempts scored" in rp.repeats([{"completed": 1, "category": "incomplete"}], 4)
    case = {"preset": "p", "rule_id": "r", "turn": 1, "entity_id": "e", "entity_name": "n", "outcome": "o", "configured": 2, "triggered": 1, "unused": 1, "trigger_rate": 0.5}
    assert "| p | r | 1 | n | o | 2 | 1 | 1 | 50.0% |" in rp.coverage([case], [])
