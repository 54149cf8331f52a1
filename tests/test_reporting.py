"""Scoring runs whose scorers fail, and reports as ordered lines."""

import pathlib

import pytest
from pyspark.sql import functions as F

from gleaner.operators import report_lines as rl
from gleaner.operators import scoring_run as sr

NAMES, PLANNED = {"C01": "calls", "C02": "ar|gs"}, {"L": 2, "M": 1}


def test_a_failing_scorer_loses_its_sample_only(spark):
    def rules(sample):
        yield 1, "C01", "pass", "first"
        if sample["kind"] == "refused":
            raise sr.ScoringError("judge_request", "no_judge", "none here", True)
        yield 2, "C02", "fail", str(1 // sample["n"])

    rows = [("a", '{"kind":"ok","n":1}'), ("b", '{"kind":"refused","n":1}'), ("c", '{"kind":"ok","n":0}'), ("d", "no json"), ("e", None), ("f", '{"kind":"ok","n":1}')]
    samples = spark.createDataFrame([(k, "T", s) for k, s in rows], "sample_id string, template_id string, sample string").repartition(3)
    got = sr.score(samples, rules)
    by = {}
    for r in got.collect():
        by.setdefault(r["sample_id"], []).append((r["check_id"], r["status"], r["error_code"], r["exception"]))
    sound = [("C01", "pass", None, None), ("C02", "fail", None, None)]
    assert sorted(by["a"]) == sorted(by["f"]) == sound
    assert by["b"] == [(None, None, "no_judge", "ScoringError")] and by["c"] == [(None, None, "unexpected_exception", "ZeroDivisionError")]
    assert by["d"] == [(None, None, "unexpected_exception", "JSONDecodeError")] and by["e"] == [(None, None, "unexpected_exception", "TypeError")]
    done = sr.completion(got).first()
    assert (done["samples"], done["completed"], done["errors"], done["passed"], done["completion_rate"]) == (6, 2, 4, 0, 2 / 6)
    assert sr.score(samples.where("sample_id = 'a'"), lambda s: []).first()["error_code"] == "empty_scenario_result"
    twice = samples.union(samples.where("sample_id = 'a'")).union(spark.createDataFrame([("", "T", None)], samples.schema))
    assert {(r["sample_id"], r["times"]) for r in sr.input_problems(twice).collect()} == {("a", 2), ("", 1)}


def tables(spark, checks, samples, errors=(), events=()):
    c = spark.createDataFrame(checks, "sample_id string, turn int, check_id string, status string, scenario_ids array<string>, reason string, evidence array<struct<message_index:int,quote:string>>")
    s = spark.createDataFrame(samples, "sample_id string, template_id string, status string")
    scenarios = c.select("sample_id", F.explode("scenario_ids").alias("scenario_id"), "status")
    return s, c, scenarios, spark.createDataFrame(list(events), "event string, reason_code string"), spark.createDataFrame(list(errors), "sample_id string, template_id string, stage string, error_code string, message string, detail string")


@pytest.mark.parametrize("parts", [1, 3])
def test_a_report_is_written_in_order(spark, tmp_path, parts):
    proofs = [(k, f"quote {k}\n" + "x" * 200) for k in range(3)]
    checks = [("s1", 1, "C01", "fail", ["L01"], "a|b\nc", proofs), ("s1", 2, "C02", "pass", ["M01"], "", []), ("s2", 1, "C01", "pass", ["L01"], "fine", [])]
    made = rl.scoring(*tables(spark, checks, [("s1", "T1", "fail"), ("s2", "T1", "pass")], [("s3", "T2", "judge", "lost", "m", None)], [("check_selected", None)] * 4 + [("check_filtered", "no_call_mode")]), NAMES, PLANNED)
    rl.write(made, f"{tmp_path}/r", parts)
    files = sorted(pathlib.Path(f"{tmp_path}/r").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    heads = [x for x in text.splitlines() if x.startswith("#")]
    assert heads == ["# Scores", "## Checks", "## Categories", "## Scenarios", "## Failures", "## Selection", "## Scoring errors", "## Failed samples", "### T1 (1)", "#### s1"]
    for line in [
        "| scored | 2/3 66.7% |", "| samples passed | 1/2 50.0% |", "| checks passed | 2/3 66.7% |", "| checks filtered | 1 |", "| C02 ar\\|gs | 1 | 0 | 100.0% |", "| L | 1/2 | 50.0% |", "| L01 | 1 | 1 | 50.0% |", "2 scored, 1 failed.",
        "| C01 | calls | 1 | 1 | 50.0% |", "| T2 | 1 | 0 | 1 | 0 | 0 | — |", "| C01 | 1 |", "| lost to errors | 1 |", "| `no_call_mode` | 1 | this turn may answer without a call |", "| s3 | T2 | judge | `lost` | m | — |", "Failed: C01",
        f"| 1 | C01 | L01 | a\\|b c | message 0: quote 0 {'x' * 131}…<br>message 1: quote 1 {'x' * 131}…<br>and 1 more |",
    ]:
        assert line in text.splitlines(), line
    assert text.index("| turn |") > text.index("Failed: C01") and text.rstrip().endswith("more |")
    with pytest.raises(Exception, match="(?i)exists"):
        rl.write(made, f"{tmp_path}/r")


def test_an_empty_run_has_a_report(spark):
    made = rl.scoring(*tables(spark, [], []), NAMES, PLANNED).orderBy("section", "place", "k").collect()
    lines = [r["line"] for r in made]
    assert "| scored | 0/0 |" in lines and "| C01 calls | 0 | 0 | — |" in lines and "| M | 0/1 | — |" in lines and "None." in lines


def test_only_the_ten_most_frequent_combinations_are_shown(spark):
    names = {f"C{k:02}": "n" for k in range(13)}
    checks = [(f"s{k}-{i}", 1, f"C{k:02}", "fail", ["L01"], "r", []) for k in range(13) for i in range(k + 1)]
    made = rl.scoring(*tables(spark, checks, [(c[0], "T", "fail") for c in checks]), names, PLANNED).where("section = 7").orderBy("place", "k").collect()
    rows = [r["line"] for r in made if r["line"].startswith("| C")]
    assert rows == [f"| C{k:02} | {k + 1} |" for k in range(12, 2, -1)] and made[-1]["line"] == "The first 10; 3 more."
