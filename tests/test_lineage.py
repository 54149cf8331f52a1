"""Guards: each problem by its code, and nothing for sound inputs."""

import pytest

from gleaner.operators import lineage as ln


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_training_batch(spark):
    make = lambda rows: spark.createDataFrame(rows, "row_index int, tools string")
    meta = lambda ids: spark.createDataFrame([(i,) for i in ids], "row_index int")
    assert pairs(ln.train_batch(make([(0, '[{"a":1,"b":2}]'), (1, '[{"b":2,"a":1}]')]), meta([0, 1]), '[{"a": 1, "b": 2}]', 2)) == set()
    got = pairs(ln.train_batch(make([(0, "[]"), (2, "[1]"), (9, "[]")]), meta([0, 2, 2, 5, 9]), "[]", 3))
    assert got == {(2, "row_without_its_pair"), (5, "row_without_its_pair"), (9, "index_out_of_range"), (None, "training_count_mismatch")}
    assert pairs(ln.train_batch(make([(0, "[1]")]), meta([0]), "[]", 1)) == {(0, "row_or_tools_mismatch")}


def test_prepared_batch(spark):
    audit = [("w:a", "w", "passed_sample"), ("w:b", "w", "failed_sample"), ("h:c", "h", "passed_sample")]
    meta, train = [("w:a", 0, "x"), ("h:c", 1, "y")], [(0, "x"), (1, "y")]
    sources, templates = [("w", "a", "S1"), ("w", "b", "S1"), ("h", "c", "T1")], [("w", "S1", 2), ("h", "T1", 1)]

    def bind(audit=audit, meta=meta, train=train, sources=sources, counts=(2, 3, 3), templates=templates):
        d = spark.createDataFrame
        return pairs(ln.prepared_bind(
            d(audit, "id string, scenario string, disposition string"), d(meta, "id string, row_index int, normalized_sha256 string"), d(train, "row_index int, digest string"), d(sources, "scenario string, sample_id string, template_id string"),
            d([counts], "train_samples int, source_samples int, inventory_total int"), d(templates, "scenario string, template_id string, samples int")))

    assert bind() == set()
    assert bind(counts=(3, 4, 3)) == {("batch", "training_count_mismatch"), ("batch", "source_count_mismatch")}
    assert bind(train=[(0, "x"), (1, "z")]) == {("h:c", "row_or_content_mismatch")}
    assert bind(templates=[("w", "S1", 1), ("h", "T1", 1), ("h", "T2", 4)]) == {("w:S1", "template_count_mismatch"), ("h:T2", "template_count_mismatch")}
    assert bind(meta=[("w:a", 0, "x"), ("w:b", 1, "y")]) == {("w:b", "metadata_without_audit"), ("h:c", "metadata_without_audit")}
    assert bind(sources=[*sources[:2], ("h", "d", "T1")]) == {("h:c", "source_audit_mismatch"), ("h:d", "source_audit_mismatch")}
    assert ("w:a", "duplicate_audit_id") in bind(audit=[*audit, audit[0]]) and ("w:a", "duplicate_source_id") in bind(sources=[*sources, sources[0]])
    with pytest.raises(ln.LineageError, match="row_or_content"):
        ln.require(spark.createDataFrame([("h:c", "row_or_content_mismatch")], "subject string, problem string"))


def test_patches_and_shards(spark):
    d = spark.createDataFrame
    m = d([("a", 0, "user", "hi"), ("a", 1, "assistant", "old"), ("b", 0, "user", "yo")], "sample_id string, message_index int, role string, content string")
    e = d([("a", 1, "old", "new"), ("b", 0, "other", "x"), ("c", 0, "q", "r")], "sample_id string, message_index int, original string, replacement string")
    out = ln.patch(m, e)
    assert {(r["sample_id"], r["message_index"], r["content"], r["problem"]) for r in out.collect()} == {("a", 0, "hi", None), ("a", 1, "new", None), ("b", 0, "yo", "original_mismatch"), ("c", 0, None, "edit_without_message")}
    good = d([("a", 0, "user", "hi"), ("a", 1, "assistant", "new")], m.schema)
    assert pairs(ln.patch_scope(good, out.where("sample_id = 'a'"))) == set()
    assert pairs(ln.patch_scope(good.union(d([("a", 2, "user", "more")], m.schema)), out.where("sample_id = 'a'"))) == {("a", "edit_beyond_scope")}
    ids = lambda x: d([(i,) for i in x], "sample_id string")
    assert pairs(ln.shard_reconciliation(ids("abcd"), ids("abx"), ids("bc"))) == {("b", "scored_and_failed"), ("d", "neither_scored_nor_failed"), ("x", "not_generated")}
    assert tuple(ln.shard_results(d([(0,), (1,), (None,)], "returncode int")).first()) == (3, 2, 1) and ln.shard_results(d([(0,)], "returncode int")).first()["exit_code"] == 0
    s = ln.source_statuses(d([(0, "pass"), (0, "pass"), (0, "fail"), (1, "pass")], "source_index int, status string"))
    assert {r["source_index"]: r["statuses"] for r in s.collect()} == {0: {"pass": 2, "fail": 1}, 1: {"pass": 1}}
    kept, scored, bad = ln.subset(ids("abc"), ids("ab"), ids("bcd"))
    assert (kept.count(), scored.count()) == (2, 1) and pairs(bad) == {("c", "score_missing"), ("d", "sample_missing")}
    j = ln.train_source(d([(0, "w", "a"), (1, "w", "b"), (2, "w", "c")], "row_index int, scenario string, source_sample_id string"), d([("w", "a", "S1"), ("w", "b", "S2")], "scenario string, sample_id string, template_id string"), d([("w", "a", "pass")], "scenario string, sample_id string, status string"))
    assert {r["row_index"]: (r["template_id"], r["status"], r["problem"]) for r in j.collect()} == {0: ("S1", "pass", None), 1: ("S2", None, "missing_score"), 2: (None, None, "missing_source")}


def test_runs(spark):
    d = spark.createDataFrame
    files = d([("a.py", "1"), ("b.py", "2")], "name string, sha256 string")
    assert pairs(ln.gate("passed", 3, 3, files, files)) == set()
    assert pairs(ln.gate("passed", 2, 3, files, d([("a.py", "9")], files.schema))) == {("validation", "validation_not_passed"), ("a.py", "code_changed"), ("b.py", "code_changed")}
    c = d([("r", 10, 10, 1.0, ["x", "y"]), ("r", 20, 19, 2.0, ["x", "y"]), ("r", 30, 30, 3.0, ["x"])], "run string, step int, global_step int, epoch double, files array<string>")
    e = d([(10, 1.0), (20, 2.0), (30, 3.0), (40, 4.0)], "step int, epoch double")
    assert pairs(ln.run_verify(e, c, ("x", "y"))) == {(20, "checkpoint_mismatch"), (30, "checkpoint_file_missing"), (40, "checkpoint_missing")}
    assert pairs(ln.latest_checkpoint(c, ("x", "y"))) == {("r", 10)} and pairs(ln.latest_checkpoint(c, ("x",))) == {("r", 30)}
    runs = d([("done", True, "ok", True), ("short", True, "ok", True), ("bad", True, "failed", None), ("new", False, None, None)], "name string, started boolean, status string, reload_verified boolean")
    cp = d([("done", 1, 1, True), ("done", 2, 2, True), ("short", 1, 1, True), ("short", 2, 2, False)], "name string, step int, global_step int, adapter_present boolean")
    assert pairs(ln.run_states(runs, cp, [1, 2], "ok")) == {("done", "complete"), ("short", "running_or_incomplete"), ("bad", "failed"), ("new", "pending")}
    t = d([("w", "a"), ("w", "a"), ("w", "z")], "scenario string, sample_id string")
    s = d([("w", "a"), ("w", "b")], "scenario string, seed_id string")
    assert pairs(ln.development_tasks(t, s, 2)) == {("w", "a", "duplicate_task"), ("w", "b", "seed_without_task"), ("w", "z", "task_without_seed"), (None, None, "task_count_mismatch")}
    ids = lambda x: d([(i,) for i in x], "id string")
    assert pairs(ln.oversample_ids(ids("aab"), ids("ac"))) == {("a", "duplicate_id"), ("b", "unknown_id")} and pairs(ln.oversample_ids(ids(""), ids("a"))) == {(None, "no_ids")}
    stored = d([('{"b": 1, "a": [1, 2]}',)], "fingerprint string")
    assert ln.may_resume(stored, '{"a":[1,2],"b":1}') and not ln.may_resume(stored, '{"a":[2,1],"b":1}')
    x = ln.exclusion_union(d([("s1",)], "seed_id string"), d([("s2", 1)], "seed_id string, more int"))
    assert {(r["seed_id"], r["version"]) for r in x.collect()} == {("s1", 0), ("s2", 1)}
    r = ln.reproduce_exclusions(d([("f", "1"), ("g", "2")], "name string, sha256 string"), d([("w", "f"), ("w", "f")], "scenario string, name string"))
    assert pairs(r) == {("w", "f", "1", 2), (None, "g", "2", 0)}


def test_configurations():
    good = {**dict.fromkeys(ln.COUNTS, 1), **dict.fromkeys(ln.AMOUNTS, 0.5), **dict.fromkeys(ln.SHARES, 0.0), "enable_thinking": False}
    assert ln.config_problems(good) == []
    bad = {**good, "batch_size": True, "epochs": float("inf"), "warmup_ratio": 1, "enable_thinking": None, "oversample_factor": 3, "wandb_project": "x"}
    assert ln.config_problems(bad) == ["enable_thinking_must_be_false", "not_a_positive_integer:batch_size", "not_a_finite_positive_number:epochs", "not_a_share:warmup_ratio", "oversample_file_and_factor_go_together", "wandb_names_go_together"]
