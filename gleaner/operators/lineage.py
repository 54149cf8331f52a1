"""Lineage and run guards: what binds prepared data to its sources, patches, shards, runs and configurations.

Each function gives rows with a ``problem`` (none if all is well) or the joined result; ``require`` turns problems into an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LineageError(ValueError):
    """Inputs that don't belong together; the message is the first codes."""


def require(problems: DataFrame, column: str = "problem", show: int = 3) -> None:
    """Raises if there is any problem; ``show`` of them are named."""
    found = problems.orderBy(*problems.columns).limit(show).collect()
    if found:
        raise LineageError("; ".join(f"{r[column]}: {r.asDict()}" for r in found))


def _problems(df: DataFrame, *columns: str, code: Column) -> DataFrame:
    return df.select(*columns, code.alias("problem")).where("problem IS NOT NULL")


def train_batch(train: DataFrame, metadata: DataFrame, tools: str, expected: int) -> DataFrame:
    """(row_index, problem): train (row_index, tools as JSON text) and metadata (row_index) pair up one to one over 0 to n - 1, each row
    has the shared tools, and n is what the manifest says. A wrong count is a row with a null row_index."""
    canonical = lambda c: F.to_json(F.try_parse_json(c))
    t = train.groupBy("row_index").agg(F.count("*").alias("t"), F.bool_and(F.coalesce(canonical(F.col("tools")) == canonical(F.lit(tools)), F.lit(False))).alias("same"))
    m = metadata.groupBy("row_index").agg(F.count("*").alias("m"))
    j = t.join(m, "row_index", "full_outer")
    inside = F.coalesce(F.col("row_index").between(0, expected - 1), F.lit(False))
    code = F.when((F.coalesce("t", F.lit(0)) != 1) | (F.coalesce("m", F.lit(0)) != 1), "row_without_its_pair").when(~inside, "index_out_of_range").when(~F.col("same"), "row_or_tools_mismatch")
    counts = train.agg(F.count("*").alias("t")).join(metadata.agg(F.count("*").alias("m")))  # one row each
    wrong = counts.select(F.lit(None).cast("long").alias("row_index"), F.when((F.col("t") == 0) | (F.col("t") != F.col("m")) | (F.col("t") != expected), "training_count_mismatch").alias("problem")).where("problem IS NOT NULL")
    return _problems(j.withColumn("row_index", F.col("row_index").cast("long")), "row_index", code=code).unionByName(wrong)


def prepared_bind(audit: DataFrame, metadata: DataFrame, train: DataFrame, sources: DataFrame, counts: DataFrame, template_counts: DataFrame) -> DataFrame:
    """(subject, problem) of one prepared batch. audit: id, scenario, disposition; metadata: id, row_index, normalized_sha256;
    train: row_index, digest; sources: scenario, sample_id, template_id (the original traces); counts: one row of
    train_samples, source_samples, inventory_total (as the manifest and the inventory say); template_counts: scenario,
    template_id, samples (the inventory's)."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    sizes = counts.join(n(train, "t")).join(n(metadata, "m")).join(n(audit, "a")).join(n(audit.where("disposition = 'passed_sample'"), "p"))  # single rows
    size = F.array_compact(F.array(
        F.when((F.col("t") != F.col("train_samples")) | (F.col("m") != F.col("t")), "training_count_mismatch"), F.when((F.col("a") != F.col("inventory_total")) | (F.col("a") != F.col("source_samples")), "source_count_mismatch"),
        F.when(F.col("p") != F.col("t"), "passed_count_mismatch")))
    whole = sizes.select(F.lit("batch").alias("subject"), F.explode(size).alias("problem"))
    twice = audit.groupBy("id").count().where("count > 1").select(F.col("id").alias("subject"), F.lit("duplicate_audit_id").alias("problem"))
    passed = audit.where("disposition = 'passed_sample'").select("id", F.lit(True).alias("_passed"))
    ids = metadata.select("id", F.lit(True).alias("_meta")).join(passed, "id", "full_outer")
    unmatched = ids.where("_meta IS NULL OR _passed IS NULL").select(F.col("id").alias("subject"), F.lit("metadata_without_audit").alias("problem")).distinct()
    rows = metadata.join(train.select("row_index", F.col("digest").alias("_digest")), "row_index", "left")
    content = _problems(rows, F.col("id").alias("subject"), code=F.when(~F.col("_digest").eqNullSafe(F.col("normalized_sha256")), "row_or_content_mismatch"))
    original = sources.select(F.concat_ws(":", "scenario", "sample_id").alias("id"), F.lit(True).alias("_source"))
    known = audit.select("id", F.lit(True).alias("_audit")).join(original, "id", "full_outer")
    lost = known.where("_audit IS NULL OR _source IS NULL").select(F.col("id").alias("subject"), F.lit("source_audit_mismatch").alias("problem")).distinct()
    again = original.groupBy("id").count().where("count > 1").select(F.col("id").alias("subject"), F.lit("duplicate_source_id").alias("problem"))
    found = sources.groupBy("scenario", "template_id").agg(F.count("*").alias("_n")).join(template_counts, ["scenario", "template_id"], "full_outer")
    templates = _problems(found, F.concat_ws(":", "scenario", "template_id").alias("subject"), code=F.when(~F.col("_n").eqNullSafe(F.col("samples").cast("long")), "template_count_mismatch"))
    out = whole
    for part in (twice, unmatched, content, lost, again, templates):
        out = out.unionByName(part)
    return out


def train_source(metadata: DataFrame, sources: DataFrame, scores: DataFrame) -> DataFrame:
    """Training rows (row_index, scenario, source_sample_id) with their source's template_id and their score's status, and a problem
    where either is missing."""
    s = sources.select("scenario", F.col("sample_id").alias("source_sample_id"), "template_id", F.lit(True).alias("_s"))
    k = scores.select("scenario", F.col("sample_id").alias("source_sample_id"), "status", F.lit(True).alias("_k"))
    j = metadata.select("row_index", "scenario", "source_sample_id").join(s, ["scenario", "source_sample_id"], "left").join(k, ["scenario", "source_sample_id"], "left")
    return j.select("row_index", "scenario", "source_sample_id", "template_id", "status", F.when(F.col("_s").isNull(), "missing_source").when(F.col("_k").isNull(), "missing_score").alias("problem"))


def patch(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages (sample_id, message_index, role, content) with edits (sample_id, message_index, original, replacement) applied; problem where an
    edit's original isn't what stands there, and rows of their own for edits that meet no message."""
    e = edits.select("sample_id", "message_index", "original", "replacement", F.lit(True).alias("_edit"))
    j = messages.withColumn("_there", F.lit(True)).join(e, ["sample_id", "message_index"], "full_outer")
    same = F.col("content").eqNullSafe(F.col("original"))
    code = F.when(F.col("_there").isNull(), "edit_without_message").when(F.col("_edit") & ~same, "original_mismatch")
    return j.select("sample_id", "message_index", "role", F.when(F.col("_edit") & same, F.col("replacement")).otherwise(F.col("content")).alias("content"), F.coalesce("_edit", F.lit(False)).alias("edited"), code.alias("problem"))


def patch_scope(corrected: DataFrame, patched: DataFrame) -> DataFrame:
    """(sample_id, problem): corrected messages must be the patched ones and nothing else, by the digest of each message."""
    shape = lambda df, name: df.select("sample_id", "message_index", F.sha2(F.to_json(F.struct("role", "content"), {"ignoreNullFields": "false"}), 256).alias(name))
    j = shape(corrected, "a").join(shape(patched.where("problem IS NULL"), "b"), ["sample_id", "message_index"], "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("sample_id", F.lit("edit_beyond_scope").alias("problem")).distinct()


def merge(originals: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Originals with corrections in their place and new rows after them: the columns of both and ``kind`` (unchanged, revised, new)."""
    names = [c for c in originals.columns if c != key]
    o, c = originals.withColumn("_o", F.lit(True)), corrections.select(key, *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_c"))
    j = o.join(c, key, "full_outer")
    kind = F.when(F.col("_o").isNull(), "new").when(F.col("_c"), "revised").otherwise("unchanged")
    return j.select(key, *[F.when(F.col("_c"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names], kind.alias("kind"))


def reconcile(before: DataFrame, audit: DataFrame, revised: DataFrame, new: DataFrame) -> DataFrame:
    """Where training rows went: per origin (old, revised, new, other) and disposition how many; a row of ``before`` that the audit (id,
    disposition) lacks is removed. before, revised and new hold ids."""
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    j = audit.select("id", "disposition").join(flag(before, "_old"), "id", "full_outer").join(flag(revised, "_revised"), "id", "left").join(flag(new, "_new"), "id", "left")
    origin = F.when(F.col("_revised"), "revised").when(F.col("_old"), "old").when(F.col("_new"), "new").otherwise("other")
    return j.groupBy(origin.alias("origin"), F.coalesce("disposition", F.lit("removed")).alias("disposition")).agg(F.count("*").alias("rows"))


def shard_reconciliation(generated: DataFrame, scored: DataFrame, errors: DataFrame) -> DataFrame:
    """(sample_id, problem): every generated sample is either scored or an error, never both, and nothing else is."""
    flag = lambda df, name: df.select("sample_id").distinct().withColumn(name, F.lit(True))
    j = flag(generated, "g").join(flag(scored, "s"), "sample_id", "full_outer").join(flag(errors, "e"), "sample_id", "full_outer")
    return _problems(j, "sample_id", code=F.when(F.col("s") & F.col("e"), "scored_and_failed").when(F.col("g").isNull(), "not_generated").when(F.col("s").isNull() & F.col("e").isNull(), "neither_scored_nor_failed"))


def shard_results(shards: DataFrame) -> DataFrame:
    """One row: shards, failed ones (a return code other than 0, or none) and the exit code of the whole."""
    bad = F.coalesce(F.col("returncode") != 0, F.lit(True))
    return shards.agg(F.count("*").alias("shards"), F.count_if(bad).alias("failed"), F.when(F.count("*") == 0, 1).otherwise(F.coalesce(F.bool_or(bad), F.lit(False)).cast("int")).alias("exit_code"))


def source_statuses(scores: DataFrame) -> DataFrame:
    """How often each status occurs in each source, as a map."""
    per = scores.groupBy("source_index", "status").agg(F.count("*").alias("n"))
    return per.groupBy("source_index").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"), F.sum("n").alias("samples"))


def gate(status: str, matched: int, planned: int, expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem): a validation that passed in full, and code files (name, sha256) that are still what it saw."""
    spark = expected.sparkSession
    passed = spark.range(1).select(F.lit("validation").alias("name"), F.when(F.lit(status != "passed" or matched != planned), "validation_not_passed").alias("problem")).where("problem IS NOT NULL")
    j = expected.select("name", "sha256").join(found.select("name", F.col("sha256").alias("_now")), "name", "left")
    return passed.unionByName(_problems(j, "name", code=F.when(~F.col("_now").eqNullSafe(F.col("sha256")), "code_changed")))


def run_verify(expected: DataFrame, checkpoints: DataFrame, files: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """(step, problem): expected (step, epoch) against checkpoints (step, global_step, epoch, files)."""
    c = checkpoints.select("step", "global_step", F.col("epoch").alias("_epoch"), "files", F.lit(True).alias("_there"))
    j = expected.join(c, "step", "left")
    needed = F.array(*map(F.lit, files))
    near = F.coalesce(F.abs(F.col("_epoch") - F.col("epoch")) <= tolerance, F.lit(False))
    return _problems(j, "step", code=F.when(F.col("_there").isNull(), "checkpoint_missing").when(~F.col("global_step").eqNullSafe(F.col("step")) | ~near, "checkpoint_mismatch").when(F.size(F.array_except(needed, F.coalesce("files", F.array().cast("array<string>")))) > 0, "checkpoint_file_missing"))


def run_states(experiments: DataFrame, checkpoints: DataFrame, steps: list[int], done: str) -> DataFrame:
    """name and state of experiments (name, started, status, reload_verified): complete if the status is ``done``, every expected
    step has an adapter of that step and the reload is verified; else failed, running_or_incomplete or pending."""
    good = checkpoints.where(F.col("adapter_present") & (F.col("global_step") == F.col("step")) & F.col("step").isin(*steps)).groupBy("name").agg(F.count_distinct("step").alias("_good"))
    j = experiments.join(good, "name", "left")
    whole = (F.col("status") == done) & (F.col("_good") == len(set(steps))) & F.col("reload_verified")
    state = F.when(F.coalesce(whole, F.lit(False)), "complete").when(F.coalesce(F.col("status") == "failed", F.lit(False)), "failed").when(F.coalesce("started", F.lit(False)), "running_or_incomplete").otherwise("pending")
    return j.select("name", state.alias("state"))


def latest_checkpoint(checkpoints: DataFrame, files: tuple[str, ...] = ("trainer_state.json", "optimizer.pt", "scheduler.pt")) -> DataFrame:
    """The last step of each run whose checkpoint (run, step, global_step, files) is whole."""
    whole = (F.size(F.array_except(F.array(*map(F.lit, files)), F.col("files"))) == 0) & (F.col("global_step") == F.col("step"))
    return checkpoints.where(whole).groupBy("run").agg(F.max("step").alias("latest"))


def development_tasks(tasks: DataFrame, seeds: DataFrame, expected: int) -> DataFrame:
    """(scenario, sample_id, problem): tasks are exactly the seeds (scenario, seed_id), once each, and ``expected`` in number."""
    t = tasks.groupBy("scenario", "sample_id").agg(F.count("*").alias("n"))
    s = seeds.select("scenario", F.col("seed_id").alias("sample_id")).distinct().withColumn("_s", F.lit(True))
    j = t.join(s, ["scenario", "sample_id"], "full_outer")
    rows = _problems(j, "scenario", "sample_id", code=F.when(F.col("n").isNull(), "seed_without_task").when(F.col("_s").isNull(), "task_without_seed").when(F.col("n") > 1, "duplicate_task"))
    none = F.lit(None).cast("string")
    return rows.unionByName(tasks.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(none.alias("scenario"), none.alias("sample_id"), F.lit("task_count_mismatch").alias("problem")))


def oversample_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(id, problem): listed ids are there, unique and known."""
    k = known.select("id").distinct().withColumn("_known", F.lit(True))
    rows = ids.groupBy("id").agg(F.count("*").alias("n")).join(k, "id", "left")
    empty = ids.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no_ids").alias("problem"))
    return _problems(rows.withColumn("id", F.col("id").cast("string")), "id", code=F.when(F.col("n") > 1, "duplicate_id").when(F.col("_known").isNull(), "unknown_id")).unionByName(empty)


def subset(rows: DataFrame, scores: DataFrame, targets: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and scores of the target ids, and (key, problem) where either side lacks one."""
    t = targets.select(key).distinct()
    kept, scored = rows.join(t, key, "left_semi"), scores.join(t, key, "left_semi")
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    j = t.join(flag(kept, "_r"), key, "left").join(flag(scored, "_s"), key, "left")
    return kept, scored, _problems(j, key, code=F.when(F.col("_r").isNull(), "sample_missing").when(F.col("_s").isNull(), "score_missing"))


def exclusion_union(*seeds: DataFrame) -> DataFrame:
    """Seeds of all earlier versions together, with the number of the version they come from."""
    out = None
    for k, df in enumerate(seeds):
        part = df.withColumn("version", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def reproduce_exclusions(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Per scenario and exclusion file (name, sha256) how many seeds it holds; rows: scenario, name. Files without rows count 0."""
    n = rows.groupBy("scenario", "name").agg(F.count("*").alias("seeds"))
    return files.select("name", "sha256").join(n, "name", "left").select("scenario", "name", "sha256", F.coalesce("seeds", F.lit(0).cast("long")).alias("seeds"))


def fingerprint(config: str) -> Column:
    """The digest of a run's configuration, whatever the order of its keys. config: JSON text."""
    return F.sha2(F.to_json(F.parse_json(F.lit(config))), 256)


def may_resume(stored: DataFrame, config: str) -> bool:
    """Whether a stored fingerprint (one row, JSON text in ``fingerprint``) is that of today's configuration."""
    same = stored.select((F.sha2(F.to_json(F.try_parse_json("fingerprint")), 256) == fingerprint(config)).alias("same"))
    return bool(same.agg(F.coalesce(F.bool_and("same"), F.lit(False))).first()[0])


#: Rules of a training configuration: a name for each field that must be a positive integer, a finite positive number, or a share.
COUNTS = ("max_seq_length", "batch_size", "gradient_accumulation_steps", "lora_rank", "lora_alpha", "save_steps", "save_total_limit", "smoke_samples", "smoke_steps")
AMOUNTS, SHARES = ("epochs", "learning_rate", "max_grad_norm"), ("warmup_ratio", "weight_decay")


def config_problems(config: dict) -> list[str]:
    """What is wrong with a training configuration, as codes with the field's name; on the driver."""
    out = [] if config.get("enable_thinking") is False else ["enable_thinking_must_be_false"]
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)
    tests: list[tuple[tuple[str, ...], Callable, str]] = [
        (COUNTS, lambda v: type(v) is int and v >= 1, "not_a_positive_integer"), (AMOUNTS, lambda v: number(v) and v > 0, "not_a_finite_positive_number"), (SHARES, lambda v: number(v) and 0 <= v < 1, "not_a_share")]
    for names, ok, code in tests:
        out += [f"{code}:{n}" for n in names if not ok(config.get(n))]
    factor = config.get("oversample_factor", 1)
    if type(factor) is not int or factor < 1:
        out.append("not_a_positive_integer:oversample_factor")
    elif (config.get("oversample_ids_file") is None) != (factor == 1):
        out.append("oversample_file_and_factor_go_together")
    if (config.get("wandb_project") is None) != (config.get("wandb_run_name") is None):
        out.append("wandb_names_go_together")
    return out
