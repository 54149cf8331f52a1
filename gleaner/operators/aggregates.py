"""Aggregates: distributions, coverage, pass rates and roll-ups. Empty groups keep their row with null statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import label


def distribution(value: str, with_p95: bool = False) -> list[Column]:
    """count, min, median, nearest-rank percentiles and max of a column."""
    p = [("p90", 0.9)] + ([("p95", 0.95)] if with_p95 else [])
    return [
        F.count(value).alias("count"), F.min(value).alias("min"), F.median(value).alias("median"),
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, q in p], F.max(value).alias("max"),
    ]


def field_counts(samples: DataFrame, field: str, key: str = "sample_id") -> DataFrame:
    """Samples that bear each label of a field (a value or an array of them, counted once a sample)."""
    many = dict(samples.dtypes)[field].startswith("array")
    values = F.array_distinct(F.filter(field, lambda v: v.isNotNull() & (v.cast("string") != ""))) if many else F.array(field)
    rows = samples.select(key, F.explode_outer(values).alias("_v")).select(key, label(F.col("_v")).alias("label"))
    return rows.groupBy("label").agg(F.count_distinct(key).alias("samples"))


def rate(status: str) -> list[Column]:
    """passed, failed, count and pass_rate (null without a verdict)."""
    ok, bad = F.count_if(F.col(status) == "pass"), F.count_if(F.col(status) == "fail")
    return [ok.alias("passed"), bad.alias("failed"), (ok + bad).alias("count"), F.try_divide(ok, ok + bad).alias("pass_rate")]


def all_pass(status: str = "status") -> Column:
    """pass if every row passes; an empty group passes."""
    return F.when(F.coalesce(F.bool_and(F.col(status) == "pass"), F.lit(True)), "pass").otherwise("fail")


def turn_rollup(checks: DataFrame) -> DataFrame:
    return checks.groupBy("sample_id", "turn").agg(all_pass().alias("status"))


def sample_rollup(checks: DataFrame) -> DataFrame:
    return turn_rollup(checks).groupBy("sample_id").agg(all_pass().alias("status"), F.count("*").alias("turns"))


def scenario_rollup(checks: DataFrame, planned: DataFrame) -> DataFrame:
    """Status of every planned (sample_id, scenario_id): error empty_scenario_result where no check bears it."""
    rows = checks.select("sample_id", F.explode(F.array_distinct("scenario_ids")).alias("scenario_id"), "status")
    got = rows.groupBy("sample_id", "scenario_id").agg(all_pass().alias("status"))
    return planned.join(got, ["sample_id", "scenario_id"], "left").select("sample_id", "scenario_id", F.coalesce("status", F.lit("error")).alias("status"), F.when(F.col("status").isNull(), "empty_scenario_result").alias("reason"))


def macro_report(rows: DataFrame, members: DataFrame, member: str, category: str) -> DataFrame:
    """Per category: planned and covered members, and the mean of the covered members' pass rates. Members without a row count as planned."""
    each = rows.groupBy(member).agg(*rate("status"))
    per = members.join(each, member, "left")
    return per.groupBy(category).agg(F.count("*").alias("planned"), F.count_if(F.col("count") > 0).alias("covered"), F.avg("pass_rate").alias("macro_pass_rate"))


def failure_summary(checks: DataFrame) -> DataFrame:
    """Failures by check: results, samples affected and rate."""
    bad = F.col("status") == "fail"
    return checks.groupBy("check_id").agg(F.count("*").alias("results"), F.count_if(bad).alias("failures"), F.count_distinct(F.when(bad, F.col("sample_id"))).alias("samples"), F.try_divide(F.count_if(bad), F.count("*")).alias("failure_rate"))


def failure_combinations(checks: DataFrame) -> DataFrame:
    """How many samples fail each combination of checks."""
    combo = checks.where("status = 'fail'").groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_set("check_id")), " + ").alias("combination"))
    return combo.groupBy("combination").agg(F.count("*").alias("samples"))


def repeats(attempts: DataFrame, tasks: DataFrame, times: int = 4) -> DataFrame:
    """Category of each task over its planned repeats. A repeat whose status is neither pass nor fail is unscored, not failed."""
    plan = tasks.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))
    rows = plan.join(attempts, [*tasks.columns, "repeat"], "left")
    ok, done = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status").isin("pass", "fail"))
    kind = F.when(done < times, "incomplete").when(ok == times, "all_pass").when(ok == 0, "all_fail").otherwise("mixed")
    return rows.groupBy(*tasks.columns).agg(ok.alias("passed"), done.alias("completed"), kind.alias("category"))


def selection(events: DataFrame) -> DataFrame:
    """Candidates, selected and filtered by check, with the filtering reasons in order."""
    chosen = F.col("event") == "check_selected"
    return events.groupBy("check_id").agg(F.count("*").alias("candidates"), F.count_if(chosen).alias("selected"), F.count_if(~chosen).alias("filtered"))


def over_limits(rows: DataFrame, value: str, limits: list[int]) -> DataFrame:
    """How many values exceed each limit: one pass over the rows."""
    counted = rows.agg(*[F.count_if(F.col(value) > n).alias(str(n)) for n in limits])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("limit"), F.col(f"`{n}`").alias("over")) for n in limits])).alias("x")).select("x.limit", "x.over")


def compact(rows: DataFrame, key: str, count: str) -> DataFrame:
    """Keys grouped by equal counts."""
    return rows.groupBy(count).agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("keys"))


def stats(rows: DataFrame, value: str) -> DataFrame:
    """``distribution`` with p95 of a population that must not be empty."""
    if not rows.where(F.col(value).isNotNull()).head(1):
        raise ValueError("empty_population")
    return rows.agg(*distribution(value, True))


def completion(results: DataFrame, errors: DataFrame, planned: int) -> DataFrame:
    """One row: planned, completed and failed samples, and the share that was completed (null if none was planned)."""
    return results.agg(F.count("*").alias("completed")).join(errors.agg(F.count("*").alias("errors"))).select(  # one row each
        F.lit(planned).cast("long").alias("planned"), "completed", "errors", F.try_divide(F.col("completed"), F.lit(planned)).alias("completion_rate"))


def selection_reasons(events: DataFrame) -> DataFrame:
    """Filtered candidates by check and reason."""
    return events.where("event = 'check_filtered'").groupBy("check_id", "reason_code").agg(F.count("*").alias("candidates"))


def failures_by_template(checks: DataFrame) -> DataFrame:
    """Failures by template and check: results, samples affected and rate."""
    bad = F.col("status") == "fail"
    return checks.groupBy("template_id", "check_id").agg(F.count("*").alias("results"), F.count_if(bad).alias("failures"), F.count_distinct(F.when(bad, F.col("sample_id"))).alias("samples"), F.try_divide(F.count_if(bad), F.count("*")).alias("failure_rate"))


def repeat_problems(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Attempts of unknown tasks, and repeats of a task that came twice: either is an error of the run."""
    n = attempts.groupBy(*tasks.columns, "repeat").agg(F.count("*").alias("_n")).join(tasks.distinct().withColumn("_task", F.lit(True)), tasks.columns, "left")
    code = F.when(F.col("_task").isNull(), "unknown_task").when(F.col("_n") > 1, "duplicate_attempt")
    return n.select(*tasks.columns, "repeat", code.alias("problem")).where("problem IS NOT NULL")


def unscored(status: Column, check_statuses: Column) -> Column:
    """A sample's status, or ``unscored`` where one of its checks is neither passed, failed nor skipped."""
    open_ = F.exists(check_statuses, lambda s: F.coalesce(~s.isin("pass", "fail", "skip"), F.lit(True)))
    return F.when(status.isin("pass", "fail") & ~F.coalesce(open_, F.lit(False)), status).otherwise("unscored")
