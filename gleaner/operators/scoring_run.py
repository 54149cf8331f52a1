"""A scoring run with a scorer written in Python: a table function from a sample to rows of checks.

Rules that are columns belong into a registered ``evaluation.Scorer``; what can't be a column runs here, a sample at a time, wherever
Spark put the sample. A scorer that fails loses its sample and no other: the checks it gave before are withheld, and the sample
becomes one row that tells of the error. So is a sample without a single check.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A check's row, or an error's: the error's columns are null in the one, the check's in the other.
RESULT = "turn int, check_id string, status string, reason string, stage string, error_code string, exception string, message string, retryable boolean"


class ScoringError(RuntimeError):
    """What a scorer raises when it can't judge a sample."""

    def __init__(self, stage: str, code: str, message: str = "", retryable: bool = False):
        super().__init__(message)
        self.stage, self.code, self.retryable = stage, code, retryable


def outcome(scorer: Callable[[dict], Iterable[tuple]], sample: str | None) -> list[tuple]:
    """RESULT rows of one sample (JSON text). scorer: gives (turn, check_id, status, reason)."""
    try:
        found = [(*check, None, None, None, None, None) for check in scorer(json.loads(sample or "null"))]
        if not found:
            raise ScoringError("aggregation", "empty_scenario_result")
        return found
    except ScoringError as e:
        return [(None, None, None, None, e.stage, e.code, type(e).__name__, str(e), e.retryable)]
    except Exception as e:  # a fault of the scorer; its sample is an error, the run goes on
        return [(None, None, None, None, "scoring", "unexpected_exception", type(e).__name__, str(e), False)]


def score(samples: DataFrame, scorer: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """Samples (sample_id, template_id, sample as JSON text) with RESULT, a row per check or one per error."""

    class Each:
        def eval(self, sample: str):
            yield from outcome(scorer, sample)

    each = F.udtf(Each, returnType=RESULT)
    return samples.lateralJoin(each(F.col("sample").outer())).drop("sample")


def input_problems(samples: DataFrame) -> DataFrame:
    """sample_ids that make the whole input unfit: absent, empty or repeated, with how often they occur."""
    return samples.groupBy("sample_id").agg(F.count("*").alias("times")).where("sample_id IS NULL OR sample_id = '' OR times > 1")


def completion(results: DataFrame) -> DataFrame:
    """One row: samples, those that were scored and those that were lost, the share of the first, and checks by status."""
    lost = F.col("error_code").isNotNull()
    per = results.groupBy("sample_id").agg(F.bool_or(lost).alias("lost"), F.bool_and(F.col("status") == "pass").alias("good"))
    counts = per.agg(F.count("*").alias("samples"), F.count_if(~F.col("lost")).alias("completed"), F.count_if("lost").alias("errors"), F.count_if(~F.col("lost") & F.col("good")).alias("passed"))
    return counts.withColumn("completion_rate", F.when(F.col("samples") > 0, F.col("completed") / F.col("samples")))
