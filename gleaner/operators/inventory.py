"""What a population of traces looks like before anything is filtered: structure, labels and topics, for all and by scenario.

Traces hold scenario, sample_id, messages (traces.MESSAGES) and context (internal_message_indices).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.aggregates import distribution
from gleaner.operators.traces import CALLS

#: Measures of a trace and of a call.
PER_TRACE, PER_CALL = ("messages", "body_characters", "calls"), "argument_characters"
ALL = "all"


def measures(traces: DataFrame) -> DataFrame:
    """scenario, sample_id, turns (user messages that aren't internal), messages, body_characters, calls and the characters of each
    call's arguments: higher-order functions over the array, no shuffle."""
    m = F.coalesce("messages", F.array().cast("array<struct<role:string,content:string,tool_calls:" + CALLS + ",tool_call_id:string>>"))
    internal = F.coalesce(F.col("context.internal_message_indices"), F.array().cast("array<int>"))
    turns = F.size(F.filter(m, lambda x, k: F.coalesce(x["role"] == "user", F.lit(False)) & ~F.array_contains(internal, k)))
    body = F.aggregate(m, F.lit(0), lambda a, x: a + F.coalesce(F.length(x["content"]), F.lit(0)))
    calls = F.flatten(F.transform(m, lambda x: F.coalesce(x["tool_calls"], F.array().cast(CALLS))))
    return traces.select(
        "scenario", "sample_id", turns.cast("long").alias("turns"), F.size(m).cast("long").alias("messages"), body.cast("long").alias("body_characters"), F.size(calls).cast("long").alias("calls"),
        F.transform(calls, lambda c: F.length(c["function"]["arguments"]).cast("long")).alias(PER_CALL))


def _by_scenario(df: DataFrame, *aggregates: Column) -> DataFrame:
    out = df.withColumn("_s", F.col("scenario")).groupingSets([["_s"], []], "_s").agg(F.grouping("_s").alias("_g"), *aggregates)
    return out.withColumn("scenario", F.when(F.col("_g") == 1, ALL).otherwise(F.col("_s"))).drop("_s", "_g")


def structure(traces: DataFrame) -> DataFrame:
    """Per scenario and for all: samples, and those with one, several and no turns."""
    t = F.col("turns")
    return _by_scenario(measures(traces), F.count("*").alias("samples"), F.count_if(t == 1).alias("single_turn"), F.count_if(t > 1).alias("multi_turn"), F.count_if(t == 0).alias("zero_turn"))


def turn_counts(traces: DataFrame) -> DataFrame:
    return measures(traces).groupBy("scenario", "turns").agg(F.count("*").alias("samples"))


def lengths(traces: DataFrame) -> DataFrame:
    """scenario, measure, count, min, median, p90 and max of each measure; a call's arguments are measured call by call."""
    m = measures(traces)
    rows = m.select("scenario", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in PER_TRACE])).alias("x")).select("scenario", "x.*")
    rows = rows.unionByName(m.select("scenario", F.lit(PER_CALL).alias("measure"), F.explode(PER_CALL).alias("value")))
    out = rows.withColumn("_s", F.col("scenario")).withColumn("_m", F.col("measure")).groupingSets([["_s", "_m"], ["_m"]], "_s", "_m").agg(F.grouping("_s").alias("_g"), *distribution("value"))
    return out.select(F.when(F.col("_g") == 1, ALL).otherwise(F.col("_s")).alias("scenario"), F.col("_m").alias("measure"), "count", "min", "median", "p90", "max")


def run_ids(traces: DataFrame, missing: str) -> DataFrame:
    """Samples of each run id in each source."""
    return traces.groupBy("source_index", F.coalesce(F.when(F.col("context.run_id") != "", F.col("context.run_id")), F.lit(missing)).alias("run_id")).agg(F.count("*").alias("samples"))


def topics(records: DataFrame, members: DataFrame) -> DataFrame:
    """Per topic: samples, meanings, dialogues, templates, variants and failures. members (topic, scenario, template_id) may
    overlap: a sample counts in each of its topics. records: id, scenario, template_id, variant_id, semantic, dialogue (digests),
    failed."""
    j = records.join(F.broadcast(members), ["scenario", "template_id"])  # members are some dozens of rows
    return j.groupBy("topic").agg(
        F.count("*").alias("samples"), F.count_distinct("semantic").alias("semantic_groups"), F.count_distinct("dialogue").alias("dialogues"), F.count_distinct("template_id").alias("templates"),
        F.count_distinct("variant_id").alias("variants"), F.count_if("failed").alias("failures"))
