"""The export of traces to training rows: every trace gets one disposition, and a reason where it can't be used.

An entry is one row: id, scenario, messages, context (trace_complete, internal_message_indices, system_prompt_sha256,
public_catalog as JSON text), seed (seed_id, template_id, user_turns), tools (schemas.TOOLS, its own), score (seed_id,
template_id, status, checks of key, status, evidence), expected (the keys of the checks that are due) and require_review.
The rules look at one entry each and are columns, so nothing moves until duplicates are looked for by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.operators import schemas, traces
from gleaner.operators.ordering import dense_index
from gleaner.operators.records import rebuild_system
from gleaner.settled import Scratch

CONTEXT = "struct<trace_complete:boolean,internal_message_indices:array<int>,system_prompt_sha256:string,public_catalog:string>"
SEED = "struct<seed_id:string,template_id:string,user_turns:array<string>>"
SCORE = "struct<seed_id:string,template_id:string,status:string,checks:array<struct<key:string,status:string,evidence:array<struct<message_index:int,quote:string>>>>>"


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def calls_text(calls: Column) -> Column:
    """A message's tool calls as the JSON text that evidence quotes: blanks after commas and colons."""
    one = lambda c: F.concat(
        F.lit('{"id": '), _quoted(c["id"]), F.lit(', "type": '), _quoted(c["type"]), F.lit(', "function": {"name": '), _quoted(c["function"]["name"]), F.lit(', "arguments": '), _quoted(c["function"]["arguments"]), F.lit("}}"))
    return F.concat(F.lit("["), F.array_join(F.transform(calls, one), ", "), F.lit("]"))


def evidence(messages: Column, indices: Column, limit: int = 500) -> Column:
    """(message_index, quote) of messages, each index once: the content, or else the calls' JSON, cut to ``limit`` characters."""

    def proof(i: Column) -> Column:
        m = F.get(messages, i)
        text = F.when(F.coalesce(m["content"], F.lit("")) != "", m["content"]).otherwise(calls_text(F.coalesce(m["tool_calls"], F.array().cast(traces.CALLS))))
        return F.struct(i.alias("message_index"), F.substring(text, 1, limit).alias("quote"))

    return F.transform(F.array_distinct(indices), proof)


def score_code(score: Column, expected: Column, seed: Column, messages: Column) -> Column:
    """The first rule that a stored score breaks: it belongs to this sample, has each due check once and settled, each with
    evidence that the cited message holds, and its status is what the checks say."""
    checks = F.coalesce(score["checks"], F.array().cast("array<struct<key:string,status:string,evidence:array<struct<message_index:int,quote:string>>>>"))
    keys = F.transform(checks, lambda c: c["key"])
    whole = (F.size(F.array_distinct(keys)) == F.size(keys)) & (F.sort_array(F.array_distinct(keys)) == F.sort_array(F.array_distinct(expected)))

    def proof(e: Column) -> Column:
        at, quote = e["message_index"], F.coalesce(e["quote"], F.lit(""))
        m = F.get(messages, at)
        sound = F.coalesce(at.between(0, F.size(messages) - 1), F.lit(False)) & (quote != "")
        held = F.contains(F.coalesce(m["content"], F.lit("")), quote) | F.coalesce((F.size(m["tool_calls"]) > 0) & F.contains(calls_text(m["tool_calls"]), quote), F.lit(False))
        return F.when(~sound, "invalid_score_evidence").when(~held, "stale_score_evidence")

    per_check = F.transform(checks, lambda c: F.when(F.coalesce(F.size(c["evidence"]) <= 0, F.lit(True)), "score_without_evidence").otherwise(F.get(F.array_compact(F.transform(c["evidence"], proof)), F.lit(0))))
    failed = F.exists(checks, lambda c: c["status"] == "fail")
    return F.coalesce(
        F.when(score.isNull(), "missing_score"),
        F.when(~(score["seed_id"].eqNullSafe(seed["seed_id"]) & score["template_id"].eqNullSafe(seed["template_id"])), "score_identity_mismatch"),
        F.when(~F.coalesce(whole, F.lit(False)), "incomplete_or_duplicate_score_checks"),
        F.when((F.size(checks) == 0) | F.exists(checks, lambda c: F.coalesce(~c["status"].isin("pass", "fail"), F.lit(True))), "unresolved_score"),
        F.get(F.array_compact(per_check), F.lit(0)),
        F.when(~score["status"].eqNullSafe(F.when(failed, "fail").otherwise("pass")), "inconsistent_score_status"),
    )


def review_code(review: Column, sample_digest: Column, required: Column) -> Column:
    """What an evidence review (decision, reason, source_sample_sha256) says against a passing sample. It can't pass a failing one."""
    return F.when(review.isNull(), F.when(F.coalesce(required, F.lit(False)), "missing_evidence_review")).otherwise(F.coalesce(
        F.when(~review["source_sample_sha256"].eqNullSafe(sample_digest), "evidence_review_source_mismatch"),
        F.when(F.coalesce(F.trim(review["reason"]), F.lit("")) == "", "missing_evidence_review_reason"),
        F.when(review["decision"] == "quarantine", F.concat(F.lit("evidence_review:"), review["reason"])),
        F.when(~F.coalesce(review["decision"] == "accept", F.lit(False)), "invalid_evidence_review_decision"),
    ))


def target_issues(messages: Column, target: Column) -> Column:
    """(tool, reason) of the calls that the target's tools can't take."""
    calls = F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast(traces.CALLS))))
    found = F.transform(calls, lambda c: F.struct(c["function"]["name"].alias("tool"), schemas.issue(c["function"]["name"], c["function"]["arguments"], target, "tool_missing_from_target_list").alias("reason")))
    return F.filter(found, lambda i: i["reason"].isNotNull())


def sample_digest(entries: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct("id", "messages", "seed"), {"ignoreNullFields": "false"}), 256)


def export(entries: DataFrame, target_tools: str, prompt: str, reviews: DataFrame | None = None) -> DataFrame:
    """id, scenario, tool_provenance, disposition, reason, duplicate_of, digest, messages (with the rebuilt system), tools (the target's),
    failed_checks, invalid_actions and target_invalid_actions of every entry. target_tools: JSON array of definitions; reviews:
    id, decision, reason, source_sample_sha256.

    Failing samples are checked leniently: their bad actions are listed, and only passing samples must fit the target."""
    spark = entries.sparkSession
    known = spark.range(1).select(F.to_json(schemas.definitions(F.lit(target_tools)))).first()[0]
    target = F.from_json(F.lit(known), schemas.TOOLS)  # a constant
    e = entries.withColumn("_sample", sample_digest(entries))
    if reviews is not None:
        said = reviews.select(F.col("id"), F.struct("decision", "reason", "source_sample_sha256").alias("_review"))
        e = e.join(said, "id", "left")
    else:
        e = e.withColumn("_review", F.lit(None).cast("struct<decision:string,reason:string,source_sample_sha256:string>"))
    checks = F.coalesce(F.col("score.checks"), F.array().cast("array<struct<key:string,status:string,evidence:array<struct<message_index:int,quote:string>>>>"))
    failed = F.filter(checks, lambda c: c["status"] == "fail")
    e = e.withColumn("_tools", schemas.definition_problem(F.col("tools"))).withColumn("_score", score_code(F.col("score"), F.col("expected"), F.col("seed"), F.col("messages")))
    e = e.withColumn("_failed", F.size(failed) > 0).withColumn("_trace", traces.trace_state(F.col("messages"), F.col("context"), F.col("seed.user_turns"), F.col("tools"), ~F.col("_failed")))
    e = e.withColumn("_issues", target_issues(F.col("messages"), target))
    home = F.col("scenario") == "home_switch"
    e = e.withColumn("_system", rebuild_system(F.get("messages", F.lit(0))["content"], F.col("context.public_catalog"), prompt, home))
    # Settled: what follows reads each of these several times, and a plan would compute them as often.
    e = Scratch(spark).settle(e.select("id", "scenario", "messages", "tools", "require_review", "_sample", "_review", "_tools", "_score", "_failed", "_trace", "_issues", "_system", F.transform(failed, lambda c: c["key"]).alias("_keys")))
    reason = F.coalesce(
        "_tools", "_score", "_trace.reason",
        F.when(~F.col("_failed") & (F.size("_issues") > 0), F.concat(F.lit("target_tool_incompatible:"), F.get("_issues", F.lit(0))["reason"])),
        "_system.code",
        F.when(~F.col("_failed"), review_code(F.col("_review"), F.col("_sample"), F.col("require_review"))),
    )
    head = F.struct(F.lit("system").alias("role"), F.col("_system.system").alias("content"), F.lit(None).cast(traces.CALLS).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
    e = e.withColumn("reason", reason)
    body = F.when(F.col("reason").isNull(), F.concat(F.array(head), traces.normalized(F.col("messages"), as_written=True))).cast(traces.MESSAGES)
    attached = F.to_json(F.parse_json(F.lit(target_tools)))  # the same tools for every row
    e = e.withColumn("messages", body).withColumn("target_tools", attached).withColumn("digest", F.sha2(F.to_json(F.struct(traces.canonical_calls(F.col("messages")).alias("messages"), "target_tools"), {"ignoreNullFields": "false"}), 256))
    lenient = lambda c: F.when(F.col("_failed") & F.col("reason").isNull(), c)
    rows = e.select(
        "id", "scenario", traces.tool_provenance(F.col("scenario"), F.size(F.coalesce("tools", F.array().cast(schemas.TOOLS))) > 0).alias("tool_provenance"), "reason", F.col("_failed").alias("failed"), "digest", "messages", F.col("target_tools").alias("tools"),
        lenient(F.col("_keys")).alias("failed_checks"), lenient(F.col("_trace.issues")).alias("invalid_actions"), lenient(F.col("_issues")).alias("target_invalid_actions"))
    return traces.disposition(rows)


def row_index(exported: DataFrame) -> DataFrame:
    """id and the dense index of passing rows in id order."""
    return dense_index(exported.where("disposition = 'passed_sample'").select("id"), "id")


def disposition_problem(exported: DataFrame) -> DataFrame:
    """Per scenario: rows, and their number by disposition; the parts must add up to the whole."""
    n = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    per = exported.groupBy("scenario").agg(F.count("*").alias("rows"), *[n(d) for d in traces.DISPOSITIONS])
    return per.withColumn("sound", sum((F.col(d) for d in traces.DISPOSITIONS[1:]), F.col(traces.DISPOSITIONS[0])) == F.col("rows"))
