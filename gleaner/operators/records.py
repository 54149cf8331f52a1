"""Records around the traces: stored judge verdicts, score integrity, systems and catalogs, run accounting and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the visible device catalog in a system message: a fixed value.
CATALOG_MARK = "本次可信设备目录（controllable为允许开关，未列设备不在本次允许范围）："
CATALOG_KEYS, CATALOG_REQUIRED = ("entity_id", "name", "aliases", "room", "controllable"), ("entity_id", "name", "controllable")


def judgments(requests: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    """requests (sample_id, key, reply_indices, policy), results (sample_id, key, status, reason, evidence[(message_index,
    quote)]), messages (sample_id, message_index, role, content). One row per key of either side with the code of the first
    rule it breaks, or its status. A response is accepted only if none of its keys has a code."""
    counted = results.groupBy("sample_id", "key").agg(F.count("*").alias("n"), F.first("status").alias("status"), F.first("reason").alias("reason"), F.first("evidence").alias("evidence"))
    j = requests.withColumn("_asked", F.lit(True)).join(counted, ["sample_id", "key"], "full_outer")
    proof = j.select("sample_id", "key", "reply_indices", F.explode("evidence").alias("e")).select("sample_id", "key", "reply_indices", "e.*")
    said = messages.select("sample_id", "message_index", "role", "content")
    cited = proof.join(said, ["sample_id", "message_index"], "left")
    is_reply = F.array_contains("reply_indices", F.col("message_index"))
    sound = F.coalesce((F.col("quote") != "") & F.contains("content", "quote"), F.lit(False))
    per = cited.groupBy("sample_id", "key").agg(
        F.bool_and(sound).alias("quoted"), F.coalesce(F.bool_or(is_reply), F.lit(False)).alias("cites_reply"),
        F.max(F.when(is_reply, F.col("message_index"))).alias("claim"), F.min(F.when(F.col("role").isin("system", "tool", "user"), F.col("message_index"))).alias("basis"),
    )
    j = j.join(per, ["sample_id", "key"], "left")
    unfit = ~F.coalesce(F.col("status").isin("pass", "fail") & (F.trim("reason") != "") & (F.size("evidence") > 0), F.lit(False))
    code = (
        F.when(F.col("_asked").isNull() | (F.col("n") > 1), "invalid_judge_key").when(F.col("n").isNull(), "missing_judge_item").when(unfit, "invalid_judge_status")
        .when(~F.coalesce(F.col("quoted") & F.col("cites_reply"), F.lit(False)), "invalid_judge_evidence")
        .when((F.col("status") == "fail") & (F.col("policy") == "claim_and_basis_v1") & ~F.coalesce(F.col("basis") < F.col("claim"), F.lit(False)), "missing_factuality_basis")
    )
    return j.select("sample_id", "key", code.alias("code"), F.when(code.isNull(), F.col("status")).alias("status"))


def score_integrity(samples: DataFrame, scores: DataFrame, expected: DataFrame, checks: DataFrame, messages: DataFrame) -> DataFrame:
    """samples (sample_id, seed_id, template_id), scores (the same and status), expected (sample_id, key), checks (sample_id,
    key, status, evidence), messages (sample_id, message_index, text). The first code that applies to each sample."""
    want = expected.groupBy("sample_id").agg(F.sort_array(F.collect_set("key")).alias("want"))
    got = checks.groupBy("sample_id").agg(
        F.sort_array(F.collect_list("key")).alias("got"), F.bool_and(F.coalesce(F.col("status").isin("pass", "fail"), F.lit(False))).alias("resolved"), F.bool_or(F.col("status") == "fail").alias("failed"),
        F.bool_and(F.coalesce(F.size("evidence") > 0, F.lit(False))).alias("proved"))
    e = checks.select("sample_id", F.explode("evidence").alias("e")).select("sample_id", "e.*")
    e = e.join(messages.select("sample_id", "message_index", "text"), ["sample_id", "message_index"], "left")
    quotes = e.groupBy("sample_id").agg(
        F.bool_or((F.coalesce("quote", F.lit("")) == "") | F.col("text").isNull()).alias("odd"), F.bool_or(~F.coalesce(F.contains("text", "quote"), F.lit(False))).alias("stale"))
    s = scores.select("sample_id", F.col("seed_id").alias("_seed"), F.col("template_id").alias("_template"), F.col("status").alias("_status"), F.lit(True).alias("_scored"))
    j = samples.join(s, "sample_id", "left").join(want, "sample_id", "left").join(got, "sample_id", "left").join(quotes, "sample_id", "left")
    none = F.array().cast("array<string>")
    code = (
        F.when(F.col("_scored").isNull(), "missing_score").when(~(F.col("seed_id").eqNullSafe(F.col("_seed")) & F.col("template_id").eqNullSafe(F.col("_template"))), "score_identity_mismatch")
        .when(F.coalesce("want", none) != F.coalesce("got", none), "incomplete_or_duplicate_score_checks").when(~F.coalesce("resolved", F.lit(False)), "unresolved_score")
        .when(~F.col("proved"), "score_without_evidence").when(F.coalesce("odd", F.lit(False)), "invalid_score_evidence").when(F.coalesce("stale", F.lit(False)), "stale_score_evidence")
        .when(F.col("_status") != F.when(F.col("failed"), "fail").otherwise("pass"), "inconsistent_score_status")
    )
    return j.select("sample_id", code.alias("code"), F.coalesce("failed", F.lit(False)).alias("failed"))


def rebuild_system(system: Column, public_catalog: Column, prompt: str, home: Column) -> Column:
    """struct(system, code): the shared prompt, and for home traces the visible catalog verbatim after it."""
    base = F.lit(prompt.rstrip())
    times = F.size(F.split(system, CATALOG_MARK)) - 1
    tail = F.substring_index(system, CATALOG_MARK, -1)
    rows = F.from_json(tail, "array<map<string,variant>>")
    allowed, needed = F.array(*map(F.lit, CATALOG_KEYS)), F.array(*map(F.lit, CATALOG_REQUIRED))
    sound = F.forall(rows, lambda r: (F.size(F.array_except(F.map_keys(r), allowed)) == 0) & (F.size(F.array_except(needed, F.map_keys(r))) == 0) & (F.schema_of_variant(F.try_element_at(r, F.lit("controllable"))) == "BOOLEAN"))
    code = F.when(home, F.when(times != 1, "missing_visible_catalog").when(~F.to_json(F.try_parse_json(tail)).eqNullSafe(F.to_json(F.try_parse_json(public_catalog))), "catalog_mismatch").when(~F.coalesce(sound, F.lit(False)), "invalid_public_catalog"))
    return F.struct(F.when(code.isNull(), F.when(home, F.concat(base, F.lit("\n\n" + CATALOG_MARK), tail)).otherwise(base)).alias("system"), code.alias("code"))


def sample_type(template: Column) -> Column:
    return F.when(F.regexp_extract(template, r"\d+", 0).cast("int") <= 16, "positive").otherwise("negative")


def turn_scenarios(scenes: Column, turn: Column, template: Column, form: Column) -> Column:
    """Scenarios of a turn under its request form: two devices drop HS01 and add HS14, a mixed first turn adds HS15."""
    two = (form == "two_devices") & (template.isin("T19", "T20") | ((template == "T18") & (turn == 2)))
    out = F.when(two, F.array_append(F.array_remove(scenes, "HS01"), F.lit("HS14"))).when((form == "mixed") & (turn == 1), F.array_append(scenes, F.lit("HS15"))).otherwise(scenes)
    return F.array_distinct(out)


def prefix_and_first(messages: Column) -> Column:
    """struct(prefix, tools) of a message array: what stands before the first reply, and the tools that reply calls; null without a
    reply."""
    at = F.array_position(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit(""))), "assistant").cast("int")
    calls = F.get(messages, at - 1)["tool_calls"]
    names = F.coalesce(F.transform(calls, lambda c: c["function"]["name"]), F.array().cast("array<string>"))
    return F.when(at > 0, F.struct(F.slice(messages, F.lit(1), at - 1).alias("prefix"), names.alias("tools")))


def run_status(codes: DataFrame, scores: DataFrame) -> DataFrame:
    """run_id and status: complete if every return code (run_id, returncode) is 0 and the score (run_id, status) is complete."""
    ok = codes.groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("returncode") == 0, F.lit(False))).alias("_ok"))
    j = ok.join(scores.select("run_id", F.col("status").alias("_score")), "run_id", "left")
    return j.select("run_id", F.when(F.col("_ok") & F.coalesce(F.col("_score") == "complete", F.lit(False)), "complete").otherwise("incomplete").alias("status"))


def accounting(planned: DataFrame, saved: DataFrame, codes: DataFrame) -> DataFrame:
    """Per scenario: planned and saved samples, saved ones that nobody planned or that came twice, and whether the run is complete."""
    p = planned.groupBy("scenario").agg(F.count_distinct("sample_id").alias("planned"))
    s = saved.join(planned.select("scenario", "sample_id", F.lit(True).alias("_p")).distinct(), ["scenario", "sample_id"], "left").groupBy("scenario").agg(
        F.count("*").alias("saved"), F.count_if(F.col("_p").isNull()).alias("unknown"), (F.count("*") - F.count_distinct("sample_id")).alias("repeated"))
    c = codes.groupBy("scenario").agg(F.bool_and(F.col("returncode") == 0).alias("ok"))
    j = p.join(s, "scenario", "left").join(c, "scenario", "left").na.fill(0, ["saved", "unknown", "repeated"])
    good = F.coalesce("ok", F.lit(False)) & (F.col("saved") == F.col("planned")) & (F.col("unknown") == 0) & (F.col("repeated") == 0)
    return j.select("scenario", "planned", "saved", "unknown", "repeated", F.when(good, "complete").otherwise("incomplete").alias("status"))


def batch_problems(train: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of the training batch and its metadata that don't pair up, or lie outside 0 to n - 1."""
    n = metadata.count()
    j = train.select("row_index", F.lit(1).alias("t")).join(metadata.groupBy("row_index").agg(F.count("*").alias("m")), "row_index", "full_outer")
    why = F.when(F.col("t").isNull(), "missing_row").when(F.col("m").isNull(), "missing_metadata").when(F.col("m") > 1, "duplicate_metadata").when(~F.col("row_index").between(0, n - 1), "index_out_of_range")
    return j.select("row_index", why.alias("problem")).where("problem IS NOT NULL")


def unused_rules(rules: DataFrame, records: DataFrame) -> DataFrame:
    """Configured simulator rules (sample_id, rule_id, turn) with their trigger count and whether they were used."""
    hits = records.groupBy("sample_id", "rule_id").agg(F.count("*").alias("triggers"))
    j = rules.join(hits, ["sample_id", "rule_id"], "left").na.fill(0, ["triggers"])
    return j.withColumn("used", F.col("triggers") > 0)


def markdown(rows: list, columns: list[str]) -> str:
    """A small collected aggregate as a Markdown table; nulls are a dash, bars are escaped."""
    cell = lambda v: "—" if v is None else (f"{v:.1%}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]) + "\n"
