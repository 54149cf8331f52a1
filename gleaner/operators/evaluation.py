"""Evaluation of traces: which input a scorer takes, which checks a home turn gets, and what a simulator's rules were used for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import known_timezone
from gleaner.operators import weather_checks as wc
from gleaner.operators.aggregates import rate
from gleaner.operators.home_checks import READ, WRITE
from gleaner.operators.traces import CALLS

#: What a cut message ends with. Fixed value.
TRUNCATED = "...(truncated)"
_TEXTS = "array<string>"


def weather_trace(messages: Column, context: Column, seed: Column) -> Column:
    """The first reason why a weather scorer can't take a trace. context: base_date, timezone, default_city (texts),
    trace_complete; seed: template_id, scenario_ids, default_city, user_turns."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    known = F.array(*map(F.lit, wc.SCENARIO_CHECKS))
    before = F.coalesce(
        F.when(~F.coalesce(seed["template_id"].isin(*wc.TURN_CHECKS), F.lit(False)), "unknown_template"),
        F.when(F.coalesce((F.size(seed["scenario_ids"]) <= 0) | (F.size(F.array_except(seed["scenario_ids"], known)) > 0), F.lit(True)), "missing_scenario_mapping"),
        F.when(blank(context["base_date"]) | blank(context["timezone"]) | blank(context["default_city"]), "invalid_sample_schema"),
        F.when(~F.coalesce(context["base_date"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) | F.try_to_timestamp(context["base_date"], F.lit("yyyy-MM-dd")).isNull(), "invalid_sample_schema"),
        F.when(~known_timezone(context["timezone"]), "invalid_sample_schema"),
        F.when(~F.coalesce(context["trace_complete"], F.lit(False)), "incomplete_message_trace"),
        F.when(~context["default_city"].eqNullSafe(seed["default_city"]), "default_city_mismatch"),
        F.when(F.coalesce(F.size(messages) <= 0, F.lit(True)), "invalid_sample_schema"),
    )
    zero = F.struct(
        F.lit(0).alias("turns"), F.array().cast(_TEXTS).alias("pending"), F.array().cast(_TEXTS).alias("ids"), F.lit(True).alias("closed"), F.lit(False).alias("open_turn"), F.lit(None).cast("string").alias("reason"))

    def step(s: Column, m: Column) -> Column:
        role, content, calls = F.coalesce(m["role"], F.lit("")), m["content"], F.coalesce(m["tool_calls"], F.array().cast(CALLS))
        ids, waiting, user = F.transform(calls, lambda c: c["id"]), F.size(s["pending"]) > 0, F.coalesce(m["role"] == "user", F.lit(False))
        inside = user | (s["turns"] > 0)

        def call(c: Column, k: Column) -> Column:
            odd = blank(c["id"]) | ~c["type"].eqNullSafe(F.lit("function")) | c["function"]["name"].isNull()
            again = F.array_contains(s["ids"], c["id"]) | (F.array_position(ids, c["id"]) != k + 1)
            return F.when(odd, "invalid_tool_call").when(again, "duplicate_tool_call_id")

        said = F.coalesce(content, F.lit("")) != ""
        reason = (
            F.when(~role.isin("system", "user", "assistant", "tool"), "invalid_message").when(F.contains(F.coalesce(content, F.lit("")), F.lit(TRUNCATED)), "truncated_message")
            .when((role != "assistant") & content.isNull(), "invalid_message").when(user & waiting, "missing_tool_result").when(~inside & (role != "system"), "invalid_message_order")
            .when((role == "assistant") & said & waiting, "missing_tool_result").when(role == "assistant", F.get(F.array_compact(F.transform(calls, call)), F.lit(0)))
            .when((role == "tool") & ~F.coalesce(F.array_contains(s["pending"], m["tool_call_id"]), F.lit(False)), "tool_call_id_mismatch")
        )
        # A turn is closed when its last message is a reply without calls.
        closed = F.when(user, F.lit(False)).when(inside, (role == "assistant") & said & (F.size(calls) == 0)).otherwise(s["closed"])
        return F.struct(
            (s["turns"] + F.when(user, 1).otherwise(0)).alias("turns"),
            F.when(role == "tool", F.array_remove(s["pending"], F.coalesce(m["tool_call_id"], F.lit("")))).when(role == "assistant", F.array_union(s["pending"], ids)).otherwise(s["pending"]).alias("pending"),
            F.when(role == "assistant", F.concat(s["ids"], ids)).otherwise(s["ids"]).alias("ids"), closed.alias("closed"),
            (s["open_turn"] | (user & (s["turns"] > 0) & ~s["closed"])).alias("open_turn"), F.coalesce(s["reason"], reason).alias("reason"))

    users = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])
    end = lambda s: F.coalesce(s["reason"], F.when(F.size(s["pending"]) > 0, "missing_tool_result"), F.when(~users.eqNullSafe(seed["user_turns"]), "user_turn_mismatch"), F.when(s["open_turn"] | ~s["closed"], "missing_final_reply"))
    return F.coalesce(before, F.aggregate(messages, zero, step, end))


def home_trace(messages: Column, context: Column, user_turns: Column, seed_problem: Column) -> Column:
    """The first reason why a home scorer can't take a trace. context: trace_complete, internal_message_indices, public_catalog (array of
    entity_id, ..); seed_problem: what home_seeds.problem says of its seed."""
    entities = F.transform(context["public_catalog"], lambda d: d["entity_id"])
    internal = F.coalesce(context["internal_message_indices"], F.array().cast("array<int>"))
    before = F.coalesce(
        F.when(seed_problem.isNotNull() | context["public_catalog"].isNull() | (F.size(F.array_distinct(entities)) != F.size(entities)) | ~F.coalesce(context["trace_complete"], F.lit(False)), "invalid_sample_schema"),
        F.when(F.coalesce(F.size(messages) <= 0, F.lit(True)), "invalid_message_trace"),
    )
    zero = F.struct(
        F.lit(0).alias("turns"), F.array().cast(_TEXTS).alias("open"), F.array().cast(_TEXTS).alias("ids"), F.lit(0).alias("unanswered"), F.lit(0).alias("replies"), F.lit(False).alias("silent"), F.lit(None).cast("string").alias("reason"))

    def step(s: Column, x: Column) -> Column:
        m, user = x["m"], F.coalesce(x["m"]["role"] == "user", F.lit(False)) & ~F.array_contains(internal, x["k"])
        role, calls = F.coalesce(m["role"], F.lit("")), F.coalesce(m["tool_calls"], F.array().cast(CALLS))
        ids, speaks = F.transform(calls, lambda c: c["id"]), F.coalesce(m["role"] == "assistant", F.lit(False))
        doubled = F.exists(F.transform(ids, lambda i, k: F.coalesce((i == "") | F.array_contains(s["ids"], i) | (F.array_position(ids, i) != k + 1), F.lit(True))), lambda b: b)
        answers = (role == "tool") & F.coalesce(F.array_contains(s["open"], m["tool_call_id"]), F.lit(False))
        reason = (
            F.when(~role.isin("system", "user", "assistant", "tool") | (speaks & (s["turns"] == 0)), "invalid_message").when(speaks & doubled, "duplicate_tool_call").when((role == "tool") & ~answers, "orphan_tool_result"))
        spoke = F.when(speaks & (F.coalesce(m["content"], F.lit("")) != ""), 1).otherwise(0)
        return F.struct(
            (s["turns"] + user.cast("int")).alias("turns"),
            F.when(user, F.array().cast(_TEXTS)).when(speaks, F.array_union(s["open"], ids)).when(answers, F.array_remove(s["open"], F.coalesce(m["tool_call_id"], F.lit("")))).otherwise(s["open"]).alias("open"),
            F.when(speaks, F.concat(s["ids"], ids)).otherwise(s["ids"]).alias("ids"), (s["unanswered"] + F.when(speaks, F.size(ids)).when(answers, -1).otherwise(0)).alias("unanswered"),
            F.when(user, 0).otherwise(s["replies"] + spoke).alias("replies"), (s["silent"] | (user & (s["turns"] > 0) & (s["replies"] == 0))).alias("silent"), F.coalesce(s["reason"], reason).alias("reason"))

    placed = F.transform(messages, lambda m, k: F.struct(m.alias("m"), k.alias("k")))
    users = F.transform(F.filter(placed, lambda x: (x["m"]["role"] == "user") & ~F.array_contains(internal, x["k"])), lambda x: x["m"]["content"])
    end = lambda s: F.coalesce(
        s["reason"], F.when(s["turns"] == 0, "missing_user_turn"), F.when(~users.eqNullSafe(user_turns), "user_turn_mismatch"), F.when(s["unanswered"] > 0, "missing_tool_result"), F.when(s["silent"] | (s["replies"] == 0), "missing_final_reply"))
    return F.coalesce(before, F.aggregate(placed, zero, step, end))


# ---- which checks a home turn gets ----

HOME_CHECKS = ("HC01", "HC02", "HC03", "HC04", "HC05", "HC06", "HC07")
# The checks that a scenario leaves out, and those that a turn leaves out, as (template, variant, turn, checks), None for
# any; the first row that fits holds.
SCENARIO_LACKS = {"HS01": ("HC04",), "HS02": ("HC04",), "HS03": ("HC05",), "HS07": ("HC03",), "HS08": ("HC05",), "HS09": ("HC05",), "HS10": ("HC04",)}
TURN_LACKS = [
    ("T01", None, None, ("HC04",)),
    ("T02", None, None, ("HC04",)),
    ("T03", None, 1, ("HC04",)),
    ("T04", None, 1, ("HC04",)),
    ("T05", None, 1, ("HC04",)),
    ("T06", None, 1, ("HC04",)),
    ("T07", None, 1, ("HC03",)),
    ("T08", None, 1, ("HC03",)),
    ("T08", "missing_both", 2, ("HC03",)),
    ("T10", None, 1, ("HC03",)),
    ("T11", None, 1, ("HC03",)),
    ("T14", None, 1, ("HC03",)),
    ("T15", "ambiguous_reference", 2, ("HC03",)),
    ("T17", "no_action", None, ("HC03", "HC05")),
    ("T17", "cancel_after_execution", 1, ("HC04",)),
    ("T17", None, None, ("HC03",)),
    ("T18", None, 1, ("HC03",)),
    ("T20", "query_after_error", 1, ("HC05",)),
]
SCENARIOS = [f"HS{k:02d}" for k in range(1, 16)]


def home_candidates(turns: DataFrame) -> DataFrame:
    """(sample_id, template_id, turn, check_id, scenario_ids, reason): every candidate check of turns (sample_id, template_id,
    variant_id, turn, scenario_ids, n_calls, has_snapshot); reason says why it is filtered."""
    variant = F.coalesce("variant_id", F.lit("basic"))

    def fits(t, v, n) -> Column:
        ok = F.col("template_id") == t
        ok = ok if v is None else ok & (variant == v)
        return ok if n is None else ok & (F.col("turn") == n)

    lacks = F.coalesce(*[F.when(fits(*r[:3]), F.array(*map(F.lit, r[3]))) for r in TURN_LACKS], F.array().cast(_TEXTS))
    lines = turns.sparkSession.createDataFrame([(s, c) for s in SCENARIOS for c in HOME_CHECKS if c not in SCENARIO_LACKS.get(s, ())], "scenario_id string, check_id string")
    rows = turns.withColumn("_lacks", lacks).withColumn("scenario_id", F.explode(F.array_distinct("scenario_ids"))).join(F.broadcast(lines), "scenario_id")  # a row per scenario and check
    rows = rows.groupBy("sample_id", "template_id", "turn", "check_id").agg(F.sort_array(F.collect_set("scenario_id")).alias("scenario_ids"), F.first("_lacks").alias("_lacks"), F.first("n_calls").alias("n_calls"), F.first("has_snapshot").alias("has_snapshot"))
    reason = (
        F.when(F.array_contains("_lacks", F.col("check_id")), "template_turn_not_applicable").when((F.col("check_id") == "HC02") & (F.col("n_calls") == 0), "no_tool_call")
        .when((F.col("check_id") == "HC03") & ~F.col("has_snapshot"), "no_snapshot_result"))
    return rows.select("sample_id", "template_id", "turn", "check_id", "scenario_ids", reason.alias("reason"))


def plan_problems(planned: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples (sample_id, scenario_ids) with a scenario that no selected check bears, or a turn without any: (sample_id, code)."""
    chosen = planned.where("reason IS NULL")
    borne = chosen.select("sample_id", F.explode("scenario_ids").alias("scenario_id")).distinct()
    wanted = samples.select("sample_id", F.explode(F.array_distinct("scenario_ids")).alias("scenario_id"))
    bare = wanted.join(borne, ["sample_id", "scenario_id"], "left_anti").select("sample_id", F.lit("empty_scenario_result").alias("code"))
    empty = planned.groupBy("sample_id", "turn").agg(F.count_if(F.col("reason").isNull()).alias("n")).where("n = 0").select("sample_id", F.lit("empty_turn").alias("code"))
    return bare.union(empty).distinct()


def judge_expected(check: Column, expected: Column) -> Column:
    """What of an expectation (struct of action, target, read_policy, control_policy, other_request) a judge of a check may see:
    three fields for HC05, nothing for HC07, all of it for the others. JSON text."""
    short = F.to_json(F.struct(*[expected[k].alias(k) for k in ("action", "target", "other_request")]), {"ignoreNullFields": "false"})
    return F.when(check == "HC07", "{}").when(check == "HC05", short).otherwise(F.to_json(expected, {"ignoreNullFields": "false"}))


def ordered(checks: DataFrame) -> DataFrame:
    """Checks of each sample in one array, by turn as a number and then by the key's text."""
    row = F.struct(F.col("turn").cast("int").alias("turn"), F.concat_ws(":", F.col("turn").cast("string"), "check_id").alias("key"), "check_id", "status")
    return checks.groupBy("sample_id").agg(F.sort_array(F.collect_list(row)).alias("checks"))  # at most a sample's checks


# ---- simulator rules ----

CASE = ["preset", "rule_id", "turn", "entity_id", "entity_name", "action", "occurrence", "outcome", "apply"]


def rule_cases(rules: DataFrame) -> DataFrame:
    """Rules with their defaults: turn 1, first occurrence, applied if accepted, the device's own id for a missing name."""
    return rules.withColumns({
        "preset": F.coalesce("preset", F.lit("unknown")), "turn": F.coalesce("turn", F.lit(1)), "occurrence": F.coalesce("occurrence", F.lit(1)), "entity_name": F.coalesce("entity_name", "entity_id"),
        "apply": F.coalesce("apply", F.col("outcome") == "accepted"),
    })


def _triggered(rules: DataFrame, records: DataFrame) -> DataFrame:
    hits = records.where("rule_id IS NOT NULL").select("sample_id", "rule_id").distinct().withColumn("_hit", F.lit(True))
    return rule_cases(rules).join(hits, ["sample_id", "rule_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def coverage(rules: DataFrame, records: DataFrame) -> DataFrame:
    """Per case of configured rules (sample_id and CASE): configured, triggered, unused and trigger_rate. records: sample_id, rule_id
    (null where no rule answered), turn, tool, entity_id, action."""
    hit = F.col("_hit")
    return _triggered(rules, records).groupBy(*CASE).agg(F.count("*").alias("configured"), F.count_if(hit).alias("triggered"), F.count_if(~hit).alias("unused"), F.try_divide(F.count_if(hit), F.count("*")).alias("trigger_rate"))


def coverage_totals(rules: DataFrame, records: DataFrame) -> DataFrame:
    """One row: samples with rules, with triggered ones and with unused ones, and occurrences."""
    t, hit = _triggered(rules, records), F.col("_hit")
    return t.agg(
        F.count_distinct("sample_id").alias("configured_samples"), F.count_distinct(F.when(hit, F.col("sample_id"))).alias("triggered_samples"), F.count_distinct(F.when(~hit, F.col("sample_id"))).alias("samples_with_unused_rules"),
        F.count("*").alias("configured_rule_occurrences"), F.count_if(hit).alias("triggered_rule_occurrences"), F.count_if(~hit).alias("unused_rule_occurrences"), F.try_divide(F.count_if(hit), F.count("*")).alias("trigger_rate"))


def unused_reasons(rules: DataFrame, records: DataFrame) -> DataFrame:
    """Why each unused rule wasn't triggered, by the calls that were made: (sample_id, rule_id, reason, other_turns)."""
    unused = _triggered(rules, records).where(~F.col("_hit")).select("sample_id", "rule_id", F.col("turn").alias("_turn"), F.col("entity_id").alias("_entity"), F.col("action").alias("_action"))
    j = unused.join(records.select("sample_id", "turn", "tool", "entity_id", "action"), "sample_id", "left")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    control, here, aimed = F.col("tool") == WRITE, F.col("turn") == F.col("_turn"), F.col("entity_id") == F.col("_entity")
    fits = control & aimed & (F.col("_action").isNull() | F.coalesce(F.col("_action") == F.col("action"), F.lit(False)))
    per = j.groupBy("sample_id", "rule_id", "_turn", "_entity", "_action").agg(
        F.sort_array(F.collect_set(F.when(fits & ~here, F.col("turn")))).alias("other_turns"), some(control & here & aimed).alias("mine"), some(control & here).alias("any"), some((F.col("tool") == READ) & here).alias("read"), some(here).alias("call"))
    reason = (
        F.when(F.size("other_turns") > 0, "matching_control_in_other_turn").when(F.col("mine"), "control_did_not_match_rule").when(F.col("any"), "controlled_other_device")
        .when(F.col("read"), "snapshot_without_target_control").when(F.col("call"), "no_target_control").otherwise("no_real_tool_call"))
    return per.select("sample_id", "rule_id", reason.alias("reason"), "other_turns")


def groups(samples: DataFrame) -> DataFrame:
    """Pass rates of positive and negative samples (sample_type, status): both kinds have a row."""
    kinds = samples.sparkSession.createDataFrame([("positive",), ("negative",)], "sample_type string")
    return kinds.join(samples.groupBy("sample_type").agg(*rate("status")), "sample_type", "left").na.fill(0, ["passed", "failed", "count"])


def uncovered(scenarios: DataFrame, members: DataFrame) -> DataFrame:
    """Scenarios (scenario_id) of which no sample has a result."""
    return members.select("scenario_id").distinct().join(scenarios.where("status IN ('pass', 'fail')").select("scenario_id").distinct(), "scenario_id", "left_anti")


# ---- scorers ----


@dataclass(frozen=True)
class Scorer:
    """What a scenario brings to scoring: its checks, the checks of its scenarios, a function from turns to candidate checks (with
    a reason where one is filtered) and functions that add one rule's verdict to turns each."""

    name: str
    version: int
    checks: tuple[str, ...]
    plan: Callable[[DataFrame], DataFrame]
    rules: dict[str, Callable[[DataFrame], DataFrame]]


SCORERS: dict[str, Scorer] = {}


def register(scorer: Scorer) -> Scorer:
    if scorer.name in SCORERS:
        raise ValueError(f"scorer_exists:{scorer.name}")
    unknown = set(scorer.rules) - set(scorer.checks)
    if unknown:
        raise ValueError(f"rules_without_check:{sorted(unknown)}")
    SCORERS[scorer.name] = scorer
    return scorer


def apply_rules(name: str, turns: DataFrame) -> DataFrame:
    """Turns with the verdicts of a registered scorer's rules."""
    for rule in SCORERS[name].rules.values():
        turns = rule(turns)
    return turns


def _register_own() -> None:
    from gleaner.operators import home_checks as hc

    register(Scorer("weather", 1, wc.ALL, wc.candidate_checks, {"C01": lambda t: wc.call_behaviour(wc.expectation(t)), "C02": wc.arguments, "C03": wc.city_kept}))
    register(Scorer("home_switch", 1, HOME_CHECKS, home_candidates, {"HC01": hc.protocols, "HC02": hc.arguments, "HC03": hc.ignored_state}))


_register_own()
