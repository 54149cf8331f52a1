"""Deterministic checks of weather turns: what a turn is expected to do, and rules C01 to C03, as columns.

A turn row holds its seed (struct), template_id, turn, base_date, the arguments of its weather calls (array of JSON texts),
the latest report at or before it (city, dates, first report's dates for S10) and the replies after that report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import city_in_reply, same_adm, same_city, same_qualified_location

# The checks of each scenario, and the checks that each turn of a template allows.
ALL = ("C01", "C02", "C03", "C04", "C05", "C06", "C07")
SCENARIO_CHECKS = {
    "R01": ("C01", "C02", "C05"),
    "R02": ("C01", "C06"),
    "R03": ("C01", "C05"),
    "R04": ("C01", "C02", "C05"),
    "T01": ("C04", "C05"),
    "T02": ("C01", "C02", "C05"),
    "T03": ("C05",),
    "T04": ("C04", "C05"),
    "T05": ("C02", "C04", "C06"),
    "T06": ("C02", "C04", "C06"),
    "T07": ("C05", "C06"),
    "L01": ("C01", "C02"),
    "L02": ("C01", "C02"),
    "L04": ("C01", "C02", "C04"),
    "L05": ("C01", "C02", "C04"),
    "L06": ("C02", "C04"),
    "L08": ("C01", "C02", "C04", "C06"),
    "F01": ("C01", "C02", "C04", "C05"),
    "F02": ("C01", "C02", "C04", "C06"),
    "M01": ("C05",),
    "M02": ("C01", "C02", "C05"),
    "M03": ("C01", "C02", "C05"),
    "M04": ("C01", "C02", "C05"),
    "O01": ("C05", "C06"),
    "O02": ("C03", "C05"),
    "O03": ("C01", "C04", "C06"),
    "O04": ("C07",),
    "G02": ("C01", "C04"),
}
TURN_CHECKS = {
    "S01": [ALL],
    "S02": [ALL],
    "S03": [("C01", "C06", "C07")],
    "S04": [("C01", "C05", "C07")],
    "S05": [ALL],
    "S06": [ALL],
    "S07": [("C02", "C04", "C07"), ALL],
    "S08": [("C02", "C04", "C06", "C07")],
    "S09": [("C02", "C04", "C06", "C07")],
    "S10": [ALL, ALL],
    "S11": [("C02", "C04", "C07"), ALL],
    "S12": [("C02", "C04", "C07"), ALL],
    "S13": [ALL],
    "S15": [("C02", "C04", "C06", "C07"), ALL],
    "S17": [("C01", "C02", "C04", "C06", "C07")],
    "S19": [ALL, ALL],
    "S20": [ALL, ALL],
    "S21": [ALL, ALL],
    "S22": [ALL],
    "S24": [("C02", "C04", "C07"), ("C01", "C04", "C07")],
}
#: Scenarios that hold on one turn only: (template, scenario) -> turn. S24 keeps only these and O04.
ONE_TURN = {("S24", "G02"): 2, ("S24", "T04"): 1, ("S24", "L04"): 1, ("S07", "T04"): 1, ("S21", "L02"): 1, ("S21", "L01"): 2, ("S15", "O02"): 2}


def candidate_checks(turns: DataFrame) -> DataFrame:
    """(sample_id, template_id, turn, check_id, scenario_ids, reason): every candidate check of turns with scenario_ids;
    reason says why it is filtered. Turns carry call_mode, n_calls and has_report."""
    spark = turns.sparkSession
    per_scenario = F.broadcast(spark.createDataFrame([(s, c) for s, v in SCENARIO_CHECKS.items() for c in v], "scenario_id string, check_id string"))
    allowed = F.broadcast(spark.createDataFrame([(t, k + 1, c, True) for t, v in TURN_CHECKS.items() for k, w in enumerate(v) for c in w], "template_id string, turn int, check_id string, allowed boolean"))
    only = F.broadcast(spark.createDataFrame([(t, s, k) for (t, s), k in ONE_TURN.items()], "template_id string, scenario_id string, _only int"))
    rows = turns.withColumn("scenario_id", F.explode(F.array_distinct("scenario_ids"))).join(only, ["template_id", "scenario_id"], "left")
    lone = (F.col("template_id") == "S24") & F.col("_only").isNull() & (F.col("scenario_id") != "O04")
    rows = rows.where(F.coalesce(F.col("_only") == F.col("turn"), F.lit(True)) & ~lone).join(per_scenario, "scenario_id")
    keys = ["sample_id", "template_id", "turn", "call_mode", "n_calls", "has_report", "check_id"]
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("scenario_id")).alias("scenario_ids")).join(allowed, ["template_id", "turn", "check_id"], "left")
    reason = (
        F.when(F.col("allowed").isNull(), "template_turn_not_applicable").when((F.col("check_id") == "C01") & F.col("call_mode").isNull(), "no_call_mode")
        .when((F.col("check_id") == "C02") & (F.col("n_calls") == 0), "no_weather_call").when((F.col("check_id") == "C03") & ~F.col("has_report"), "no_new_weather_report")
    )
    return rows.select("sample_id", "template_id", "turn", "check_id", "scenario_ids", reason.alias("reason"))


def expectation(turns: DataFrame) -> DataFrame:
    """Adds ``expected``: action, call_mode, city, adm, known_location, ambiguous_name, default_mode and dates."""
    t, n, s = F.col("template_id"), F.col("turn"), lambda k: F.col(f"seed.{k}")
    first, second = n == 1, n == 2
    is_ = lambda *names: t.isin(*names)
    null = F.lit(None).cast("string")
    kind = F.coalesce(s("clarification_kind"), F.lit(""))
    ask_date = first & (is_("S07") | (is_("S24") & (kind == "date")))
    ask_province = first & (is_("S11") | (is_("S24") & (kind != "date")))
    ask_name, ask_place, cancel = first & is_("S12"), first & is_("S15"), second & is_("S24")
    action = (
        F.when(ask_date, "clarify_date").when(ask_province, "clarify_province_city").when(ask_name, "clarify_ambiguous_city").when(ask_place, "request_location_correction")
        .when(cancel, "cancel_request").when(is_("S03"), "chat_about_weather").when(is_("S04"), "answer_other_request").when(is_("S08", "S09"), "explain_capability_limit")
        .when(is_("S17"), "explain_tool_error").when(is_("S10") & first, "explain_forecast_range").when(is_("S10"), "answer_forecast_boundary").otherwise("answer_weather")
    )
    free = ask_date | ask_province | ask_name | ask_place | is_("S08", "S09")
    mode = (
        F.when(free, null).when(cancel | is_("S03", "S04"), "forbidden").when((is_("S10") & (n != 1)) | (is_("S07", "S19") & second), "reuse_allowed").otherwise("required")
    )
    default = first & is_("S01", "S21")
    city = (
        F.when(ask_province | ask_name | ask_place | cancel, null).when(default, s("default_city")).when(first & is_("S20"), s("first_city")).otherwise(s("target_city"))
    )
    by_city = first & is_("S24") & (kind == "city")
    adm = F.when(is_("S11") | by_city, s("province")).when(ask_name, null).otherwise(s("target_adm"))
    known = F.when(by_city | (first & is_("S11")), s("province")).when(first & is_("S12"), s("ambiguous_name")).when(first & is_("S15"), s("invalid_location")).otherwise(city)
    day = F.when(ask_date | cancel, F.lit(None).cast("int")).when(first & is_("S19"), s("first_day")).otherwise(s("target_day"))
    none = F.array().cast("array<int>")
    offsets = (
        F.when(is_("S08"), F.array(-s("days_ago"))).when(is_("S09"), F.array(s("days_ahead"))).when(action.startswith("clarify_") | (action == "cancel_request"), none)
        .when(s("target_days").isNotNull(), s("target_days")).when(day.isNotNull(), F.array(day)).otherwise(none)
    )
    dates = F.transform(offsets, lambda o: F.date_add("base_date", o).cast("string"))
    seen = F.size("first_report_dates") > 0
    last = F.array_max("first_report_dates")
    dates = F.when(is_("S10") & first & seen, F.col("first_report_dates")).when(is_("S10") & second & seen, F.array(last, F.date_add(last.cast("date"), 1).cast("string"))).otherwise(dates)
    return turns.withColumn("expected", F.struct(
        action.alias("action"), mode.alias("call_mode"), city.alias("city"), adm.alias("adm"), known.alias("known_location"), s("ambiguous_name").alias("ambiguous_name"), default.alias("default_mode"), dates.alias("dates")))


def call_behaviour(turns: DataFrame) -> DataFrame:
    """C01: adds ``c01``, the verdict on whether the turn queried as it had to, or reused a report that covers it."""
    e, called = F.col("expected"), F.size("calls") > 0
    wanted = F.when(e["action"] == "answer_forecast_boundary", F.slice(e["dates"], 1, 1)).otherwise(e["dates"])
    code = (
        F.when((e["call_mode"] == "required") & ~called, "missing_call").when((e["call_mode"] == "forbidden") & called, "forbidden_call")
        .when((e["call_mode"] == "reuse_allowed") & ~called & ~same_city(F.col("report_city"), e["city"]), "no_reusable_report")
        .when((e["call_mode"] == "reuse_allowed") & ~called & (F.size(F.array_except(wanted, F.coalesce("report_dates", F.array().cast("array<string>")))) > 0), "dates_not_covered")
    )
    return turns.withColumn("c01", F.struct(F.when(code.isNull(), "pass").otherwise("fail").alias("status"), code.alias("reason")))


def argument_problems(args: Column, e: Column) -> Column:
    """C02 for one call: its problems in order. Arguments are JSON text; a key that is there differs from a null one."""
    v = F.try_parse_json(args)
    entries = F.from_json(args, "map<string,variant>")
    keys = F.coalesce(F.map_keys(entries), F.array().cast("array<string>"))
    has = lambda k: F.array_contains(keys, k)
    text = lambda k: F.when(F.schema_of_variant(F.try_element_at(entries, F.lit(k))) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    blank = lambda k: F.coalesce(F.trim(text(k)), F.lit("")) == ""
    place, adm = text("location"), text("adm")
    no_place, no_adm = ~has("location") | place.isNull(), blank("adm")
    fits = same_city(place, e["city"]) | (same_city(place, e["ambiguous_name"]) & e["adm"].isNotNull() & same_adm(adm, e["adm"])) | same_qualified_location(place, e["city"], adm, e["adm"])
    where_ = (
        F.when(e["default_mode"], F.when(has("location") | has("adm"), "default_city_must_omit_location"))
        .when(e["city"].isNotNull(), F.when(~fits, "location_is_not_the_target"))
        .when(e["adm"].isNotNull() & ~no_place, "parent_region_is_no_city")
        .when(~no_place & ~same_city(place, e["known_location"]), "city_not_settled")
        .when(e["known_location"].isNotNull() & no_place & no_adm, "no_fallback_to_default_city")
    )
    found = F.array(
        F.when(F.size(F.array_except(keys, F.array(F.lit("location"), F.lit("adm"), F.lit("lang")))) > 0, "unknown_field"),
        F.when(blank("lang"), "missing_lang"),
        F.when(has("location") & blank("location"), "location_not_text"),
        F.when(has("adm") & blank("adm"), "adm_not_text"),
        where_,
        F.when(has("adm") & ~F.coalesce(same_adm(adm, e["adm"]), F.lit(False)), "adm_not_given_by_user"),
        F.when(F.coalesce(e["city"].isin("朝阳市", "朝阳区") & (place == "朝阳"), F.lit(False)) & no_adm, "ambiguous_place_without_region"),
    )
    return F.when(entries.isNull(), F.array(F.lit("arguments_not_object"))).otherwise(F.array_compact(found))


def arguments(turns: DataFrame) -> DataFrame:
    """C02: adds ``c02`` with the distinct problems of the turn's calls in order of first appearance."""
    problems = F.array_distinct(F.flatten(F.transform("calls", lambda a: argument_problems(a, F.col("expected")))))
    return turns.withColumn("c02", F.struct(F.when(F.size(problems) > 0, "fail").otherwise("pass").alias("status"), problems.alias("problems")))


def city_kept(turns: DataFrame) -> DataFrame:
    """C03: adds ``c03``: some reply after the report names the report's city, 市 aside."""
    ok = F.coalesce(F.exists("replies", lambda r: city_in_reply(F.col("report_city"), r)), F.lit(False))
    return turns.withColumn("c03", F.struct(F.when(ok, "pass").otherwise("fail").alias("status")))


def score(turns: DataFrame) -> DataFrame:
    return reduce(lambda df, f: f(df), (expectation, call_behaviour, arguments, city_kept), turns)
