"""Weather seeds: templates x groups x wordings, with the variables that a group draws and the turns that follow from them.

Distributed rejection sampling. In each round every open group draws all its variables from a hash of (seed, template, group, round); the
signature is what its template varies. Of the groups that drew a signature that no settled group of the template has, the first of
each signature settles; the others stay open for the next round. Settled groups never change, so the outcome depends on
neither partitions nor order. After ROUNDS rounds an open group is an error: its template has too few words.

templates: template_id, variables (array of names), patterns (array of wordings, each an array of turns with names in braces), scenario_ids,
target_only. lexicon: one row of LEXICON's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import day_phrase, let
from gleaner.operators.presets import draw
from gleaner.settled import Scratch

ROUNDS = 500
LEXICON = (
    "default_cities array<string>, province_cities array<struct<province:string,city:string>>, ambiguous_places array<struct<name:string,adm:string,city:string>>, invalid_places array<string>, "
    "weather_remarks array<string>, other_requests array<string>, vague_dates array<string>, cancel_texts array<string>, detail_questions array<struct<field:string,text:string>>"
)
# How kinds of questions and days are said, how far ahead and which templates are of which kind.
QUERY_TEXT = {"overview": "天气情况", "rain": "降雨情况", "temperature": "气温情况", "wind": "风力情况", "humidity": "湿度情况"}
GENERAL = ("overview", "rain", "temperature")
PAST = {1: "昨天", 2: "前天"}
AHEAD = (30, 60, 90, 365, 730)
FIRST_DAYS = (0, 1, 6)
ANSWERED = ("S01", "S02", "S05", "S06", "S07", "S10", "S11", "S12", "S13", "S15", "S19", "S20", "S21", "S22")
CITY_SAID = ("S02", "S05", "S06", "S07", "S17", "S19", "S20", "S21", "S22")
ELSEWHERE = ("S02", "S05", "S06", "S07", "S08", "S09", "S10", "S15", "S17", "S19", "S20", "S21", "S22")
UNDATED = ("S03", "S04", "S06", "S08", "S09", "S10")
FOLLOWED = ("S07", "S11", "S12", "S15", "S24")
#: Names that a wording may hold beside the variables themselves.
SAID = ("query_text", "day_text", "first_day_text", "start_text", "past_text", "future_text", "first_clause", "second_clause", "clarification_subject")
DRAWN = (
    "default_city", "target_city", "target_day", "query_kind", "date_mode", "weather_remark", "other_request", "request_order", "start_day", "day_count", "vague_date_text", "days_ago", "days_ahead",
    "province", "ambiguous_name", "target_adm", "invalid_location", "first_day", "first_city", "requested_field", "detail_question", "clarification_kind", "cancel_text",
)


def _drawn(groups: DataFrame, seed: str, default_city: str | None) -> DataFrame:
    """groups (template_id, group, round, the lexicon's arrays) with the variables DRAWN; null where a template has none of a kind."""
    t = F.col("template_id")
    unit = lambda name: draw(f"{seed}:{name}", t, F.col("group"), F.col("round"))
    below = lambda name, n: F.floor(unit(name) * n).cast("int")
    pick = lambda name, words: let(words, lambda w: F.get(w, F.floor(unit(name) * F.size(w)).cast("int")))
    city = lambda name, *but: pick(name, F.filter("default_cities", lambda c: ~F.coalesce(c.isin(*but), F.lit(False))) if but else F.col("default_cities"))
    only = lambda ids, c: F.when(t.isin(*ids), c)
    d = groups.withColumns({
        "default_city": F.lit(default_city) if default_city else city("default_city"),
        "query_kind": F.when((t == "S01") & F.lit(bool(default_city)), pick("query_kind", F.array(*map(F.lit, QUERY_TEXT)))).otherwise(pick("query_kind", F.array(*map(F.lit, GENERAL)))),
        "date_mode": F.when((t == "S01") | ((t == "S02") & (F.col("group") == 4)) | ((t == "S05") & (unit("date_mode") < 0.5)), "omitted").otherwise("relative"),
        "weather_remark": only(["S03"], pick("weather_remark", F.col("weather_remarks"))), "other_request": only(["S04", "S05"], pick("other_request", F.col("other_requests"))),
        "request_order": only(["S05"], pick("request_order", F.array(F.lit("weather_first"), F.lit("other_first")))), "start_day": only(["S06"], below("start_day", 6)),
        "days_ago": only(["S08"], below("days_ago", 14) + 1), "days_ahead": only(["S09"], pick("days_ahead", F.array(*map(F.lit, AHEAD)))),
        "clarification_kind": only(["S24"], F.when(F.col("group") % 2 == 1, "city").otherwise("date")), "cancel_text": only(["S24"], pick("cancel_text", F.col("cancel_texts"))),
        "invalid_location": only(["S15"], pick("invalid_location", F.col("invalid_places"))), "_pair": pick("province", F.col("province_cities")), "_place": pick("ambiguous_name", F.col("ambiguous_places")),
        "_detail": only(["S22"], pick("detail_question", F.col("detail_questions"))), "_vague": pick("vague_date_text", F.col("vague_dates")),
    })
    by_city, by_date = (F.coalesce(F.col("clarification_kind") == k, F.lit(False)) for k in ("city", "date"))
    undated = t.isin(*UNDATED) | by_date
    d = d.withColumns({
        "target_day": F.when(undated, F.lit(None).cast("int")).when(F.col("date_mode") == "omitted", 0)
        .when((t == "S02") & (F.col("group") <= len(FIRST_DAYS)), F.get(F.array(*map(F.lit, FIRST_DAYS)), F.col("group") - 1)).otherwise(below("target_day", 7)),
        "day_count": F.when(t == "S06", F.floor(unit("day_count") * (F.least(F.lit(4), 7 - F.col("start_day")) - 1)).cast("int") + 2),
        "province": F.when((t == "S11") | by_city, F.col("_pair.province")), "ambiguous_name": only(["S12", "S13"], F.col("_place.name")), "target_adm": only(["S12", "S13"], F.col("_place.adm")),
        "requested_field": F.col("_detail.field"), "detail_question": F.col("_detail.text"), "vague_date_text": F.when((t == "S07") | by_date, F.col("_vague")),
        "target_city": F.when(t == "S01", F.col("default_city")).when(t == "S11", F.col("_pair.city")).when(t.isin("S12", "S13"), F.col("_place.city")).when(by_date, city("target_city"))
        .when(t.isin(*ELSEWHERE), city("target_city", F.col("default_city"))),
    })
    days = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: k != F.col("target_day"))
    d = d.withColumns({
        # A place that is asked for isn't where the user is.
        "default_city": F.when(t.isin("S11", "S12", "S13") & (F.col("default_city") == F.col("target_city")), city("default_city_again", F.col("target_city"))).otherwise(F.col("default_city")),
        "first_day": only(["S19"], pick("first_day", days)), "first_city": only(["S20"], city("first_city", F.col("target_city"))),
    })
    named = F.create_map(*[x for n in DRAWN for x in (F.lit(n), F.col(n).cast("string"))])
    signature = F.to_json(F.transform("variables", lambda v: F.element_at(named, v)))
    return d.withColumn("signature", signature)


def _said(d: DataFrame) -> DataFrame:
    """Adds what the wordings say of the variables."""
    kind, day = F.col("query_kind"), F.col("target_day")
    text = F.element_at(F.create_map(*[F.lit(x) for kv in QUERY_TEXT.items() for x in kv]), kind)
    d = d.withColumns({
        "query_text": text, "day_text": F.when((F.col("date_mode") == "omitted") | day.isNull(), "").otherwise(day_phrase(day)), "first_day_text": day_phrase(F.col("first_day")), "start_text": day_phrase(F.col("start_day")),
        "past_text": F.coalesce(*[F.when(F.col("days_ago") == k, v) for k, v in PAST.items()], F.concat(F.col("days_ago").cast("string"), F.lit("天前"))), "future_text": F.concat(F.col("days_ahead").cast("string"), F.lit("天后")),
    })
    asked, first = F.concat(F.lit("查"), F.col("target_city"), F.col("day_text"), F.lit("的"), F.col("query_text")), F.col("request_order") == "weather_first"
    return d.withColumns({
        "first_clause": F.when(first, asked).otherwise(F.when(asked.isNotNull(), F.col("other_request"))), "second_clause": F.when(asked.isNotNull(), F.when(first, F.col("other_request")).otherwise(asked)),
        "clarification_subject": F.when(F.col("clarification_kind") == "city", F.concat("province", "day_text")).when(F.col("clarification_kind") == "date", F.concat("target_city", "vague_date_text")),
    })


def _turns(pattern: Column) -> Column:
    """A wording's turns with the names in braces filled in; a name without a value is an error."""

    def fill(turn: Column) -> Column:
        for n in (*DRAWN, *SAID):
            turn = F.replace(turn, F.lit("{" + n + "}"), F.coalesce(F.col(n).cast("string"), F.lit("{" + n + "}")))
        return turn

    def sure(turns: Column) -> Column:
        left = F.filter(turns, lambda x: x.rlike(r"\{\w+\}"))
        return F.when(F.size(left) == 0, turns).otherwise(F.raise_error(F.concat(F.lit("a wording lacks a variable: "), F.get(left, F.lit(0)))).cast("array<string>"))

    return let(F.transform(pattern, fill), sure)


def _scenarios() -> Column:
    """The template's scenarios and those that follow from what was drawn, each once, in order."""
    t, omitted = F.col("template_id"), F.col("date_mode") == "omitted"
    today = (t == "S01") | (omitted & ~t.isin("S03", "S04", "S24"))
    dated = F.col("target_day").isNotNull() & ~t.isin("S03", "S04", "S06", "S10", "S24")
    more = lambda when, *ids: F.when(F.coalesce(when, F.lit(False)), F.array(*map(F.lit, ids))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        "scenario_ids", more((t == "S24") & (F.col("clarification_kind") == "city"), "L04"), more((t == "S24") & (F.col("clarification_kind") == "date"), "T04"), more(today, "T01"), more(~today & dated, "T02"),
        more(t.isin(*CITY_SAID), "L01"), more(t == "S21", "L02"), more(t.isin("S11", "S12"), "M01"), more(t.isin(*ANSWERED), "F01", "O01", "O02"), more(t == "S15", "O02"), more(F.lit(True), "O04")))


def settled_groups(templates: DataFrame, lexicon: DataFrame, groups: int, seed: str = "seeds", default_city: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The variables of every group, each template's signatures all different."""
    scratch, name = Scratch(templates.sparkSession), ["template_id", "group"]
    every = scratch.settle(templates.withColumn("group", F.explode(F.sequence(F.lit(1), F.lit(groups)))))
    worded = lambda df: df.crossJoin(F.broadcast(lexicon))  # noqa: E731 - one row of words
    total, done = every.count(), None
    for k in range(rounds):
        # Only who settled with what is written; variables follow from the round again.
        open_ = every if done is None else every.join(done.select(*name), name, "left_anti")
        drawn = _drawn(worded(open_).withColumn("round", F.lit(k)), seed, default_city).select(*name, "round", "signature")
        fresh = drawn if done is None else drawn.join(done.select("template_id", "signature"), ["template_id", "signature"], "left_anti")
        won = fresh.groupBy("template_id", "signature").agg(F.min(F.struct("group", "round")).alias("b")).select("template_id", "b.group", "b.round", "signature")
        before, done = done, scratch.settle(won if done is None else done.unionByName(won))
        if before is not None:
            scratch.drop(before)
        if done.count() == total:
            # Settled: a wording reads each variable several times, and a variable is drawn from others.
            return scratch.settle(_drawn(worded(every.join(done.select(*name, "round"), name)), seed, default_city))
    short = every.join(done.select(*name), name, "left_anti").select("template_id").distinct().orderBy("template_id").limit(10) if done is not None else every.select("template_id").limit(10)
    raise ValueError(f"too few words for groups that differ: {', '.join(r['template_id'] for r in short.collect())}")


def generate(templates: DataFrame, lexicon: DataFrame, groups: int, seed: str = "seeds", default_city: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """A seed for each template, group and wording: templates x groups x wordings rows, always."""
    d = _said(settled_groups(templates, lexicon, groups, seed, default_city, rounds))
    d = d.withColumn("variable_group_id", F.format_string("%s-G%02d", "template_id", "group"))
    made = d.withColumn("_wordings", F.transform("patterns", _turns))
    same = F.size(F.array_distinct("_wordings")) < F.size("patterns")
    made = made.withColumn("_wordings", F.when(~same, F.col("_wordings")).otherwise(F.raise_error(F.concat(F.lit("equal wordings in "), "variable_group_id")).cast("array<array<string>>")))
    rows = made.select("*", F.posexplode("_wordings").alias("_k", "user_turns"))
    own = F.transform(F.filter("variables", lambda v: ~v.isin("default_city", "target_city", "target_day")), lambda v: F.struct(v.alias("key"), F.element_at(F.create_map(*[x for n in DRAWN for x in (F.lit(n), F.col(n).cast("string"))]), v).alias("value")))
    return rows.select(
        F.concat(F.col("variable_group_id"), F.lit("-P"), (F.col("_k") + 1).cast("string")).alias("seed_id"), "template_id", "variable_group_id", F.concat(F.lit("P"), (F.col("_k") + 1).cast("string")).alias("question_pattern_id"),
        "default_city", "target_city", "target_day", F.map_from_entries(own).alias("variables"), F.when(F.col("start_day").isNotNull(), F.sequence(F.col("start_day"), F.col("start_day") + F.col("day_count") - 1)).alias("target_days"),
        F.col("template_id").isin(*FOLLOWED).alias("expect_follow"), "user_turns", _scenarios().alias("scenario_ids"), F.coalesce("target_only", F.lit(False)).alias("target_only"))
