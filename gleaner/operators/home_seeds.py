"""Rules on seeds and templates: whether a home seed keeps its template's contract, which presets suit a template, whether weather
templates are complete. Template texts are inputs; the rules are here.

A seed row holds design_version, template_id, variant_id, request_form, question_pattern_id, preset, seed_id,
variable_group_id, user_turns, scenario_ids, target and first_target (arrays of entity_id, desired_state; first_target
null if absent), selector (kind, index, entity_id), fields (the names of all its keys) and scenes: the scenarios of each turn as its
template and variant define them (array of arrays; null where there is no such template).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.records import turn_scenarios

# Keys that seeds no longer have, request forms and the templates that may have them, wordings, device categories.
DEPRECATED = ("device_fixture", "tool_behavior", "turn_expectations", "reply_action", "random_seed", "sample_type")
FORMS, FORM_TEMPLATES = ("single", "two_devices", "mixed"), ("T18", "T19", "T20")
PATTERNS = ("P1", "P2", "P3")
TWO_TARGETS, FIRST_TARGETS = ("T13", "T14"), ("T05", "T06", "T15", "T17")
CATEGORIES = ("插座", "灯", "开关")
#: Lists that a weather lexicon must hold. Fixed values.
LEXICON = ("default_cities", "province_cities", "ambiguous_places", "invalid_places", "weather_remarks", "other_requests", "vague_dates", "cancel_texts", "detail_questions")
DEVICES = "array<struct<entity_id:string,desired_state:string>>"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def problem(version: str, entities: Column | None = None) -> Column:
    """The first rule that a seed breaks. entities: the device ids of the preset that the seed runs on, where they are known."""
    tid, variant, form = F.col("template_id"), F.coalesce("variant_id", F.lit("basic")), F.coalesce("request_form", F.lit("single"))
    target, first, selector = F.coalesce("target", F.array().cast(DEVICES)), F.col("first_target"), F.col("selector")
    turns = F.coalesce("user_turns", F.array().cast("array<string>"))
    scenes = F.transform("scenes", lambda s, k: turn_scenarios(s, k + 1, tid, form))
    union = lambda a: F.sort_array(F.array_distinct(F.flatten(a)))
    after_error = (tid == "T20") & (variant == "query_after_error")
    both = F.concat(target, F.coalesce(first, F.array().cast(DEVICES)))
    known = lambda ds: F.filter(F.transform(ds, lambda d: d["entity_id"]), lambda e: e.isNotNull())
    twice = lambda ds: F.size(F.array_distinct(known(ds))) < F.size(known(ds))
    odd_state = F.exists(both, lambda d: d["desired_state"].isNotNull() & ~d["desired_state"].isin("on", "off"))
    count = F.when(tid == "T17", 0).when(tid.isin(*TWO_TARGETS) | (form == "two_devices"), 2).otherwise(1)
    query = (tid == "T02") | after_error
    used = F.concat(known(both), F.when(selector["kind"] == "exclude", F.array(selector["entity_id"])).otherwise(F.array().cast("array<string>")))
    picks = (selector["kind"] == "exclude") & ~_blank(selector["entity_id"]) | (selector["kind"] == "displayed_index") & (selector["index"] == 2) & selector["entity_id"].isNull()
    rules = [
        ((~F.col("design_version").eqNullSafe(F.lit(version))) | F.col("scenes").isNull(), "invalid_version_or_template"),
        (F.arrays_overlap("fields", F.array(*map(F.lit, DEPRECATED))), "deprecated_field"),
        (~F.col("question_pattern_id").isin(*PATTERNS), "invalid_question_pattern"),
        (_blank(F.col("preset")) | _blank(F.col("seed_id")) | _blank(F.col("variable_group_id")), "missing_identity"),
        (~form.isin(*FORMS) | ((form != "single") & ~tid.isin(*FORM_TEMPLATES)), "invalid_request_form"),
        ((tid == "T11") & selector.isNull(), "missing_target_selector"),
        (after_error & (first.isNull() | (form != "single")), "query_after_error_shape"),
        ((F.size(turns) != F.size(scenes)) | F.exists(turns, lambda t: _blank(t)), "turn_count_mismatch"),
        (union(F.array(F.coalesce("scenario_ids", F.array().cast("array<string>")))) != union(scenes), "scenario_set_mismatch"),
        ((F.size(target) > 2) | (F.size(first) > 2) | F.col("target").isNull(), "invalid_target"),
        (odd_state, "invalid_target_state"),
        (F.exists(known(both), lambda e: e == ""), "invalid_entity_id"),
        (twice(target) | F.coalesce(twice(first), F.lit(False)), "duplicate_target"),
        (selector.isNotNull() & ~F.coalesce(picks, F.lit(False)), "invalid_selector"),
        (tid.isin(*FIRST_TARGETS) & (variant != "no_action") & first.isNull(), "missing_first_target"),
        (F.size(target) != count, "target_count_mismatch"),
        ((tid == "T11") & F.get(target, F.lit(0))["entity_id"].isNotNull(), "prefilled_choice"),
        (F.exists(target, lambda d: d["desired_state"].isNull() != query), "target_state_mismatch"),
        ((tid == "T07") & (variant == "change_action") & first.isNull(), "missing_first_target"),
    ]
    if entities is not None:
        rules.append((F.size(F.array_except(used, entities)) > 0, "entity_not_in_preset"))
    # A rule that can't be judged (null) isn't kept, but for the two where absence is the rule's own question.
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(code in ("invalid_question_pattern",))), code) for bad, code in rules])


def polymorphic(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Seeds of rows that hold either a seed or a conversation with one, as JSON text: adds ``seed`` (canonical JSON) and problem."""
    v = F.try_parse_json(raw)
    inner = F.try_variant_get(v, "$.seed", "variant")
    keys = F.map_keys(F.from_json(raw, "map<string,variant>"))
    seed = F.when(F.array_contains(keys, "seed"), inner).otherwise(v)
    template = F.try_variant_get(seed, "$.template_id", "string")
    bad = F.coalesce(~F.schema_of_variant(seed).startswith("OBJECT"), F.lit(True)) | (F.coalesce(template, F.lit("")) == "")
    return rows.withColumn("seed", F.when(~bad, F.to_json(seed))).withColumn("problem", F.when(bad, "seed_without_template"))


def category(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(CATEGORIES[0])), CATEGORIES[0]).when(F.contains(name, F.lit(CATEGORIES[1])), CATEGORIES[1]).otherwise(CATEGORIES[2])


#: How many switchable devices a template needs (others: one), and which of them must be of one category. Fixed values.
NEEDS = {"T05": 2, "T07": 2, "T10": 2, "T11": 2, "T13": 2, "T14": 3, "T15": 2, "T17": 2}
ALIKE = ("T07", "T10", "T11", "T14", "T17")
LONE_VARIANTS = ("no_action", "cancel_after_execution")


def eligible(presets: DataFrame, templates: DataFrame) -> DataFrame:
    """(preset, template_id, variant_id, eligible): presets (preset, special, devices of name and controllable, faulty: its initial
    state is disconnected, outdated, hidden, in error or unknown; n_rules) against templates (template_id, variant_id), a
    dimension of some dozens of rows."""
    counted = F.filter("devices", lambda d: d["controllable"])
    of = lambda c: F.size(F.filter(counted, lambda d: category(d["name"]) == c))
    p = presets.select("preset", "special", "faulty", "n_rules", F.size(counted).alias("_n"), *[of(c).alias(f"_c{k}") for k, c in enumerate(CATEGORIES)])
    needs = F.create_map(*[F.lit(x) for kv in NEEDS.items() for x in kv])
    t = templates.select("template_id", F.coalesce("variant_id", F.lit("basic")).alias("variant_id"))
    lone, tid = F.col("variant_id").isin(*LONE_VARIANTS), F.col("template_id")
    t = t.withColumn("_need", F.when((tid != "T14") & lone, 1).otherwise(F.coalesce(F.try_element_at(needs, tid), F.lit(1)))).withColumn("_alike", tid.isin(*ALIKE) & ~lone)
    j = p.withColumn("_k", F.lit(1)).join(F.broadcast(t.withColumn("_k", F.lit(1))), "_k")  # a row per preset and template
    alike = F.lit(False)
    for k in range(len(CATEGORIES)):
        exact = (tid == "T11") & (F.col("variant_id") == "exclude")
        alike = alike | F.when(exact, F.col(f"_c{k}") == 2).otherwise(F.col(f"_c{k}") >= F.col("_need"))
    plain = ~F.col("special") & (F.col("_n") >= F.col("_need")) & (~F.col("_alike") | alike)
    fits = F.when(F.col("_n") == 0, False).when(tid == "T19", F.col("special") & F.col("faulty")).when(tid == "T20", F.col("special") & (F.col("n_rules") > 0)).otherwise(plain)
    return j.select("preset", "template_id", "variant_id", F.coalesce(fits, F.lit(False)).alias("eligible"))


def template_problems(templates: DataFrame, expected: list[str], lexicon: dict) -> DataFrame:
    """(template_id, problem) of weather templates (place, template_id, patterns: array of arrays of texts, n_variables,
    n_constraints, scenario_ids) and of a lexicon's lists."""
    order = F.array(*map(F.lit, expected))
    p = F.col("patterns")
    shaped = F.forall(p, lambda x: (F.size(x) > 0) & F.forall(x, lambda t: F.coalesce(t != "", F.lit(False))))
    code = (
        F.when(F.coalesce(F.get(order, F.col("place").cast("int")) != F.col("template_id"), F.lit(True)), "template_ids_differ").when(F.coalesce(F.size(p) != 3, F.lit(True)), "not_three_patterns")
        .when(~F.coalesce(shaped, F.lit(False)), "empty_pattern").when(F.size(F.array_distinct(p)) != 3, "equal_patterns")
        .when(F.coalesce((F.col("n_variables") <= 0) | (F.col("n_constraints") <= 0) | (F.size("scenario_ids") <= 0), F.lit(True)), "missing_parts"))
    rows = templates.select("template_id", code.alias("problem")).where("problem IS NOT NULL")
    spark = templates.sparkSession
    absent = spark.createDataFrame([(t,) for t in expected], "template_id string").join(templates.select("template_id").distinct(), "template_id", "left_anti").select("template_id", F.lit("template_missing").alias("problem"))
    lacking = [(None, f"lexicon_lacks:{k}") for k in LEXICON if not lexicon.get(k)]
    return rows.unionByName(absent).unionByName(spark.createDataFrame(lacking, "template_id string, problem string"))
