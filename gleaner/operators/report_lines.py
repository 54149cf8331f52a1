"""Reports as rows: a line with its section, its place in the section and its number at the place.

A report is a table like any other: every fact is an aggregate or a row of the scored tables, its line is made where it lies, and
only the sort by (section, place, k) puts the lines in order. ``write`` ranges them over part files whose names follow the order, so
a report of any length is written without the driver seeing it.

Null rates and empty values are dashes; shares have one digit, halves away from zero; bars, backslashes and line ends in values are
escaped. Inputs: samples (sample_id, template_id, status), checks (sample_id, turn, check_id, status, scenario_ids, reason, evidence:
array of message_index and quote), scenarios (sample_id, scenario_id, status), events (event, reason_code), errors (sample_id, template_id,
stage, error_code, message, detail).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import collapse, markdown_escape, truncate
from gleaner.settled import Scratch

DASH, TOP, QUOTE, QUOTES = "—", 10, 140, 2
#: What a check was filtered for. Fixed values are the codes.
MEANING = {
    "template_turn_not_applicable": "the template asks for no such check in this turn", "no_call_mode": "this turn may answer without a call", "no_weather_call": "no weather call in this turn",
    "no_new_weather_report": "no new sound report in this turn", "no_tool_call": "no call in this turn", "no_snapshot_result": "no snapshot in this turn",
}


def share(rate: Column) -> Column:
    """A share as a percentage with one digit; null where there is none."""
    tenths = F.floor(rate * 1000 + 0.5).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def cell(value: Column | str) -> Column:
    text = markdown_escape((F.col(value) if isinstance(value, str) else value).cast("string"))
    return F.when(F.coalesce(text, F.lit("")) == "", DASH).otherwise(text)


def row(*values: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(v) for v in values]), F.lit(" |"))


def _placed(section: int, df: DataFrame, place: list, lines: Column) -> DataFrame:
    """Lines (an array) of each row of df. place: texts that order the rows."""
    texts = F.array(*[F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("")) for p in place]) if place else F.array().cast("array<string>")
    rows = df.select(texts.alias("place"), F.posexplode(lines).alias("k", "line"))
    return rows.select(F.lit(section).alias("section"), "place", "k", "line")


def _head(section: int, one: DataFrame, *lines: str | Column) -> DataFrame:
    """Lines before a section's rows; one: a table of one row, whose columns they may name."""
    return _placed(section, one, [], F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]))


def _table(*headings: str) -> list[str]:
    return ["", "| " + " | ".join(headings) + " |", "|" + "---|" * len(headings)]


def _rates(df: DataFrame, *by: str) -> DataFrame:
    passed, failed = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    out = df.groupBy(*by).agg(passed.alias("passed"), failed.alias("failed"))
    return out.withColumn("rate", F.when(F.col("passed") + F.col("failed") > 0, F.col("passed") / (F.col("passed") + F.col("failed"))))


def _down(count: Column) -> Column:
    """A count as a text that sorts downwards."""
    return F.lpad((F.lit(10**15) - count).cast("string"), 16, "0")


def scoring(samples: DataFrame, checks: DataFrame, scenarios: DataFrame, events: DataFrame, errors: DataFrame, names: Mapping[str, str], planned: Mapping[str, int], version: str = "2") -> DataFrame:
    """The report of a scoring run. names: the checks; planned: scenarios of each category, a scenario's first letter."""
    spark, u = samples.sparkSession, lambda c: F.coalesce(c, F.lit(0).cast("long"))
    one = lambda df, *a: df.agg(*a)
    done, lost = one(samples, F.count("*").alias("done"), F.count_if(F.col("status") == "fail").alias("bad"), F.count_if(F.col("status") == "pass").alias("good")), one(errors, F.count("*").alias("lost"))
    judged = one(checks, F.count_if(F.col("status") == "pass").alias("cp"), F.count_if(F.col("status") == "fail").alias("cf"))
    chosen = one(events, F.count_if(F.col("event") == "check_selected").alias("selected"), F.count_if(F.col("event") == "check_filtered").alias("filtered"))
    core = Scratch(spark).settle(done.crossJoin(lost).crossJoin(judged).crossJoin(chosen))  # one row
    total = F.col("done") + F.col("lost")
    of = lambda a, n: F.when(n > 0, a / n)
    missing = F.greatest(F.col("selected") - F.col("cp") - F.col("cf"), F.lit(0))
    known = spark.createDataFrame([(k, v) for k, v in names.items()] or [], "check_id string, name string")
    kinds = spark.createDataFrame([(k, v) for k, v in planned.items()] or [], "category string, planned int")
    count = lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string"))

    by_check = known.join(_rates(checks, "check_id"), "check_id", "left").withColumns({"passed": u(F.col("passed")), "failed": u(F.col("failed"))})
    by_scenario = _rates(scenarios, "scenario_id")
    categories = kinds.join(by_scenario.where("rate IS NOT NULL").groupBy(F.substring("scenario_id", 1, 1).alias("category")).agg(F.count("*").alias("covered"), F.avg("rate").alias("rate")), "category", "left")
    failed = checks.where("status = 'fail'")
    affected = failed.groupBy("check_id").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"))
    affected = known.join(affected, "check_id", "left").crossJoin(F.broadcast(done))
    everything = samples.select("template_id", "status").unionByName(errors.select("template_id", F.lit("error").alias("status")))
    n = lambda s: F.count_if(F.col("status") == s)
    templates = everything.groupBy("template_id").agg(F.count("*").alias("n"), n("error").alias("lost"), n("pass").alias("passed"), n("fail").alias("failed"))
    sets = failed.groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_set("check_id")), "+").alias("combination"))  # a sample's checks
    combos = sets.groupBy("combination").agg(F.count("*").alias("n"))
    ranked = combos.orderBy(F.desc("n"), "combination").limit(TOP)
    rest = combos.agg(F.greatest(F.count("*") - TOP, F.lit(0)).alias("rest"))
    reasons = events.where("event = 'check_filtered'").groupBy("reason_code").agg(F.count("*").alias("n"))
    meaning = F.coalesce(*[F.when(F.col("reason_code") == k, v) for k, v in MEANING.items()], F.col("reason_code"))

    proof = F.transform(F.slice("evidence", 1, QUOTES), lambda e: F.concat(F.lit("message "), e["message_index"].cast("string"), F.lit(": "), truncate(collapse(e["quote"]), QUOTE)))
    more = F.when(F.size("evidence") > QUOTES, F.array(F.concat(F.lit("and "), (F.size("evidence") - QUOTES).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    shown = F.array_join(F.concat(proof, more), "<br>")
    bad = samples.where("status = 'fail'").select("sample_id", "template_id")
    details = failed.join(bad, "sample_id")
    heads = bad.join(failed.groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_set("check_id")), ", ").alias("ids")), "sample_id", "left")

    parts = [
        _head(1, core, "# Scores", "", f"Rules: {version}", *_table("measure", "result"), row(F.lit("scored"), F.concat_ws(" ", count(F.col("done"), total), share(of(F.col("done"), total)))),
              row(F.lit("samples passed"), F.concat_ws(" ", count(F.col("good"), F.col("good") + F.col("bad")), share(of(F.col("good"), F.col("good") + F.col("bad"))))),
              row(F.lit("checks passed"), F.concat_ws(" ", count(F.col("cp"), F.col("cp") + F.col("cf")), share(of(F.col("cp"), F.col("cp") + F.col("cf"))))), row(F.lit("checks filtered"), "filtered"), row(F.lit("scoring errors"), "lost")),
        _head(2, core, "", "## Checks", *_table("check", "passed", "failed", "rate")), _placed(2, by_check, ["check_id"], F.array(row(F.concat_ws(" ", "check_id", "name"), "passed", "failed", share(F.col("rate"))))),
        _head(3, core, "", "## Categories", *_table("category", "covered", "mean rate")), _placed(3, categories, ["category"], F.array(row("category", count(u(F.col("covered")), F.col("planned")), share(F.col("rate"))))),
        _head(4, core, "", "## Scenarios", *_table("scenario", "passed", "failed", "rate")), _placed(4, by_scenario, ["scenario_id"], F.array(row("scenario_id", "passed", "failed", share(F.col("rate"))))),
        _head(5, core, "", "## Failures", "", F.concat(F.col("done").cast("string"), F.lit(" scored, "), F.col("bad").cast("string"), F.lit(" failed.")), *_table("check", "name", "failed", "samples", "share")),
        _placed(5, affected, ["check_id"], F.array(row("check_id", "name", u(F.col("n")), u(F.col("samples")), share(of(u(F.col("samples")), F.col("done")))))),
        _head(6, core, *_table("template", "input", "scored", "errors", "passed", "failed", "rate")),
        _placed(6, templates, ["template_id"], F.array(row("template_id", "n", F.col("n") - F.col("lost"), "lost", "passed", "failed", share(of(F.col("passed"), F.col("passed") + F.col("failed")))))),
        _head(7, core, *_table("checks that fail together", "samples")), _placed(7, ranked, [_down(F.col("n")), "combination"], F.array(row("combination", "n"))),
        _placed(7, rest.where("rest > 0"), [F.lit("~")], F.array(F.lit(""), F.concat(F.lit("The first "), F.lit(str(TOP)), F.lit("; "), F.col("rest").cast("string"), F.lit(" more.")))),
        _head(8, core, "", "## Selection", *_table("step", "checks"), row(F.lit("candidates"), F.col("selected") + F.col("filtered")), row(F.lit("filtered"), "filtered"), row(F.lit("selected"), "selected"), row(F.lit("scored"), F.col("cp") + F.col("cf")), row(F.lit("lost to errors"), missing),
              *_table("filtered for", "checks", "meaning")),
        _placed(8, reasons, ["reason_code"], F.array(row(F.concat(F.lit("`"), "reason_code", F.lit("`")), "n", meaning))),
        _head(9, core, "", "## Scoring errors", F.when(F.col("lost") == 0, "None.").otherwise("They count neither as passed nor as failed."), *_table("sample", "template", "stage", "code", "reason", "detail")),
        _placed(9, errors, ["sample_id"], F.array(row("sample_id", "template_id", "stage", F.concat(F.lit("`"), "error_code", F.lit("`")), "message", truncate(F.col("detail"), 80)))),
        _head(10, core, "", "## Failed samples"),
        _placed(10, bad.groupBy("template_id").agg(F.count("*").alias("n")), ["template_id"], F.array(F.lit(""), F.concat(F.lit("### "), cell("template_id"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")))),
        _placed(10, heads, ["template_id", "sample_id"], F.array(*map(F.lit, [""]), F.concat(F.lit("#### "), cell("sample_id")), F.lit(""), F.concat(F.lit("Failed: "), cell("ids")), *map(F.lit, _table("turn", "check", "scenarios", "reason", "evidence")))),
        _placed(10, details, ["template_id", "sample_id", F.lpad(F.col("turn").cast("string"), 9, "0"), "check_id"], F.array(row("turn", "check_id", F.array_join("scenario_ids", ", "), "reason", shown))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(report: DataFrame, path: str, parts: int = 1) -> None:
    """The lines in order as text; the part files' names follow the order. The folder must not exist."""
    order = ["section", "place", "k"]
    report.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order).select("line").write.mode("errorifexists").text(path)
