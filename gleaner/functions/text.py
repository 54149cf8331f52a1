"""Scalar functions as columns: canonical JSON, digests, place names, dates and weather reports."""

from __future__ import annotations

import json
from zoneinfo import available_timezones

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "未提供"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable is not repeated where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def collapse(text: Column) -> Column:
    """White space of any script as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def label(value: Column) -> Column:
    """A field's value as a label; null and empty are MISSING."""
    return F.when(value.isNull() | (value.cast("string") == ""), F.lit(MISSING)).otherwise(value.cast("string"))


def remove_suffix(text: Column, *suffixes: str) -> Column:
    """Removes one occurrence of each suffix, one after the other."""
    for s in suffixes:
        text = F.regexp_replace(text, f"{s}$", "")
    return text


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def same_city(a: Column, b: Column) -> Column:
    """Equal but for white space and one trailing 市; false where either is null."""
    return F.coalesce(remove_suffix(_bare(a), "市") == remove_suffix(_bare(b), "市"), F.lit(False))


def same_adm(a: Column, b: Column) -> Column:
    return F.coalesce(remove_suffix(_bare(a), "省", "市") == remove_suffix(_bare(b), "省", "市"), F.lit(False))


def same_qualified_location(city: Column, expected: Column, adm: Column, expected_adm: Column) -> Column:
    """A district's short name is accepted only with a matching parent region. The first suffix in this order goes."""
    # Administrative suffixes in order of precedence.
    order = "特别行政区|自治州|自治县|新区|市|区|县"
    short = lambda c: F.regexp_replace(_bare(c), f"(?:{order})$", "")
    named = [F.coalesce(F.length(_bare(c)) > 0, F.lit(False)) for c in (city, expected, adm, expected_adm)]
    ok = (short(city) == short(expected)) & same_adm(adm, expected_adm)
    for n in named:
        ok = n & ok
    return F.coalesce(ok, F.lit(False))


def known_timezone(name: Column) -> Column:
    """Whether a text names a time zone of the IANA list, in its spelling; false for null."""
    return F.coalesce(name.isin(*sorted(available_timezones())), F.lit(False))


def city_in_reply(city: Column, reply: Column) -> Column:
    short = F.when((F.length(city) > 1) & city.endswith("市"), F.expr("1=1")).otherwise(F.lit(False))
    return F.coalesce(F.contains(reply, city) | (short & F.contains(reply, F.regexp_replace(city, "市$", ""))), F.lit(False))


def resolve_date(text: Column, base: Column) -> Column:
    """An ISO date in the text, else month and day in the year that brings it nearest to base (the earlier year on a
    tie), at most 31 days away; else null."""
    iso = F.regexp_extract(text, r"(\d{4})-(\d{1,2})-(\d{1,2})", 0)
    month, day = (F.regexp_extract(text, r"(\d{1,2})月(\d{1,2})日", k) for k in (1, 2))
    full = F.try_to_timestamp(iso, F.lit("yyyy-M-d")).cast("date")
    near = [F.try_to_timestamp(F.concat_ws("-", (F.year(base) + k).cast("string"), month, day), F.lit("yyyy-M-d")).cast("date") for k in (-1, 0, 1)]
    best = F.array_min(F.filter(F.array(*[F.struct(F.abs(F.datediff(c, base)).alias("d"), c.alias("c")) for c in near]), lambda s: s["c"].isNotNull()))
    return F.when(iso != "", full).when((month != "") & (best["d"] <= 31), best["c"])


def truncate(text: Column, limit: int) -> Column:
    """A text of at most ``limit`` characters, the last of them an ellipsis where something is missing."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def markdown_escape(text: Column) -> Column:
    """A text for a table cell: bars and backslashes escaped, line ends as blanks."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def split_turns(wording: Column) -> Column:
    """Turns of a wording that sets them apart by arrows and may number them."""
    return F.transform(F.split(wording, "→", -1), lambda t: F.regexp_replace(strip_all(t), r"(?U)^[①②③]\s*", ""))


#: How near days are said. Fixed values.
DAY_PHRASES, LATER = ("今天", "明天", "后天"), "天后"


def day_phrase(offset: Column) -> Column:
    """A day by its distance from today."""
    said = F.concat(offset.cast("string"), F.lit(LATER))
    for k, phrase in enumerate(DAY_PHRASES):
        said = F.when(offset == k, phrase).otherwise(said)
    return said


def merged_states(base: Column, override: Column) -> Column:
    """Two maps as one; the second's values hold where both have a key."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(F.coalesce(override, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), k))
    return F.when(override.isNull(), base).when(base.isNull(), override).otherwise(F.map_concat(kept, override))


def canonical_exact(text: Column) -> Column:
    """Canonical JSON that keeps numbers as Python writes them (1.0 stays 1.0) and the last of equal keys; null where the text is no
    JSON. Arrow batches in Python: for digests of data with float literals, where ``canonical_json`` would differ."""

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return each(text)


#: Head of a weather report, where its forecast section begins and ends, one day's line, and what other lines may say. Fixed values.
HEAD, SECTION, TAIL = r"^您查询的位置是[：:]\s*([^\n]+)", "未来7天预报：", "（如需"
ROW = r"^(.+?)[:：]\s*([^，,]+)[，,]\s*气温\s*(-?\d+(?:\.\d+)?)\s*[°℃度]*\s*[~～至]\s*(-?\d+(?:\.\d+)?)\s*[°℃度]*\s*$"
FIELD_PATTERNS = {
    "hourly_temperature": r"(?:15[:：]00|下午(?:三|3)点|15点).*?(?:温度|气温)",
    "hourly_rain": r"(?:降雨时间|开始下雨时间|(?:\d{1,2}[:：]\d{2}|\d{1,2}点).*?(?:下雨|降雨))",
    "minute_rain": r"(?:\d{1,2}[:：]\d{2}|\d{1,2}点\d{1,2}分).*?(?:开始下雨|开始降雨)",
    "rain_probability": r"(?:降水概率|降雨概率).*?\d+(?:\.\d+)?\s*%",
    "rain_duration": r"(?:雨|降水).*?持续.*?\d+(?:\.\d+)?\s*(?:小时|分钟)",
}
#: Where a text's lines end, as Unicode has it.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_CUT = "\u0001"


def parse_report(text: Column, base: Column) -> Column:
    """struct(city, forecast[(date, weather, low, high)], error); null if the text is no report. The first faulty line gives the
    error, and with an error there is no forecast. Each line is matched once. Put it in a column of its own before its
    fields are used, or each use parses again."""
    body = F.substring_index(F.substr(text, F.instr(text, SECTION) + F.lit(len(SECTION))), TAIL, 1)
    lines = F.filter(F.transform(F.split(body, LINE_END), strip_all), lambda x: x != "")
    fields = F.transform(lines, lambda x: F.split(F.regexp_replace(x, ROW, f"$1{_CUT}$2{_CUT}$3{_CUT}$4"), _CUT))
    spoken = lambda x: F.regexp_like(x, F.lit("|".join(FIELD_PATTERNS.values())))
    day = F.transform(fields, lambda p: F.when(F.size(p) == 4, F.struct(
        resolve_date(p[0], base).alias("date"), strip_all(p[1]).alias("weather"), p[2].try_cast("double").alias("low"), p[3].try_cast("double").alias("high"))).otherwise(
        F.when(spoken(F.get(p, F.lit(0))), F.struct(F.lit(None).cast("date").alias("date"), F.lit("").alias("weather"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))))
    # A line is a day (low is known), something else that may be said (low is null), or neither (null).
    fault = lambda r: (
        F.when(r.isNull(), "invalid_forecast_row").when(r["low"].isNotNull(), F.when(r["date"].isNull(), "invalid_forecast_date").when(r["low"] > r["high"], "invalid_temperature_range"))
    )

    def judged(rows: Column) -> Column:
        days = F.filter(rows, lambda r: r["low"].isNotNull())
        error = F.coalesce(
            F.when(~F.contains(text, F.lit(SECTION)), "missing_forecast_section"),
            F.get(F.array_compact(F.transform(rows, fault)), F.lit(0)),
            F.when(F.size(days) == 0, "empty_forecast"),
            F.when(F.size(F.array_distinct(F.transform(days, lambda r: r["date"]))) < F.size(days), "duplicate_forecast_date"),
        )
        return let(error, lambda e: F.struct(strip_all(F.regexp_extract(text, HEAD, 1)).alias("city"), F.when(e.isNull(), days).alias("forecast"), e.alias("error")))

    return F.when(F.regexp_like(text, F.lit(HEAD)), let(day, judged))
