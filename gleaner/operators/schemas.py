"""Tool definitions and the arguments of calls against them, as columns, to any depth.

JSON is walked level by level inside a row by a fold, so the expression has one size however deep a text nests. In arguments, a value
keeps its own text (numbers stay as they were written, members in their order) and its place: the positions on the way to it, which
compare as the text is read. Strings are marked before the walk, so the first character of a value's text tells its kind and each
value is parsed once; the fold carries the first fault and the values of one level, since a function over an array copies what it makes.

A definition is (type, name, specs); a spec is a place in its schema (type, required, keys, enum), found by its path: the names on
the way, parted by MARK, with ITEM for any item of an array. Types are strict: a boolean is no number, 1.0 no integer. What a
schema doesn't describe is not looked at. ``specs`` is null where the definition holds no parameters object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import let

MARK, ITEM = "\u0001", "\u0002"
SPEC = "struct<path:string,type:string,required:array<string>,keys:array<string>,enum:array<string>>"
TOOLS = f"array<struct<type:string,name:string,specs:map<string,array<{SPEC}>>>>"
_SCHEMA = "struct<type:string,required:array<string>,properties:map<string,string>,items:string,enum:array<variant>>"
_TEXTS, _NODE, _FAULT = "struct<path:string,raw:string>", "struct<place:string,path:string,raw:string>", "struct<place:string,code:string>"
#: A string of JSON, and what its content begins with in a marked text.
_STRING, _MARKED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"', "'"
#: Behind a place it makes one behind all that lies below a value.
_LAST = ":"


def _levels(first: Column, below, kind: str, text: Column) -> Column:
    """first and all that below() finds under it, level by level; text: what bounds the depth."""
    opened = F.length(text) - F.length(F.translate(text, "{[", ""))
    start = F.struct(F.array(first).cast(f"array<{kind}>").alias("all"), F.array(first).cast(f"array<{kind}>").alias("edge"))

    def step(found: Column, _: Column) -> Column:
        more = F.flatten(F.transform(found["edge"], below)).cast(f"array<{kind}>")
        return let(more, lambda m: F.when(F.size(m) <= 0, found).otherwise(F.struct(F.concat(found["all"], m).alias("all"), m.alias("edge"))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.coalesce(opened, F.lit(0)), F.lit(1))), start, step, lambda found: found["all"])


def _same(json: Column) -> Column:
    """A canonical value as it compares: truth is 1 or 0."""
    return F.when(json == "true", "1").when(json == "false", "0").otherwise(json)


def specs(schema: Column) -> Column:
    """The specs (array<SPEC>, more than one where the text repeats a name) of each path of a JSON schema's text."""

    def below(n: Column) -> Column:
        path = lambda name: F.concat(n["path"], F.lit(MARK), name)
        parts = lambda s: F.when(
            s["type"] == "object", F.transform(F.map_entries(s["properties"]), lambda e: F.struct(path(e["key"]).alias("path"), e["value"].alias("raw")))
        ).when((s["type"] == "array") & s["items"].isNotNull(), F.array(F.struct(path(F.lit(ITEM)).alias("path"), s["items"].alias("raw"))))
        return F.coalesce(let(F.from_json(n["raw"], _SCHEMA), parts), F.array().cast(f"array<{_TEXTS}>"))

    def spec(n: Column) -> Column:
        strings = F.array().cast("array<string>")
        return let(F.from_json(n["raw"], _SCHEMA), lambda s: F.struct(
            n["path"].alias("path"), s["type"].alias("type"), F.coalesce(s["required"], strings).alias("required"), F.coalesce(F.map_keys(s["properties"]), strings).alias("keys"),
            F.transform(s["enum"], lambda v: _same(F.coalesce(F.to_json(v), F.lit("null")))).alias("enum")))

    def by_path(found: Column) -> Column:
        paths = F.array_distinct(F.transform(found, lambda s: s["path"]))
        return F.map_from_entries(F.transform(paths, lambda p: F.struct(p, F.filter(found, lambda s: s["path"] == p))))

    return let(F.transform(_levels(F.struct(F.lit("").alias("path"), schema.alias("raw")), below, _TEXTS, schema), spec), by_path)


def _marked(text: Column) -> Column:
    """A JSON text whose strings begin with a mark, names too; null where the text is none."""
    return F.when(F.try_parse_json(text).isNotNull(), F.ltrim(F.regexp_replace(text, _STRING, f'"{_MARKED}$1"'), F.lit(" \t\n\r")))


def _kind(raw: Column) -> Column:
    """The first character of a marked value; a string's is a mark, or a quote where it is the whole text."""
    return F.coalesce(F.substring(raw, 1, 1), F.lit("n"))


def _bare(string: Column) -> Column:
    return F.substring(string, 2, 2**31 - 1)


def _canonical(raw: Column) -> Column:
    """Canonical JSON of a marked value."""
    plain = F.regexp_replace(raw, _STRING.replace("(", f"{_MARKED}(", 1), '"$1"')
    string = F.to_json(F.array(_bare(raw)))
    return F.when(_kind(raw) == _MARKED, F.substring(string, F.lit(2), F.length(string) - 2)).otherwise(F.coalesce(F.to_json(F.try_parse_json(plain)), F.lit("null")))


def _below(n: Column) -> Column:
    """The members or items of a value in the order of the text."""

    def node(k: Column, name: Column, raw: Column) -> Column:
        return F.struct(F.concat(n["place"], F.lpad(k.cast("string"), 10, "0")).alias("place"), F.concat(n["path"], F.lit(MARK), name).alias("path"), raw.alias("raw"))

    kind = _kind(n["raw"])
    members = F.transform(F.map_entries(F.from_json(n["raw"], "map<string,string>")), lambda e, k: node(k, _bare(e["key"]), e["value"]))
    listed = F.transform(F.from_json(n["raw"], "array<string>"), lambda v, k: node(k, F.lit(ITEM), v))
    return F.when(kind == "{", members).when(kind == "[", listed)


def definitions(text: Column) -> Column:
    """TOOLS of a JSON array of tool definitions; null where the text is none."""
    parsed = F.from_json(text, "array<struct<type:string,function:struct<name:string,parameters:string>>>")

    def one(t: Column) -> Column:
        p = t["function"]["parameters"]
        return F.struct(t["type"].alias("type"), t["function"]["name"].alias("name"), F.when(F.startswith(F.ltrim(p), F.lit("{")), specs(p)).alias("specs"))

    return F.transform(parsed, one)


def definition_problem(tools: Column) -> Column:
    """The first thing wrong with a sample's own tool definitions, tool by tool."""
    names = F.transform(tools, lambda t: t["name"])

    def one(t: Column, k: Column) -> Column:
        shaped = F.coalesce(t["type"] == "function", F.lit(False)) & t["specs"].isNotNull()
        new = F.coalesce((t["name"] != "") & (F.array_position(names, t["name"]) == k + 1), F.lit(False))
        return F.when(~shaped, "invalid_tool_definitions").when(~new, "duplicate_or_missing_tool_name")

    return F.when(tools.isNull() | (F.size(tools) == 0), "missing_home_tool_snapshot").otherwise(F.get(F.array_compact(F.transform(tools, one)), F.lit(0)))


def _fault(n: Column, s: Column) -> Column:
    """What a value breaks first of its spec: before its members are looked at, or else after; null if nothing."""
    raw, kind, type_, late = n["raw"], _kind(n["raw"]), s["type"], "arguments_invalid_enum"
    of_type = (
        F.when(type_ == "object", kind == "{").when(type_ == "string", (kind == _MARKED) | (kind == '"')).when(type_ == "boolean", (kind == "t") | (kind == "f"))
        .when(type_ == "integer", F.coalesce(raw.rlike(r"^\s*-?\d+\s*$"), F.lit(False))).when(type_ == "array", kind == "["))
    members = lambda names: F.when(F.size(F.array_except(s["required"], names)) > 0, "arguments_missing_required").when(F.size(F.array_except(names, s["keys"])) > 0, "arguments_unknown_property")
    code = F.coalesce(
        F.when(~of_type, F.concat(F.lit("arguments_not_"), type_)), F.when(type_ == "object", let(F.transform(F.json_object_keys(raw), _bare), members)),
        F.when(s["enum"].isNotNull() & ~F.array_contains(s["enum"], _same(_canonical(raw))), late))
    place = lambda c: F.when(c == late, F.concat(n["place"], F.lit(_LAST))).otherwise(n["place"])
    return let(code, lambda c: F.when(c.isNotNull(), F.struct(place(c).alias("place"), c.alias("code"))))


def argument_problem(arguments: Column, schema: Column) -> Column:
    """The first rule of a schema (specs) that a JSON text breaks, in the order in which the text is read; null for a sound one."""
    opened = F.length(arguments) - F.length(F.translate(arguments, "{[", ""))  # bounds the depth, with one more for a value in the last one
    none = F.array().cast(f"array<{_NODE}>")
    start = F.struct(F.lit(None).cast(_FAULT).alias("first"), F.array(F.struct(F.lit("").alias("place"), F.lit("").alias("path"), _marked(arguments).alias("raw"))).cast(f"array<{_NODE}>").alias("edge"))

    def step(found: Column, _: Column) -> Column:
        faults = F.flatten(F.transform(found["edge"], lambda n: F.coalesce(F.transform(schema[n["path"]], lambda s: _fault(n, s)), F.array().cast(f"array<{_FAULT}>"))))
        below = F.flatten(F.transform(found["edge"], lambda n: F.coalesce(F.when(schema[n["path"]].isNotNull(), _below(n)), none)))
        return F.when(F.size(found["edge"]) <= 0, found).otherwise(F.struct(F.array_min(F.concat(F.array(found["first"]), faults)).alias("first"), below.alias("edge")).cast(f"struct<first:{_FAULT},edge:array<{_NODE}>>"))

    return F.aggregate(F.sequence(F.lit(0), F.coalesce(opened, F.lit(0))), start, step, lambda found: found["first"]["code"])


def issue(name: Column, arguments: Column, tools: Column, unknown: str = "unknown_tool") -> Column:
    """The first rule of its tool that a call breaks; null for a sound call. arguments: JSON text."""
    tool = F.get(F.filter(tools, lambda t: t["name"] == name), F.lit(0))
    return let(tool, lambda t: F.when(t.isNull(), unknown).otherwise(argument_problem(arguments, t["specs"])))
