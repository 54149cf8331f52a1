"""Traces: ordered messages with tool calls. Structure rules give the first reason code that applies; nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import schemas

#: A message's tool calls, and the schema of the ``messages`` array.
CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MESSAGES = f"array<struct<role:string,content:string,tool_calls:{CALLS},tool_call_id:string>>"
#: What becomes of a sample.
DISPOSITIONS = ("passed_sample", "failed_sample", "duplicate", "quarantine")


def messages_of(traces: DataFrame) -> DataFrame:
    """One row per message with its position."""
    return traces.select("sample_id", F.posexplode("messages").alias("message_index", "m")).select("sample_id", "message_index", "m.*")


def calls_of(traces: DataFrame) -> DataFrame:
    """One row per tool call: its message, place in it, place in the trace from 1, name and arguments."""
    m = messages_of(traces).where(F.size("tool_calls") > 0)
    c = m.select("sample_id", "message_index", F.posexplode("tool_calls").alias("call_index", "c"))
    order = Window.partitionBy("sample_id").orderBy("message_index", "call_index")
    return c.select(
        "sample_id", "message_index", "call_index", F.col("c.id").alias("call_id"), F.col("c.type").alias("type"), F.col("c.function.name").alias("name"),
        F.col("c.function.arguments").alias("arguments"), F.row_number().over(order).alias("call_number"),
    )


def message_reasons(messages: DataFrame) -> DataFrame:
    """Adds ``reason`` to each message (role, content, n_calls, answers a pending call or not): what its place in the
    trace breaks. Pending calls are calls made minus answers given in the rows before."""
    w = Window.partitionBy("sample_id").orderBy("message_index")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    m = messages.withColumn("previous", F.lag("role").over(w))
    m = m.withColumn("pending", F.coalesce(F.sum(F.col("n_calls") - F.when(F.col("role") == "tool", 1).otherwise(0)).over(past), F.lit(0)))
    reason = (
        F.when(F.col("message_index") == 0, F.when(F.coalesce(F.col("role") != "system", F.lit(True)), "missing_initial_system").when(F.col("content").isNull(), "invalid_system"))
        .when(F.coalesce(~F.col("role").isin("user", "assistant", "tool"), F.lit(True)), "invalid_message_role")
        .when((F.col("pending") > 0) & (F.col("role") != "tool"), "missing_tool_response")
        .when((F.col("role") == "user") & ~F.col("previous").isin("system", "assistant"), "invalid_user_order")
        .when((F.col("role") == "assistant") & ~F.col("previous").isin("user", "tool"), "invalid_assistant_order")
        .when((F.col("n_calls") > 0) & (F.col("role") != "assistant"), "invalid_tool_calls")
        .when((F.col("n_calls") == 0) & (F.coalesce(F.col("content"), F.lit("")) == ""), "empty_message")
        .when((F.col("role") == "tool") & (F.col("pending") <= 0), "orphan_or_duplicate_tool_response")
    )
    return m.withColumn("reason", reason)


def trace_reasons(messages: DataFrame) -> DataFrame:
    """sample_id and its first reason code, null for a sound trace."""
    r = message_reasons(messages)
    last = F.max_by("role", "message_index")
    pending = F.sum(F.col("n_calls") - F.when(F.col("role") == "tool", 1).otherwise(0))
    return r.groupBy("sample_id").agg(
        F.coalesce(
            F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("message_index"))),
            F.when((pending > 0) | (F.count("*") < 2) | (last != "assistant") | (F.max_by("n_calls", "message_index") > 0), "unfinished_conversation"),
        ).alias("reason")
    )


def trace_state(messages: Column, context: Column, user_turns: Column, tools: Column, strict: Column) -> Column:
    """struct(reason, issues) of a whole trace: the first rule that is broken, in the order of the messages and, inside one, of the
    rules; null for a sound trace. strict: a call that its tools (schemas.TOOLS) can't take is a reason; otherwise it is
    one of the issues (tool, reason). One pass over the array; no shuffle."""
    none, texts = F.array().cast(CALLS), F.array().cast("array<string>")

    def checked(m: Column) -> Column:
        calls = F.coalesce(m["tool_calls"], none)
        found = F.transform(calls, lambda c: schemas.issue(c["function"]["name"], c["function"]["arguments"], tools))
        return F.struct(m.alias("m"), calls.alias("calls"), F.transform(calls, lambda c: c["id"]).alias("ids"), found.alias("found"))

    rest = F.transform(F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1))), checked)
    zero = F.struct(
        F.lit("system").alias("previous"), F.lit(False).alias("called"), texts.alias("pending"), texts.alias("ids"), F.array().cast("array<struct<tool:string,reason:string>>").alias("issues"), F.lit(None).cast("string").alias("reason"))

    def step(s: Column, x: Column) -> Column:
        m, role, has = x["m"], F.coalesce(x["m"]["role"], F.lit("")), F.size(x["calls"]) > 0

        def call_reason(c: Column, k: Column) -> Column:
            known = F.coalesce(c["id"], F.lit("")) == ""
            again = F.array_contains(s["ids"], c["id"]) | (F.array_position(x["ids"], c["id"]) != k + 1)
            return F.coalesce(
                F.when(known | F.coalesce(again, F.lit(False)), "duplicate_or_missing_tool_id"), F.when(~c["type"].eqNullSafe(F.lit("function")), "invalid_tool_type"),
                F.when(F.try_parse_json(c["function"]["arguments"]).isNull(), "invalid_arguments_json"), F.when(strict, F.get(x["found"], k)))

        reason = (
            F.when(~role.isin("user", "assistant", "tool"), "invalid_message_role")
            .when((F.size(s["pending"]) > 0) & (role != "tool"), "missing_tool_response")
            .when((role == "user") & ~s["previous"].isin("system", "assistant"), "invalid_user_order")
            .when((role == "assistant") & ~s["previous"].isin("user", "tool"), "invalid_assistant_order")
            .when(has & (role != "assistant"), "invalid_tool_calls")
            .when(has, F.get(F.array_compact(F.transform(x["calls"], call_reason)), F.lit(0)))
            .when(F.coalesce(m["content"], F.lit("")) == "", "empty_message")
            .when((role == "tool") & ~F.coalesce(F.array_contains(s["pending"], m["tool_call_id"]), F.lit(False)), "orphan_or_duplicate_tool_response")
        )
        bad = F.filter(F.transform(x["calls"], lambda c, k: F.struct(c["function"]["name"].alias("tool"), F.get(x["found"], k).alias("reason"))), lambda i: i["reason"].isNotNull())
        return F.struct(
            role.alias("previous"), has.alias("called"),
            F.when(role == "tool", F.array_remove(s["pending"], F.coalesce(m["tool_call_id"], F.lit("")))).otherwise(F.array_union(s["pending"], x["ids"])).alias("pending"),
            F.concat(s["ids"], x["ids"]).alias("ids"), F.concat(s["issues"], F.when(strict, F.array().cast("array<struct<tool:string,reason:string>>")).otherwise(bad)).alias("issues"),
            F.coalesce(s["reason"], reason).alias("reason"),
        )

    first, said = F.get(messages, F.lit(0)), F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])
    before = F.coalesce(
        F.when(~F.coalesce(context["trace_complete"], F.lit(False)), "incomplete_trace"),
        F.when(F.size(context["internal_message_indices"]) > 0, "runtime_injected_messages"),
        F.when(~F.coalesce(first["role"] == "system", F.lit(False)), "missing_initial_system"),
        F.when(first["content"].isNull(), "invalid_system"),
        F.when((context["system_prompt_sha256"] != "") & (F.sha2(first["content"], 256) != context["system_prompt_sha256"]), "system_hash_mismatch"),
    )

    def finish(s: Column) -> Column:
        over = (F.size(s["pending"]) > 0) | (s["previous"] != "assistant") | s["called"]
        return F.struct(F.coalesce(before, s["reason"], F.when(over, "unfinished_conversation"), F.when(~said.eqNullSafe(user_turns), "user_turns_mismatch")).alias("reason"), s["issues"].alias("issues"))

    empty = F.struct(F.coalesce(before, F.lit("missing_initial_system")).alias("reason"), F.array().cast("array<struct<tool:string,reason:string>>").alias("issues"))
    return F.coalesce(F.aggregate(rest, zero, step, finish), empty)


def validate(traces: DataFrame) -> DataFrame:
    """sample_id and reason of whole traces (sample_id, messages, context, seed, and tools where calls are to be checked)."""
    tools = F.col("tools") if "tools" in traces.columns else F.lit(None).cast(schemas.TOOLS)
    state = trace_state(F.col("messages"), F.col("context"), F.col("seed.user_turns"), tools, F.lit("tools" in traces.columns))
    return traces.select("sample_id", state["reason"].alias("reason"))


def canonical_calls(messages: Column) -> Column:
    """Messages with their calls' arguments as canonical JSON."""
    call = lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), F.struct(
        c["function"]["name"].alias("name"), F.coalesce(F.to_json(F.try_parse_json(c["function"]["arguments"])), c["function"]["arguments"]).alias("arguments")).alias("function"))
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.transform(m["tool_calls"], call).alias("tool_calls"), m["tool_call_id"].alias("tool_call_id")))


def normalized(messages: Column, as_written: bool = False) -> Column:
    """A trace's messages without the system message: four keys, call ids call_1.. in trace order, answers relinked to them,
    arguments as canonical JSON, or as they were written."""
    rest = F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))
    ids = F.flatten(F.transform(rest, lambda m: F.transform(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), lambda c: c["id"])))
    new = lambda i: F.when(F.array_contains(ids, i), F.concat(F.lit("call_"), F.array_position(ids, i).cast("string")))
    call = lambda c: F.struct(new(c["id"]).alias("id"), F.lit("function").alias("type"), F.struct(
        c["function"]["name"].alias("name"), (c["function"]["arguments"] if as_written else F.coalesce(F.to_json(F.try_parse_json(c["function"]["arguments"])), c["function"]["arguments"])).alias("arguments")).alias("function"))
    return F.transform(rest, lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"), F.when(F.size(m["tool_calls"]) > 0, F.transform(m["tool_calls"], call)).alias("tool_calls"), F.when(m["role"] == "tool", new(m["tool_call_id"])).alias("tool_call_id")))


def normalize(traces: DataFrame) -> DataFrame:
    """sample_id and the normalised messages."""
    return traces.select("sample_id", normalized(F.col("messages")).alias("messages"))


def argument_issues(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds ``issue`` to calls (name, arguments as JSON text): the first rule of the tool's parameters (tools: name, param,
    type, required, enum as JSON-text values) that is broken. Types are strict: a boolean is no number, 1.0 no integer."""
    spec = tools.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("param", "type", "required", "enum"))).alias("_spec"))
    c = calls.join(F.broadcast(spec), "name", "left")  # a row per tool
    c = c.withColumn("_args", F.expr("map_entries(from_json(arguments, 'map<string,variant>'))"))
    keys = F.transform("_args", lambda e: e["key"])
    known = F.transform("_spec", lambda p: p["param"])
    required = F.transform(F.filter("_spec", lambda p: p["required"]), lambda p: p["param"])
    typed = F.expr("""
        filter(transform(_args, e -> struct(e.value AS value, schema_of_variant(e.value) AS kind, filter(_spec, p -> p.param = e.key)[0] AS p)), x -> x.p IS NOT NULL)""")

    def issue(x: Column) -> Column:
        kind, want = x["kind"], x["p"]["type"]
        return F.coalesce(
            F.when((want == "string") & (kind != "STRING"), "arguments_not_string"),
            F.when((want == "boolean") & (kind != "BOOLEAN"), "arguments_not_boolean"),
            F.when((want == "integer") & (kind != "BIGINT"), "arguments_not_integer"),
            F.when((want == "array") & ~kind.startswith("ARRAY"), "arguments_not_array"),
            F.when((want == "object") & ~kind.startswith("OBJECT"), "arguments_not_object"),
            F.when((F.size(x["p"]["enum"]) > 0) & ~F.array_contains(x["p"]["enum"], F.to_json(x["value"])), "arguments_invalid_enum"),
        )

    found = F.coalesce(
        F.when(F.col("_spec").isNull(), "unknown_tool"),
        F.when(F.col("_args").isNull(), "arguments_not_object"),
        F.when(F.size(F.array_except(required, keys)) > 0, "arguments_missing_required"),
        F.when(F.size(F.array_except(keys, known)) > 0, "arguments_unknown_property"),
        F.get(F.filter(F.transform(typed, issue), lambda x: x.isNotNull()), F.lit(0)),
    )
    return c.withColumn("issue", found).drop("_args", "_spec")


def disposition(rows: DataFrame) -> DataFrame:
    """rows (id, digest, reason, failed): quarantine for a reason, failed_sample for a failed score, and of passing rows with
    equal digests the first by id is the passed_sample, the others are its duplicates. Adds disposition and duplicate_of."""
    route = F.when(F.col("reason").isNotNull(), "quarantine").when(F.col("failed"), "failed_sample").otherwise("passed_sample")
    r = rows.withColumn("_route", route)
    # The first of each digest is an aggregate and a join, so a digest that many rows share is no window of one task.
    first = r.where("_route = 'passed_sample'").groupBy("digest").agg(F.min("id").alias("_first"))
    r = r.join(first, "digest", "left")
    dup = (F.col("_route") == "passed_sample") & (F.col("id") != F.col("_first"))
    return r.select(*rows.columns, F.when(dup, "duplicate").otherwise(F.col("_route")).alias("disposition"), F.when(dup, F.col("_first")).alias("duplicate_of"))


def tool_provenance(scenario: Column, saved: Column) -> Column:
    """Where a sample's tool definitions come from: its own trace, the shared weather contract, or nowhere."""
    return F.when(saved, "saved_trace").when(scenario == "weather", "reconstructed_contract_aligned_with_latest_rules").otherwise("missing_snapshot")


def read_messages(raw: Column) -> Column:
    """MESSAGES of a JSON array of messages: four keys of each, other keys dropped, and arguments as JSON text, whether they came as a
    text or as an object."""
    call = "struct<id:string,type:string,function:struct<name:string,arguments:variant>>"
    m = F.from_json(raw, f"array<struct<role:string,content:string,tool_calls:array<{call}>,tool_call_id:string>>")

    def text(c: Column) -> Column:
        a = c["function"]["arguments"]
        said = F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string")).otherwise(F.to_json(a))
        return F.struct(c["id"].alias("id"), c["type"].alias("type"), F.struct(c["function"]["name"].alias("name"), said.alias("arguments")).alias("function"))

    return F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.transform(x["tool_calls"], text).alias("tool_calls"), x["tool_call_id"].alias("tool_call_id")))


def namespaced(scenario: Column, sample_id: Column) -> Column:
    return F.concat_ws(":", scenario, sample_id.cast("string"))


def turns_of(messages: DataFrame, internal: DataFrame | None = None) -> DataFrame:
    """Adds ``turn``: the running number of user messages (0 before the first). internal: (sample_id, message_index) of messages that
    the runtime put in; they begin no turn."""
    m, own = messages, F.col("role") == "user"
    if internal is not None:
        m = m.join(internal.select("sample_id", "message_index").distinct().withColumn("_internal", F.lit(True)), ["sample_id", "message_index"], "left")
        own = own & F.col("_internal").isNull()
    w = Window.partitionBy("sample_id").orderBy("message_index").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("turn", F.sum(F.when(own, 1).otherwise(0)).over(w)).drop("_internal")


def within_turn(messages: DataFrame, value: str, name: str) -> DataFrame:
    """The latest ``value`` that is not null at or before each row of the same turn (messages with ``turn``)."""
    w = Window.partitionBy("sample_id", "turn").orderBy("message_index").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn(name, F.last(value, True).over(w))


def as_of(messages: DataFrame, value: str, name: str, ignore_nulls: bool = False) -> DataFrame:
    """The latest ``value`` at or before each row of a trace."""
    w = Window.partitionBy("sample_id").orderBy("message_index").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn(name, F.last(value, ignore_nulls).over(w))


def next_after(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The first ``value`` that is not null strictly after each row's message_index (equal indices see past each other)."""
    w = Window.partitionBy("sample_id").orderBy("message_index").rangeBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(value, True).over(w))
