"""Queries of scoring runs and their reports, and of rules that no other query reaches, over rows of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import home_seeds as hs
from gleaner.operators import lineage as ln
from gleaner.operators import presets as pr
from gleaner.operators import report_lines as rl
from gleaner.operators import scoring_run as sr
from gleaner.operators import traces as tr
from gleaner.plans.conversations import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scorers that fail ----


def punctuated(sample: dict) -> list[tuple]:
    """Every reply must end a sentence. A conversation that doesn't begin with the user is refused; one with a certain number breaks."""
    turns, out = sample["turns"], []
    if turns[0]["role"] == "assistant":
        raise sr.ScoringError("scoring_input", "invalid_message_order", "the first turn is a reply", False)
    for t in turns:
        if t["role"] == "assistant":
            out.append((t["turn"], "C01", "pass" if t["text"][-1:] in ".!?" else "fail", f"{len(t['text'])} characters"))
    return out if sample["number"] % 10 != 3 else out + [1 // 0]


@query("""WITH c AS (SELECT * FROM conversations WHERE role <> 'system'), p AS (SELECT conv_id, arg_min(role, turn) AS first, count(*) FILTER (role = 'assistant') AS replies FROM c GROUP BY 1),
  e AS (SELECT conv_id, CASE WHEN first = 'assistant' THEN 'invalid_message_order' WHEN conv_id % 10 = 3 THEN 'unexpected_exception' WHEN replies = 0 THEN 'empty_scenario_result' END AS error_code FROM p)
  SELECT conv_id AS sample_id, NULL::INTEGER AS turn, NULL AS status, NULL AS reason, CASE error_code WHEN 'invalid_message_order' THEN 'scoring_input' WHEN 'unexpected_exception' THEN 'scoring' ELSE 'aggregation' END AS stage, error_code,
    CASE error_code WHEN 'unexpected_exception' THEN 'ZeroDivisionError' ELSE 'ScoringError' END AS exception FROM e WHERE error_code IS NOT NULL
  UNION ALL SELECT conv_id, turn::INTEGER, CASE WHEN right(text, 1) IN ('.', '!', '?') OR text = '' THEN 'pass' ELSE 'fail' END, length(text) || ' characters', NULL, NULL, NULL FROM c JOIN e USING (conv_id) WHERE error_code IS NULL AND role = 'assistant'""")
def flt_scoring_errors(spark, d):
    """Three ways to lose a sample; the others keep all their checks."""
    c = table(spark, d, "conversations").where("role <> 'system'")
    said = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # one conversation's rows
    samples = said.select(F.col("conv_id").alias("sample_id"), F.to_json(F.struct("turns", F.col("conv_id").alias("number"))).alias("sample"))
    return sr.score(samples, punctuated).select("sample_id", "turn", "status", "reason", "stage", "error_code", "exception")


# ---- reports ----

NAMES = {f"C0{k}": n for k, n in enumerate(["calls", "arguments", "city", "dates", "facts", "scope", "tone|style"], 1)}
PLANNED = {"L": 4, "M": 3, "X": 2}
_CHECKS = """o AS (SELECT o_orderkey AS k, 'T' || (o_orderkey % 4) AS t, o_orderkey % 97 = 0 AS lost FROM orders),
  l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS turn, l_suppkey, l_partkey, l_returnflag, l_quantity::INTEGER AS q FROM lineitem JOIN o ON o.k = l_orderkey AND NOT lost),
  c AS (SELECT k, turn, 'C0' || (l_suppkey % 7 + 1) AS check_id, CASE WHEN l_partkey % 29 = 0 THEN 'fail' ELSE 'pass' END AS status, 'L0' || (l_suppkey % 3 + 1) AS s1, 'M0' || (l_partkey % 2 + 1) AS s2, 'flag ' || l_returnflag || ' | ' || q AS reason, l_returnflag AS f, q % 4 AS proofs FROM l),
  s AS (SELECT k, any_value(t) AS t, CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'pass' END AS status FROM c JOIN o USING (k) GROUP BY 1)"""


def scored_orders(spark, d) -> tuple[DataFrame, ...]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 4).cast("string")).alias("template_id"), (F.col("o_orderkey") % 97 == 0).alias("lost"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").withColumn("turn", F.row_number().over(w)).join(o.where("NOT lost"), F.col("l_orderkey") == F.col("sample_id"))
    q, text = F.col("l_quantity").cast("int"), lambda c: c.cast("string")
    proof = lambda k: F.struct(k.alias("message_index"), F.concat(F.lit("said  "), F.col("l_returnflag"), F.lit("\n"), text(k)).alias("quote"))
    evidence = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), proof), lambda e: e["message_index"] <= q % 4)
    checks = lines.select(
        "sample_id", "template_id", "turn", F.concat(F.lit("C0"), text(F.col("l_suppkey") % 7 + 1)).alias("check_id"), F.when(F.col("l_partkey") % 29 == 0, "fail").otherwise("pass").alias("status"),
        F.array(F.concat(F.lit("L0"), text(F.col("l_suppkey") % 3 + 1)), F.concat(F.lit("M0"), text(F.col("l_partkey") % 2 + 1))).alias("scenario_ids"), F.concat(F.lit("flag "), "l_returnflag", F.lit(" | "), text(q)).alias("reason"), evidence.alias("evidence"))
    status = F.when(F.bool_or(F.col("status") == "fail"), "fail").otherwise("pass").alias("status")
    samples = checks.groupBy("sample_id", "template_id").agg(status)
    scenarios = checks.select("sample_id", "status", F.explode("scenario_ids").alias("scenario_id")).groupBy("sample_id", "scenario_id").agg(status)
    e = table(spark, d, "events")
    filtered = F.col("event_id") % 5 == 0
    events = e.select(F.when(filtered, "check_filtered").otherwise("check_selected").alias("event"), F.when(filtered, F.when(F.col("event_id") % 3 == 0, "no_call_mode").otherwise(F.col("event_type"))).alias("reason_code"))
    errors = o.where("lost").select("sample_id", "template_id", F.lit("judge_request").alias("stage"), F.lit("missing").alias("error_code"), F.lit("no | judge").alias("message"), F.when(F.col("sample_id") % 2 == 0, F.repeat(F.lit("d"), F.lit(90))).alias("detail"))
    return samples, checks.drop("template_id"), scenarios, events, errors


def _share(rate: str) -> str:
    return f"CASE WHEN {rate} IS NOT NULL THEN (floor({rate} * 1000 + 0.5)::BIGINT // 10) || '.' || (floor({rate} * 1000 + 0.5)::BIGINT % 10) || '%' END"


def _row(*values: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"coalesce(nullif(replace(({v})::VARCHAR, '|', '\\|'), ''), '—')" for v in values) + " || ' |'"


_SHOWN = "array_to_string(list_transform(range(1, least(proofs, 2) + 1), lambda m: 'message ' || m || ': said ' || f || ' ' || m), '<br>') || CASE WHEN proofs > 2 THEN '<br>and ' || (proofs - 2) || ' more' ELSE '' END"
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in NAMES.items())
_PLANNED = ", ".join(f"('{k}', {v})" for k, v in PLANNED.items())


@query(f"""WITH {_CHECKS}, sc AS (SELECT k, x AS id, CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'pass' END AS status FROM (SELECT k, s1 AS x, status FROM c UNION ALL SELECT k, s2, status FROM c) GROUP BY 1, 2),
  names AS (SELECT * FROM (VALUES {_NAMES}) v(check_id, name)), by_check AS (SELECT check_id, name, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'fail') AS f, count(DISTINCT CASE WHEN status = 'fail' THEN k END) AS n FROM names LEFT JOIN c USING (check_id) GROUP BY ALL),
  per AS (SELECT id, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'fail') AS f, count(*) FILTER (status = 'pass') / count(*) AS rate FROM sc GROUP BY 1),
  cat AS (SELECT v.g, v.planned, count(rate) AS covered, avg(rate) AS rate FROM (VALUES {_PLANNED}) v(g, planned) LEFT JOIN per ON per.id[1] = v.g GROUP BY ALL), total AS (SELECT count(*) AS done FROM s),
  te AS (SELECT t, count(*) AS n, count(*) FILTER (st = 'error') AS lost, count(*) FILTER (st = 'pass') AS p, count(*) FILTER (st = 'fail') AS f FROM (SELECT t, status AS st FROM s UNION ALL SELECT t, 'error' FROM o WHERE lost) GROUP BY 1),
  cs AS (SELECT k, string_agg(DISTINCT check_id, '+' ORDER BY check_id) AS x, string_agg(DISTINCT check_id, ', ' ORDER BY check_id) AS ids FROM c WHERE status = 'fail' GROUP BY 1), cb AS (SELECT x, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, x) AS r FROM cs GROUP BY 1),
  ev AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'no_call_mode' ELSE event_type END AS reason, count(*) AS n FROM events WHERE event_id % 5 = 0 GROUP BY 1)
  SELECT 2 AS section, check_id AS place, {_row("check_id || ' ' || name", 'p', 'f', _share('p / nullif(p + f, 0)'))} AS line FROM by_check
  UNION ALL SELECT 3, g, {_row('g', "covered || '/' || planned", _share('rate'))} FROM cat
  UNION ALL SELECT 4, id, {_row('id', 'p', 'f', _share('rate'))} FROM per
  UNION ALL SELECT 5, check_id, {_row('check_id', 'name', 'f', 'n', _share('n / done'))} FROM by_check, total
  UNION ALL SELECT 6, t, {_row('t', 'n', 'n - lost', 'lost', 'p', 'f', _share('p / nullif(p + f, 0)'))} FROM te
  UNION ALL SELECT 7, lpad((1000000000000000 - n)::VARCHAR, 16, '0') || '/' || x, {_row('x', 'n')} FROM cb WHERE r <= 10
  UNION ALL SELECT 7, '~', 'The first 10; ' || (max(r) - 10) || ' more.' FROM cb HAVING max(r) > 10
  UNION ALL SELECT 8, reason, {_row("'`' || reason || '`'", 'n', "CASE reason WHEN 'no_call_mode' THEN 'this turn may answer without a call' ELSE reason END")} FROM ev
  UNION ALL SELECT 9, k::VARCHAR, {_row('k', 't', "'judge_request'", "'`missing`'", "'no | judge'", "CASE WHEN k % 2 = 0 THEN repeat('d', 79) || '…' END")} FROM o WHERE lost
  UNION ALL SELECT 10, t, '### ' || t || ' (' || count(*) || ')' FROM s WHERE status = 'fail' GROUP BY t
  UNION ALL SELECT 10, t || '/' || k, '#### ' || k FROM s WHERE status = 'fail'
  UNION ALL SELECT 10, t || '/' || k, 'Failed: ' || ids FROM s JOIN cs USING (k)
  UNION ALL SELECT 10, t || '/' || k || '/' || lpad(turn::VARCHAR, 9, '0') || '/' || check_id, {_row('turn', 'check_id', "s1 || ', ' || s2", 'reason', _SHOWN)} FROM c JOIN s USING (k) WHERE c.status = 'fail'""")
def snk_markdown(spark, d):
    """The lines of a scoring report that carry facts, each with its section and place; headings and the core figures are tested apart."""
    lines = rl.scoring(*scored_orders(spark, d), NAMES, PLANNED)
    own = lines.where("size(place) > 0 AND line <> '' AND line NOT LIKE '|---%' AND line NOT LIKE '| turn |%'")
    return own.select("section", F.array_join("place", "/").alias("place"), "line")


# ---- rules that other queries don't reach ----


@query("""SELECT p_partkey, '{"id":"' || CASE p_brand WHEN 'Brand#11' THEN 'Brand#12' WHEN 'Brand#12' THEN 'Brand#11' ELSE p_brand END || '","' || CASE p_brand WHEN 'Brand#11' THEN 'Brand#12' WHEN 'Brand#12' THEN 'Brand#11' ELSE p_brand END || '":[{"of":"my ' || p_brand || '"}]}' AS config FROM part""")
def prj_remap(spark, d):
    """Two names change places in keys and values, but not inside of longer texts."""
    b = F.col("p_brand")
    text = F.concat(F.lit('{"id":"'), b, F.lit('","'), b, F.lit('":[{"of":"my '), b, F.lit('"}]}'))
    return table(spark, d, "part").select("p_partkey", pr.remap_json(text, {"Brand#11": "Brand#12", "Brand#12": "Brand#11"}).alias("config"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'saved_trace' WHEN 1 THEN 'saved_trace' WHEN 2 THEN 'reconstructed_contract_aligned_with_latest_rules' WHEN 4 THEN 'reconstructed_contract_aligned_with_latest_rules' ELSE 'missing_snapshot' END AS provenance FROM part""")
def prj_tool_provenance_all(spark, d):
    n = F.col("p_partkey") % 6
    return table(spark, d, "part").select("p_partkey", tr.tool_provenance(F.when(n % 2 == 0, "weather").otherwise("home_switch"), n < 2).alias("provenance"))


@query("""WITH b AS (SELECT DISTINCT p_brand FROM part), n AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS n FROM b)
  SELECT p_brand AS template_id, CASE n % 6 WHEN 1 THEN 'not_three_patterns' WHEN 2 THEN 'empty_pattern' WHEN 3 THEN 'equal_patterns' WHEN 4 THEN 'missing_parts' WHEN 5 THEN 'template_ids_differ' END AS problem FROM n WHERE n % 6 > 0
  UNION ALL VALUES ('never', 'template_missing'), (NULL, 'lexicon_lacks:cancel_texts')""")
def flt_weather_templates(spark, d):
    brands = table(spark, d, "part").select("p_brand").distinct()  # 25 brands
    b = brands.withColumn("n", F.row_number().over(Window.orderBy("p_brand")) - 1)
    names = [r["p_brand"] for r in brands.orderBy("p_brand").collect()]
    kind, own = F.col("n") % 6, lambda k: F.array(F.concat("p_brand", F.lit(k)))
    patterns = F.when(kind == 1, F.array(own("a"), own("b"))).when(kind == 2, F.array(own("a"), own("b"), F.array(F.lit("")))).when(kind == 3, F.array(own("a"), own("b"), own("a"))).otherwise(F.array(own("a"), own("b"), own("c")))
    rows = b.select(F.when(kind == 5, F.col("n") + 1).otherwise(F.col("n")).alias("place"), F.col("p_brand").alias("template_id"), patterns.alias("patterns"), F.lit(1).alias("n_variables"), F.lit(1).alias("n_constraints"), F.when(kind == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("T01"))).alias("scenario_ids"))
    lexicon = {k: ["x"] for k in hs.LEXICON if k != "cancel_texts"}
    return hs.template_problems(rows, [*names, "never"], lexicon)


@query("""SELECT p_partkey, p_size % 3 = 0 AND p_partkey % 2 = 0 AS resumes FROM part""")
def src_resume_fingerprint(spark, d):
    """A stored configuration is today's if it says the same, in whatever order; a changed or an unreadable one is not."""
    size = F.when(F.col("p_size") % 3 == 0, "8").otherwise("16")
    stored = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"lr": 0.5, "batch": '), size, F.lit("}"))).otherwise(F.concat(F.lit('{"lr": 0.5, "batch": '), size))
    same = F.coalesce(ln.fingerprint('{"batch":8,"lr":0.5}') == F.sha2(F.to_json(F.try_parse_json(stored)), 256), F.lit(False))
    return table(spark, d, "part").select("p_partkey", same.alias("resumes"))


ZONES = ["Asia/Shanghai", "Europe/Berlin", "UTC", "Mars/Base", "asia/shanghai", "Asia/Shanghai ", "", "GMT+8", "America/New_York"]


@query(f"""WITH z AS (SELECT c_custkey, CASE WHEN c_custkey % 11 < {len(ZONES)} THEN [{', '.join(repr(z) for z in ZONES)}][c_custkey % 11 + 1] END AS zone FROM customer)
  SELECT c_custkey, coalesce(zone IN ('Asia/Shanghai', 'Europe/Berlin', 'UTC', 'America/New_York'), false) AS known FROM z""")
def flt_timezone(spark, d):
    """Names of the IANA list in their spelling; null is none."""
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("c_custkey") % 11).cast("int"))
    return table(spark, d, "customer").select("c_custkey", tx.known_timezone(zone).alias("known"))
