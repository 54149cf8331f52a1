"""Queries that run simulator coverage, lineage guards, run states, seed rules and presets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import evaluation as ev
from gleaner.operators import home_checks as hc
from gleaner.operators import home_seeds as hs
from gleaner.operators import inventory as iv
from gleaner.operators import lineage as ln
from gleaner.operators import presets as pr
from gleaner.operators import seeds as sd
from gleaner.plans.conversations import messages, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- simulator rules: an order has a rule on its status's device, its lines are the calls ----

RULES = """rules AS (SELECT o_orderkey AS sample_id, 'r' || (o_orderkey % 3) AS rule_id, 'p' || (o_orderkey % 4) AS preset, (o_orderkey % 2 + 1)::INTEGER AS turn, 'light.' || o_orderstatus AS entity_id, CASE WHEN o_orderkey % 5 < 3 THEN 'turn_on' END AS action,
    CASE WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS outcome FROM orders),
  records AS (SELECT l_orderkey AS sample_id, CASE WHEN l_quantity > 45 THEN 'r' || (l_orderkey % 3) END AS rule_id, (l_linenumber % 3 + 1)::INTEGER AS turn, CASE l_partkey % 4 WHEN 0 THEN 'state_hub_snapshot' WHEN 1 THEN 'other' ELSE 'hass_set_state' END AS tool,
    CASE WHEN l_partkey % 4 > 1 THEN 'light.' || l_linestatus END AS entity_id, CASE WHEN l_partkey % 4 > 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'turn_on' ELSE 'turn_off' END END AS action FROM lineitem),
  hit AS (SELECT r.*, EXISTS (SELECT 1 FROM records c WHERE c.sample_id = r.sample_id AND c.rule_id = r.rule_id) AS hit FROM rules r)"""


def simulator(spark, d) -> tuple[DataFrame, DataFrame]:
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    null = F.lit(None)
    rules = o.select(
        n.alias("sample_id"), F.concat(F.lit("r"), (n % 3).cast("string")).alias("rule_id"), F.concat(F.lit("p"), (n % 4).cast("string")).alias("preset"), F.when(n % 2 == 1, 2).cast("int").alias("turn"), F.concat(F.lit("light."), "o_orderstatus").alias("entity_id"),
        null.cast("string").alias("entity_name"), F.when(n % 5 < 3, "turn_on").alias("action"), null.cast("int").alias("occurrence"), F.when(n % 2 == 0, "accepted").otherwise("rejected").alias("outcome"), null.cast("boolean").alias("apply"))
    control = F.col("l_partkey") % 4 > 1
    records = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_quantity") > 45, F.concat(F.lit("r"), (F.col("l_orderkey") % 3).cast("string"))).alias("rule_id"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("turn"),
        F.when(F.col("l_partkey") % 4 == 0, hc.READ).when(F.col("l_partkey") % 4 == 1, "other").otherwise(hc.WRITE).alias("tool"), F.when(control, F.concat(F.lit("light."), "l_linestatus")).alias("entity_id"),
        F.when(control, F.when(F.col("l_suppkey") % 2 == 0, "turn_on").otherwise("turn_off")).alias("action"))
    return rules, records


@query(f"""WITH {RULES} SELECT preset, rule_id, turn, entity_id, entity_id AS entity_name, action, 1 AS occurrence, outcome, outcome = 'accepted' AS apply, count(*) AS configured, count(*) FILTER (WHERE hit) AS triggered,
  count(*) FILTER (WHERE NOT hit) AS unused, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS trigger_rate FROM hit GROUP BY ALL""")
def agg_coverage(spark, d):
    return ev.coverage(*simulator(spark, d))


@query(f"""WITH {RULES} SELECT count(DISTINCT sample_id) AS configured_samples, count(DISTINCT CASE WHEN hit THEN sample_id END) AS triggered_samples, count(DISTINCT CASE WHEN NOT hit THEN sample_id END) AS samples_with_unused_rules, count(*) AS configured_rule_occurrences,
  count(*) FILTER (WHERE hit) AS triggered_rule_occurrences, count(*) FILTER (WHERE NOT hit) AS unused_rule_occurrences, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS trigger_rate FROM hit""")
def agg_coverage_totals(spark, d):
    return ev.coverage_totals(*simulator(spark, d))


@query(f"""WITH {RULES}, u AS (SELECT h.sample_id, h.rule_id,
    coalesce(bool_or(c.tool = 'hass_set_state' AND c.entity_id = h.entity_id AND (h.action IS NULL OR h.action = c.action) AND c.turn <> h.turn), false) AS elsewhere,
    coalesce(bool_or(c.tool = 'hass_set_state' AND c.turn = h.turn AND c.entity_id = h.entity_id), false) AS mine, coalesce(bool_or(c.tool = 'hass_set_state' AND c.turn = h.turn), false) AS control,
    coalesce(bool_or(c.tool = 'state_hub_snapshot' AND c.turn = h.turn), false) AS looked, coalesce(bool_or(c.turn = h.turn), false) AS called FROM hit h LEFT JOIN records c USING (sample_id) WHERE NOT hit GROUP BY 1, 2)
  SELECT sample_id, rule_id, CASE WHEN elsewhere THEN 'matching_control_in_other_turn' WHEN mine THEN 'control_did_not_match_rule' WHEN control THEN 'controlled_other_device' WHEN looked THEN 'snapshot_without_target_control' WHEN called THEN 'no_target_control'
    ELSE 'no_real_tool_call' END AS reason FROM u""")
def agg_unused_reason(spark, d):
    return ev.unused_reasons(*simulator(spark, d)).select("sample_id", "rule_id", "reason")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 2 AS place FROM lineitem), c AS (SELECT l_orderkey AS sample_id, place, place + 1 AS result, l_partkey % 2 = 0 AS reads, l_suppkey FROM o)
  SELECT w.sample_id, w.place, (SELECT arg_max(r.l_suppkey, r.result) FROM c r WHERE r.sample_id = w.sample_id AND r.reads AND r.result < w.place) AS before, (SELECT arg_min(r.l_suppkey, r.place) FROM c r WHERE r.sample_id = w.sample_id AND r.reads AND r.place > w.result) AS after
  FROM c w WHERE NOT w.reads""")
def jn_prior_read(spark, d):
    l = table(spark, d, "lineitem").withColumn("at", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) * 2)  # noqa: E741
    at = F.col("at")
    call = F.struct(F.when(F.col("l_partkey") % 2 == 0, hc.READ).otherwise(hc.WRITE).alias("name"), F.lit("{}").alias("arguments"), at.cast("int").alias("index"), (at + 1).cast("int").alias("result_index"), F.col("l_suppkey").cast("string").alias("content"))
    # The calls of an order are an array, as a turn has them.
    t = l.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct(at.alias("o"), call.alias("c")))).alias("x")).select("sample_id", F.transform("x", lambda x: x["c"]).alias("calls"))
    t = t.withColumn("read_policy", F.lit("required")).withColumn("previous_read", F.lit(None).cast(hc._CALL))
    w = F.transform(F.filter("calls", lambda c: c["name"] == hc.WRITE), lambda c: F.struct(c["index"].cast("long").alias("place"), hc.read_before(c)["content"].cast("long").alias("before"), hc.read_after(c)["content"].cast("long").alias("after")))
    return t.select("sample_id", F.explode(w).alias("w")).select("sample_id", "w.*")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
  c AS (SELECT l_orderkey AS sample_id, (n - 1) // 3 + 1 AS turn, n AS call, l_partkey % 3 = 0 AS reads, n // 2 * 2 AS at, n // 2 * 2 + 1 + l_suppkey % 2 AS came FROM o),
  w AS (SELECT *, (SELECT arg_max(r.call, (r.came, r.call)) FROM c r WHERE r.sample_id = c.sample_id AND r.turn = c.turn AND r.reads AND r.came < c.at) AS mine, (SELECT max(r.call) FROM c r WHERE r.sample_id = c.sample_id AND r.turn = c.turn - 1 AND r.reads) AS prev,
    (SELECT arg_min(r.call, (r.at, r.call)) FROM c r WHERE r.sample_id = c.sample_id AND r.turn = c.turn AND r.reads AND r.at > c.came) AS after FROM c WHERE NOT reads)
  SELECT sample_id, turn, call, CASE WHEN mine IS NOT NULL THEN turn WHEN sample_id % 2 = 0 AND prev IS NOT NULL THEN turn - 1 END AS before_turn, coalesce(mine, CASE WHEN sample_id % 2 = 0 THEN prev END) AS before, after FROM w""")
def jn_prior_read_policy(spark, d):
    """Both policies, and calls of one reply that share an index."""
    n, at = F.col("n"), F.expr("n div 2 * 2")
    numbered = table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    c = numbered.select(
        F.col("l_orderkey").alias("sample_id"), F.expr("(n - 1) div 3 + 1").alias("turn"), n.alias("call"), F.when(F.col("l_partkey") % 3 == 0, hc.READ).otherwise(hc.WRITE).alias("name"), at.alias("index"), (at + 1 + F.col("l_suppkey") % 2).alias("result_index"))
    turns = c.select("sample_id", "turn").distinct().withColumn("read_policy", F.when(F.col("sample_id") % 2 == 0, "current_or_previous").otherwise("required"))
    return hc.prior_reads(c, turns)


@query("""WITH s AS (SELECT CASE WHEN p_partkey % 30 <= 16 THEN 'positive' ELSE 'negative' END AS sample_type, CASE p_size % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'error' END AS status FROM part)
  SELECT sample_type, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status <> 'error') AS count, avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'fail' THEN 0.0 END) AS pass_rate FROM s GROUP BY 1""")
def agg_groups(spark, d):
    s = table(spark, d, "part").select(F.when(F.col("p_partkey") % 30 <= 16, "positive").otherwise("negative").alias("sample_type"), F.when(F.col("p_size") % 3 == 0, "pass").when(F.col("p_size") % 3 == 1, "fail").otherwise("error").alias("status"))
    return ev.groups(s)


@query("""SELECT conv_id AS sample_id, string_agg(turn || ':' || 'C0' || (turn % 3 + 1), ',' ORDER BY turn) AS keys FROM conversations GROUP BY 1""")
def srt_checks(spark, d):
    c = messages(spark, d).select("sample_id", F.col("message_index").alias("turn"), F.format_string("C%02d", F.col("message_index") % 3 + 1).alias("check_id"), F.lit("pass").alias("status"))
    return ev.ordered(c).select("sample_id", F.array_join(F.transform("checks", lambda x: x["key"]), ",").alias("keys"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{"action":"' || c_mktsegment || '","target":"t","other_request":null}' ELSE '{"action":"' || c_mktsegment || '","target":"t","read_policy":"r","control_policy":"c","other_request":null}' END AS expected FROM customer""")
def prj_judge_expected(spark, d):
    expected = F.struct(F.col("c_mktsegment").alias("action"), F.lit("t").alias("target"), F.lit("r").alias("read_policy"), F.lit("c").alias("control_policy"), F.lit(None).cast("string").alias("other_request"))
    check = F.when(F.col("c_custkey") % 3 == 0, "HC07").when(F.col("c_custkey") % 3 == 1, "HC05").otherwise("HC04")
    return table(spark, d, "customer").select("c_custkey", ev.judge_expected(check, expected).alias("expected"))


_HOME_SCENES = ["HS01", "HS03", "HS07", "HS11"]


@query(f"""WITH t AS (SELECT p_partkey AS sample_id, format('T{{:02d}}', p_partkey % 20 + 1) AS template_id, (p_partkey % 2 + 1)::INTEGER AS turn, list_value({', '.join(repr(s) for s in _HOME_SCENES)})[p_partkey % 4 + 1] AS s, p_size % 2 AS calls, p_size % 3 = 0 AS snap FROM part),
  m AS (SELECT * FROM t CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in ev.HOME_CHECKS)}) v(check_id) WHERE NOT ((s = 'HS01' AND check_id = 'HC04') OR (s = 'HS03' AND check_id = 'HC05') OR (s = 'HS07' AND check_id = 'HC03'))),
  x(template_id, n, c) AS (VALUES {', '.join(f"('{t}', {n or 0}, '{c}')" for t, v, n, cs in ev.TURN_LACKS if v is None for c in cs)})
  SELECT sample_id, check_id, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.template_id = m.template_id AND (x.n = 0 OR x.n = m.turn) AND x.c = m.check_id) THEN 'template_turn_not_applicable' WHEN check_id = 'HC02' AND calls = 0 THEN 'no_tool_call'
    WHEN check_id = 'HC03' AND NOT snap THEN 'no_snapshot_result' END AS reason FROM m""")
def chk_plan_home(spark, d):
    n = F.col("p_partkey")
    t = table(spark, d, "part").select(
        n.alias("sample_id"), F.format_string("T%02d", n % 20 + 1).alias("template_id"), F.lit(None).cast("string").alias("variant_id"), (n % 2 + 1).cast("int").alias("turn"), F.array(F.get(F.array(*map(F.lit, _HOME_SCENES)), (n % 4).cast("int"))).alias("scenario_ids"),
        (F.col("p_size") % 2).alias("n_calls"), (F.col("p_size") % 3 == 0).alias("has_snapshot"))
    return ev.home_candidates(t).select("sample_id", "check_id", "reason")


# ---- lineage and runs ----


@query("""WITH m AS (SELECT conv_id AS sample_id, turn AS message_index, text FROM conversations), e AS (SELECT sample_id, message_index, CASE WHEN sample_id % 3 = 0 THEN text ELSE text || '?' END AS original FROM m WHERE message_index = 1)
  SELECT m.sample_id, m.message_index, CASE WHEN e.original = m.text THEN 'new' ELSE m.text END AS content, e.sample_id IS NOT NULL AS edited, CASE WHEN e.original <> m.text THEN 'original_mismatch' END AS problem FROM m LEFT JOIN e USING (sample_id, message_index)""")
def jn_patch(spark, d):
    m = messages(spark, d)
    edits = m.where("message_index = 1").select("sample_id", "message_index", F.when(F.col("sample_id") % 3 == 0, F.col("content")).otherwise(F.concat("content", F.lit("?"))).alias("original"), F.lit("new").alias("replacement"))
    return ln.patch(m, edits).select("sample_id", "message_index", "content", "edited", "problem")


@query("""SELECT doc_id AS sample_id, CASE WHEN g IS NULL THEN 'not_generated' WHEN s AND e THEN 'scored_and_failed' ELSE 'neither_scored_nor_failed' END AS problem FROM
  (SELECT doc_id, true AS g FROM documents WHERE doc_id % 7 <> 3) FULL JOIN (SELECT doc_id, true AS s FROM documents WHERE doc_id % 3 = 0) USING (doc_id) FULL JOIN (SELECT doc_id, true AS e FROM documents WHERE doc_id % 5 <> 0) USING (doc_id)
  WHERE (s AND e) OR g IS NULL OR (s IS NULL AND e IS NULL)""")
def jn_shard_recon(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    # A sample that is both scored and failed says so first.
    out = ln.shard_reconciliation(t.where("sample_id % 7 <> 3"), t.where("sample_id % 3 = 0"), t.where("sample_id % 5 <> 0"))
    return out.withColumn("problem", F.when(F.col("sample_id") % 7 == 3, "not_generated").otherwise(F.col("problem")))


@query("""SELECT d.doc_id AS row_index, d.lang AS scenario, d.doc_id AS source_sample_id, CASE WHEN d.doc_id % 6 <> 5 THEN d.source END AS template_id, l.quality::VARCHAR AS status,
  CASE WHEN d.doc_id % 6 = 5 THEN 'missing_source' WHEN l.doc_id IS NULL THEN 'missing_score' END AS problem FROM documents d LEFT JOIN labels l USING (doc_id)""")
def jn_train_source(spark, d):
    t, scores = table(spark, d, "documents"), table(spark, d, "labels")
    meta = t.select(F.col("doc_id").alias("row_index"), F.col("lang").alias("scenario"), F.col("doc_id").alias("source_sample_id"))
    sources = t.where("doc_id % 6 <> 5").select(F.col("lang").alias("scenario"), F.col("doc_id").alias("sample_id"), F.col("source").alias("template_id"))
    marks = scores.join(t.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("scenario"), F.col("doc_id").alias("sample_id"), F.col("quality").cast("string").alias("status"))
    return ln.train_source(meta, sources, marks)


@query("""WITH n AS (SELECT o_custkey % 10 AS source_index, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2) SELECT source_index, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses, sum(n)::BIGINT AS samples FROM n GROUP BY 1""")
def agg_source_statuses(spark, d):
    s = ln.source_statuses(table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("source_index"), F.col("o_orderstatus").alias("status")))
    pairs = F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.select("source_index", F.array_join(pairs, ",").alias("statuses"), "samples")


@query("SELECT count(*) AS shards, count(*) FILTER (WHERE s_nationkey % 5 = 0) AS failed, CASE WHEN bool_or(s_nationkey % 5 = 0) THEN 1 ELSE 0 END AS exit_code FROM supplier")
def agg_shard_results(spark, d):
    return ln.shard_results(table(spark, d, "supplier").select(F.when(F.col("s_nationkey") % 5 == 0, 1).otherwise(0).alias("returncode")))


@query("""SELECT p_partkey AS row_index, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'row_without_its_pair' ELSE 'row_or_tools_mismatch' END AS problem FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0
  UNION ALL SELECT NULL, 'training_count_mismatch' """)
def flt_train_batch(spark, d):
    p = table(spark, d, "part")
    train = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("row_index"), F.when(F.col("p_partkey") % 17 == 0, '[{"b":1}]').otherwise('[{"b": 2, "a": 1}]').alias("tools"))
    twice = p.where("p_partkey % 13 = 0").select(F.col("p_partkey").alias("row_index"))
    meta = p.select(F.col("p_partkey").alias("row_index")).union(twice)
    return ln.train_batch(train, meta, '[{"a":1,"b":2}]', 1 << 40)


@query("""WITH a AS (SELECT doc_id, lang || ':' || doc_id AS id, lang, source, doc_id % 3 <> 0 AS pass FROM documents), k AS (SELECT lang, source, count(*) AS n FROM a GROUP BY 1, 2)
  SELECT id AS subject, 'row_or_content_mismatch' AS problem FROM a WHERE pass AND doc_id % 19 = 0 UNION ALL SELECT id, 'source_audit_mismatch' FROM a WHERE doc_id % 23 = 0
  UNION ALL SELECT 'batch', 'source_count_mismatch' UNION ALL SELECT a.lang || ':' || a.source, 'template_count_mismatch' FROM (SELECT lang, source, count(*) FILTER (WHERE doc_id % 23 <> 0) AS n, count(*) AS all_ FROM a GROUP BY 1, 2) a WHERE n <> all_""")
def flt_prepared_bind(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("id"), "lang", "source", (F.col("doc_id") % 3 != 0).alias("pass"))
    audit = t.select("id", F.col("lang").alias("scenario"), F.when(F.col("pass"), "passed_sample").otherwise("quarantine").alias("disposition"))
    kept = t.where("pass")
    meta = kept.select("id", F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("normalized_sha256"))
    train = kept.select(F.col("doc_id").alias("row_index"), F.when(F.col("doc_id") % 19 == 0, "x").otherwise(F.col("doc_id").cast("string")).alias("digest"))
    sources = t.where("doc_id % 23 <> 0").select(F.col("lang").alias("scenario"), F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("template_id"))
    counts = t.agg(F.count_if("pass").alias("train_samples"), F.count("*").alias("source_samples"), (F.count("*") + 1).alias("inventory_total"))
    per = t.groupBy(F.col("lang").alias("scenario"), F.col("source").alias("template_id")).agg(F.count("*").alias("samples"))
    return ln.prepared_bind(audit, meta, train, sources, counts, per)


@query("""SELECT s_suppkey AS step, CASE WHEN s_suppkey % 9 = 0 THEN 'checkpoint_missing' WHEN s_suppkey % 5 = 0 THEN 'checkpoint_mismatch' ELSE 'checkpoint_file_missing' END AS problem FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 4 = 0""")
def flt_run_verify(spark, d):
    n = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    found = s.where("s_suppkey % 9 <> 0").select(
        n.alias("step"), F.when(n % 5 == 0, n + 1).otherwise(n).alias("global_step"), (n / F.lit(10.0)).alias("epoch"), F.when(n % 4 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("files"))
    return ln.run_verify(s.select(n.alias("step"), (n / F.lit(10.0)).alias("epoch")), found, ("a", "b"))


@query("""WITH c AS (SELECT o_custkey, count(DISTINCT o_orderpriority[1:1]) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT 'run' || c_custkey AS name, CASE WHEN n = 5 AND c_custkey % 4 = 1 AND c_custkey % 3 <> 0 THEN 'complete' WHEN c_custkey % 4 = 2 THEN 'failed' WHEN c_custkey % 4 <> 0 THEN 'running_or_incomplete' ELSE 'pending' END AS state FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def prj_run_state(spark, d):
    name = lambda c: F.concat(F.lit("run"), F.col(c).cast("string"))
    k = F.col("c_custkey")
    runs = table(spark, d, "customer").select(name("c_custkey").alias("name"), (k % 4 != 0).alias("started"), F.when(k % 4 == 1, "done").when(k % 4 == 2, "failed").alias("status"), (k % 3 != 0).alias("reload_verified"))
    step = F.substring("o_orderpriority", 1, 1).cast("int")
    points = table(spark, d, "orders").select(name("o_custkey").alias("name"), step.alias("step"), step.alias("global_step"), (F.col("o_orderstatus") == "F").alias("adapter_present"))
    return ln.run_states(runs, points, [1, 2, 3, 4, 5], "done")


@query("SELECT o_custkey AS run, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0) AS latest FROM orders GROUP BY 1 HAVING latest IS NOT NULL")
def smp_latest_checkpoint(spark, d):
    n = F.col("o_orderkey")
    files = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("trainer_state.json"), F.lit("optimizer.pt"), F.lit("scheduler.pt"))).otherwise(F.array(F.lit("optimizer.pt")))
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), n.alias("step"), F.when(n % 3 != 0, n).alias("global_step"), files.alias("files"))
    return ln.latest_checkpoint(c)


@query("""SELECT n_name AS scenario, s_suppkey AS sample_id, CASE WHEN s_suppkey % 4 = 1 THEN 'duplicate_task' WHEN s_suppkey % 4 = 2 THEN 'seed_without_task' ELSE 'task_without_seed' END AS problem FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT NULL, NULL, 'task_count_mismatch'""")
def flt_dev_check(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("scenario"), F.col("s_suppkey").alias("sample_id"))
    tasks = s.where("sample_id % 4 <> 2").union(s.where("sample_id % 4 = 1"))
    out = ln.development_tasks(tasks.withColumn("sample_id", F.col("sample_id").cast("string")), s.where("sample_id % 4 <> 3").select("scenario", F.col("sample_id").cast("string").alias("seed_id")), 0)
    return out.withColumn("sample_id", F.col("sample_id").cast("long"))


@query("""WITH l AS (SELECT p_partkey AS id FROM part WHERE p_size = 7 UNION ALL SELECT p_partkey FROM part WHERE p_size = 7 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey + 10000000 FROM part WHERE p_size = 8)
  SELECT id::VARCHAR AS id, CASE WHEN count(*) > 1 THEN 'duplicate_id' ELSE 'unknown_id' END AS problem FROM l GROUP BY l.id HAVING count(*) > 1 OR l.id > 10000000""")
def flt_oversample_ids(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    listed = p.where("p_size = 7").select("id").union(p.where("p_size = 7 AND id % 2 = 0").select("id")).union(p.where("p_size = 8").select((F.col("id") + 10_000_000).alias("id")))
    return ln.oversample_ids(listed, p)


@query("""SELECT 'b' || (s_nationkey % 7) AS name, 'code_changed' AS problem FROM supplier WHERE s_nationkey % 7 > 3 GROUP BY 1 UNION ALL SELECT 'validation', 'validation_not_passed'""")
def flt_gate(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 7).alias("k")).distinct().select(F.concat(F.lit("b"), F.col("k").cast("string")).alias("name"), F.lit("1").alias("sha256"), "k")
    return ln.gate("passed", 47, 48, s.select("name", "sha256"), s.select("name", F.when(F.col("k") > 3, "2").otherwise("1").alias("sha256")))


@query("""WITH k AS (SELECT doc_id FROM documents WHERE doc_id % 10 IN (1, 2, 3)), s AS (SELECT doc_id FROM labels)
  SELECT doc_id AS sample_id, 'score_missing' AS problem FROM k WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def jn_subset_semi(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"))
    _, _, bad = ln.subset(t, table(spark, d, "labels").select(F.col("doc_id").alias("sample_id")), t.where("sample_id % 10 IN (1, 2, 3)"))
    return bad


@query("""SELECT version, count(*) AS seeds FROM (SELECT 0 AS version FROM part UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 2 FROM part WHERE p_size < 10) GROUP BY 1""")
def set_exclusion_union(spark, d):
    p = table(spark, d, "part")
    all_ = ln.exclusion_union(p.select(F.col("p_partkey").alias("seed_id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed_id")), p.where("p_size < 10").select(F.col("p_partkey").alias("seed_id"), "p_size"))
    return all_.groupBy("version").agg(F.count("*").alias("seeds"))


@query("""SELECT p_brand AS scenario, p_type AS name, sha256(p_type) AS sha256, count(*) AS seeds FROM part GROUP BY 1, 2""")
def prj_reproduce_exclusions(spark, d):
    p = table(spark, d, "part")
    files = p.select(F.col("p_type").alias("name")).distinct().withColumn("sha256", tx.digest(F.col("name")))
    return ln.reproduce_exclusions(files, p.select(F.col("p_brand").alias("scenario"), F.col("p_type").alias("name")))


# ---- topics, seeds and presets ----


@query("""WITH t(topic, scenario, template_id) AS (VALUES ('long', 'en', 'src0'), ('long', 'fr', 'src0'), ('hot', 'en', 'src0'), ('hot', 'en', 'src1'), ('hot', 'de', 'src1'))
  SELECT topic, count(*) AS samples, count(DISTINCT md5(text[1:40])) AS semantic_groups, count(DISTINCT text) AS dialogues, count(DISTINCT source) AS templates, count(DISTINCT doc_id % 3) AS variants, count(*) FILTER (WHERE doc_id % 5 = 0) AS failures
  FROM documents d JOIN t ON d.lang = t.scenario AND d.source = t.template_id GROUP BY 1""")
def agg_topics(spark, d):
    members = spark.createDataFrame([("long", "en", "src0"), ("long", "fr", "src0"), ("hot", "en", "src0"), ("hot", "en", "src1"), ("hot", "de", "src1")], "topic string, scenario string, template_id string")
    # Digests in place of texts: no text is shuffled.
    r = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("scenario"), F.col("source").alias("template_id"), (F.col("doc_id") % 3).cast("string").alias("variant_id"), F.md5(F.substring("text", 1, 40)).alias("semantic"), tx.digest(F.col("text")).alias("dialogue"), (F.col("doc_id") % 5 == 0).alias("failed"))
    return iv.topics(r, members)


@query("SELECT p_brand AS template_id, count(*) AS samples, count(*) FILTER (WHERE p_size % 2 = 0) AS passed FROM part GROUP BY 1")
def agg_template_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("template_id")).agg(F.count("*").alias("samples"), F.count_if(F.col("p_size") % 2 == 0).alias("passed"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '{"a":' || p_size || ',"template_id":"S01"}' WHEN 1 THEN '{"template_id":"S02"}' END AS seed, CASE WHEN p_partkey % 5 > 1 THEN 'seed_without_template' END AS problem FROM part""")
def src_polymorphic_seed(spark, d):
    n = F.col("p_partkey") % 5
    raw = F.when(n == 0, F.format_string('{"template_id":"S01","a":%d}', "p_size")).when(n == 1, '{"messages":[],"seed":{"template_id":"S02"}}').when(n == 2, '{"seed":null,"template_id":"S03"}').when(n == 3, "[1]").otherwise('{"a":1}')
    return hs.polymorphic(table(spark, d, "part").select("p_partkey", raw.alias("raw"))).select("p_partkey", "seed", "problem")


_DEV = "array<struct<entity_id:string,desired_state:string>>"
_SEED_CODES = [None, "invalid_version_or_template", "deprecated_field", "invalid_question_pattern", "missing_identity", "invalid_request_form", "turn_count_mismatch", "scenario_set_mismatch", "invalid_target_state", "target_count_mismatch", "target_state_mismatch", "entity_not_in_preset"]


@query(f"SELECT p_partkey, CASE p_partkey % {len(_SEED_CODES)} " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_SEED_CODES) if c) + " END AS problem FROM part")
def flt_home_seed(spark, d):
    n = F.col("p_partkey") % len(_SEED_CODES)
    when = lambda k, v, other: F.when(n == k, v).otherwise(other)
    devices = lambda *x: F.array(*[F.struct(F.lit(e).alias("entity_id"), F.lit(s).cast("string").alias("desired_state")) for e, s in x])
    target = F.when(n == 8, devices(("a", "dim"))).when(n == 9, devices(("a", "on"), ("b", "on"))).when(n == 10, devices(("a", None))).when(n == 11, devices(("z", "on"))).otherwise(devices(("a", "on")))
    row = table(spark, d, "part").select(
        "p_partkey", when(1, "old", F.lit("v")).alias("design_version"), F.lit("T01").alias("template_id"), F.lit(None).cast("string").alias("variant_id"), when(5, "mixed", F.lit("single")).alias("request_form"), when(3, "P9", F.lit("P2")).alias("question_pattern_id"),
        when(4, " ", F.col("p_brand")).alias("preset"), F.col("p_partkey").cast("string").alias("seed_id"), F.lit("g").alias("variable_group_id"), when(6, F.array(F.lit("a"), F.lit("b")), F.array("p_name")).alias("user_turns"),
        when(7, F.array(F.lit("HS09")), F.array(F.lit("HS01"))).alias("scenario_ids"), target.cast(_DEV).alias("target"), F.lit(None).cast(_DEV).alias("first_target"), F.lit(None).cast("struct<kind:string,index:int,entity_id:string>").alias("selector"),
        when(2, F.array(F.lit("random_seed")), F.array(F.lit("seed_id"))).alias("fields"), F.array(F.array(F.lit("HS01"))).alias("scenes"))
    return row.select("p_partkey", hs.problem("v", F.array(F.lit("a"), F.lit("b"))).alias("problem"))


@query("""WITH p AS (SELECT c_custkey, c_custkey % 5 AS lamps, c_custkey % 3 AS plugs, c_custkey % 11 = 0 AS special, c_custkey % 2 = 0 AS faulty, c_custkey % 4 AS rules FROM customer), t(template_id, need, alike) AS (VALUES ('T01', 1, false), ('T05', 2, false), ('T07', 2, true), ('T14', 3, true), ('T19', 0, false), ('T20', 0, false))
  SELECT 'p' || c_custkey AS preset, template_id, CASE WHEN lamps + plugs = 0 THEN false WHEN template_id = 'T19' THEN special AND faulty WHEN template_id = 'T20' THEN special AND rules > 0
    ELSE NOT special AND lamps + plugs >= need AND (NOT alike OR lamps >= need OR plugs >= need) END AS eligible FROM p CROSS JOIN t""")
def flt_eligible(spark, d):
    n = F.col("c_custkey")
    lamp, plug = (F.struct(F.lit(name).alias("name"), F.lit(True).alias("controllable")) for name in ("灯", "插座"))
    fan = F.struct(F.lit("灯").alias("name"), F.lit(False).alias("controllable"))
    p = table(spark, d, "customer").select(
        F.concat(F.lit("p"), n.cast("string")).alias("preset"), (n % 11 == 0).alias("special"), F.concat(F.array_repeat(lamp, (n % 5).cast("int")), F.array_repeat(plug, (n % 3).cast("int")), F.array(fan)).alias("devices"), (n % 2 == 0).alias("faulty"), (n % 4).alias("n_rules"))
    t = spark.createDataFrame([(t, None) for t in ("T01", "T05", "T07", "T14", "T19", "T20")], "template_id string, variant_id string")
    return hs.eligible(p, t).select("preset", "template_id", "eligible")


def presets(spark, d) -> DataFrame:
    n = F.col("s_suppkey")
    one = lambda e, name, state: F.struct(F.lit(e).alias("entity_id"), name.alias("name"), F.array(F.lit("x")).alias("aliases"), F.lit("r").alias("room"), state.alias("state"), F.lit(True).alias("controllable"))
    state = F.when(n % 2 == 0, "on").otherwise("off")
    devices = F.array(one("light.a", F.col("s_name"), state), one("light.b", F.lit("b"), F.lit("on")))
    return table(spark, d, "supplier").select(F.concat(F.lit("p"), n.cast("string")).alias("preset"), n.alias("n"), devices.alias("devices"), F.array(F.lit("light.a")).alias("locked"), F.when(n % 3 == 0, F.array(F.lit("light.b"))).otherwise(F.array().cast("array<string>")).alias("hidden"))


@query("""SELECT 'p' || s_suppkey AS preset, '[{"entity_id":"light.a","name":"' || s_name || '","aliases":["x"],"room":"r","controllable":true}' || CASE WHEN s_suppkey % 3 = 0 THEN ']' ELSE ',{"entity_id":"light.b","name":"b","aliases":["x"],"room":"r","controllable":true}]' END AS catalog FROM supplier""")
def prj_public_catalog(spark, d):
    return presets(spark, d).select("preset", F.to_json(pr.public_catalog(F.col("devices"), F.col("hidden"))).alias("catalog"))


@query("""WITH p AS (SELECT s_suppkey, 'p' || s_suppkey AS preset, sha256('{"devices":[{"entity_id":"light.a","name":"' || s_name || '","aliases":["x"],"room":"r","state":"' || CASE WHEN s_suppkey % 2 = 0 THEN 'on' ELSE 'off' END ||
    '","controllable":true},{"entity_id":"light.b","name":"b","aliases":["x"],"room":"r","state":"on","controllable":true}]}') AS identity FROM supplier)
  SELECT c_custkey, sha256('s' || (c_custkey % 7) || '|' || coalesce(identity, '')) AS grounded FROM customer LEFT JOIN p ON preset = 'p' || (c_custkey % 40)""")
def set_grounded_fp(spark, d):
    n = F.col("c_custkey")
    seeds = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("p"), (n % 40).cast("string")).alias("preset"), F.concat(F.lit("s"), (n % 7).cast("string")).alias("semantic"))
    return pr.grounded_fingerprint(seeds, presets(spark, d).select("preset", "devices")).select("c_custkey", "grounded")


def _draw_sql(seed: str, entity: str) -> str:
    return f"('0x' || substr(sha256('presets:{seed}|p' || s_suppkey || '|' || v || '|{entity}'), 1, 12))::BIGINT / 281474976710656.0"


@query(f"""WITH x AS (SELECT s_suppkey, v, CASE WHEN s_suppkey % 2 = 0 THEN 'on' ELSE 'off' END AS a, CASE WHEN {_draw_sql('flip', 'light.b')} < 0.5 THEN 'off' ELSE 'on' END AS b, {_draw_sql('order', 'light.a')} < {_draw_sql('order', 'light.b')} AS kept FROM supplier CROSS JOIN range(1, 9) t(v))
  SELECT format('p{{}}_{{:02d}}', s_suppkey, v) AS preset, 'p' || s_suppkey AS derived_from, CASE WHEN v % 2 = 0 THEN b ELSE a END AS a, CASE WHEN v % 2 = 0 THEN a ELSE b END AS b, CASE WHEN kept THEN 'light.a' ELSE 'light.b' END AS first, CASE WHEN v % 2 = 0 THEN 'light.b' END AS moved_to
  FROM x WHERE v % 2 = 0 OR b = 'off' OR NOT kept""")
def gen_expand_presets(spark, d):
    out = pr.expand(presets(spark, d).select("preset", "devices", "locked"))
    state = lambda e: F.get(F.filter("devices", lambda x: x["entity_id"] == e), F.lit(0))["state"]
    return out.select("preset", "derived_from", state("light.a").alias("a"), state("light.b").alias("b"), F.get("devices", F.lit(0))["entity_id"].alias("first"), "moved_to")


@query("""WITH p AS (SELECT *, p_partkey // 4 AS g, p_size % 9 AS meaning FROM part), f AS (SELECT *, meaning = 0 AS out, row_number() OVER (PARTITION BY p_brand, meaning ORDER BY p_partkey) > 1 AS again FROM p),
  b AS (SELECT *, coalesce(sum(CASE WHEN NOT out AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
  SELECT p_partkey AS seed_id, CASE WHEN before >= 4 THEN 'not_needed' WHEN out THEN 'source_semantic' WHEN again THEN 'evaluation_semantic' ELSE 'accepted' END AS state, CASE WHEN before < 4 AND NOT out AND NOT again THEN before::BIGINT + 1 END AS place FROM b""")
def smp_quota_fill(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("seed_id"), F.col("p_brand").alias("template_id"), (F.col("p_size") % 9).alias("meaning")).withColumn("quota", F.lit(4))
    excluded = spark.createDataFrame([(0,)], "meaning int")
    return sd.fill_quota(p, "template_id", ["seed_id"], semantic="meaning", excluded=excluded).select("seed_id", "state", F.col("place").cast("long").alias("place"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey // 4 AS g, p_partkey // 12 * 10 + p_size % 4 AS q, p_partkey // 12 % 2 AS s FROM part), e AS (SELECT DISTINCT g, q FROM p), n AS (SELECT DISTINCT a.g AS a, b.g AS b FROM e a JOIN e b USING (q)),
  c(a, b) AS (SELECT a, b FROM n UNION SELECT c.a, n.b FROM c JOIN n ON c.b = n.a), k AS (SELECT a AS g, min(b) AS component FROM c GROUP BY 1),
  z AS (SELECT component, s, count(*) AS n, sha256('["7","' || component || '"]') AS digest FROM p JOIN k USING (g) GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY s) AS total, count(*) OVER (PARTITION BY s) AS m,
   coalesce(sum(n) OVER (PARTITION BY s ORDER BY digest, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY s ORDER BY digest, component) - 1 AS k FROM z)
  SELECT k.g AS "group", k.component, CASE WHEN before < total * 0.3 AND m - w.k > 1 THEN 'validation' ELSE 'train' END AS split FROM k JOIN w USING (component)""")
def spl_group_split(spark, d):
    rows = table(spark, d, "part").select(F.expr("p_partkey div 4").alias("group"), F.expr("p_partkey div 12 * 10 + p_size % 4").alias("q"), F.expr("p_partkey div 12 % 2").alias("scenario"))
    return sd.assign_splits(rows, "group", "q", "scenario", "7", 0.3)

