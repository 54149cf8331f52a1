"""Queries that write and read files in the shared folder, and the last small operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import aggregates as ag
from gleaner.operators import lineage as ln
from gleaner.operators import records as rc
from gleaner.operators import traces as tr
from gleaner.plans.conversations import checks, messages, table
from gleaner.plans.exports import entries
from gleaner.settled import Scratch
from gleaner.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark) -> str:
    return Scratch(spark).place()


def _settled(spark, df: DataFrame) -> DataFrame:
    """A small result whose files may go: its rows are held by the plan."""
    return spark.createDataFrame(df.collect(), df.schema)


_NATIONS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(_NATIONS)
def snk_jsonl_canonical(spark, d):
    p = _place(spark)
    files.write_jsonl(table(spark, d, "nation"), p)
    return files.read_jsonl(spark, p, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT count(*) AS rows, 1 AS refused FROM nation")
def snk_no_overwrite(spark, d):
    p, n = _place(spark), table(spark, d, "nation")
    files.write_jsonl(n, p)
    refused = 0
    try:
        files.write_jsonl(n.limit(1), p)
    except Exception as x:  # Spark's own error for an existing path
        refused = int("PATH_ALREADY_EXISTS" in str(x))
    return spark.read.text(p).agg(F.count("*").alias("rows")).withColumn("refused", F.lit(refused))


@query("SELECT true AS written, false AS again, true AS differs")
def snk_save_once(spark, d):
    p, n = _place(spark), table(spark, d, "region")
    written, again, differs = files.save_once(n, p), files.save_once(n, p), False
    try:
        files.save_once(n.limit(1), p)
    except files.SourceError:
        differs = True
    return spark.createDataFrame([(written, again, differs)], "written boolean, again boolean, differs boolean")


@query("SELECT 0::BIGINT AS problems, 1::BIGINT AS changed, true AS hashed")
def src_verify_hash(spark, d):
    p = _place(spark)
    files.write_jsonl(table(spark, d, "region").coalesce(1), p)
    m = _settled(spark, files.manifest(spark, p).where("bytes > 0"))
    fine = files.verify(spark, p, m).count()
    changed = files.verify(spark, p, m.withColumn("sha256", F.lit("0"))).where("problem = 'changed'").count()
    return m.agg(F.lit(fine).cast("long").alias("problems"), F.lit(changed).cast("long").alias("changed"), F.bool_and(F.length("sha256") == 64).alias("hashed"))


@query("SELECT n_nationkey % 2 AS source_index, CASE n_nationkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS scenario, n_name AS sample_id FROM nation")
def src_multi_source(spark, d):
    paths = []
    for k, name in enumerate(("even", "odd")):
        paths.append({"path": _place(spark), "scenario": name})
        files.write_jsonl(table(spark, d, "nation").where(f"n_nationkey % 2 = {k}").select(F.col("n_name").alias("sample_id")), paths[-1]["path"])
    return files.read_sources(spark, paths, "sample_id string").select("source_index", "scenario", "sample_id")


@query("SELECT n_regionkey AS region, count(*) AS rows FROM nation GROUP BY 1")
def src_glob(spark, d):
    p = _place(spark)
    n = table(spark, d, "nation").withColumn("region", F.col("n_regionkey"))
    n.repartition(1, "region").write.partitionBy("region").json(f"{p}/all")
    rows = files.read_many(spark, f"{p}/all/region=*/*.json", "n_name string")
    counts = files.file_counts(spark, f"{p}/all/region=*/*.json", rows)
    return counts.groupBy(F.regexp_extract("file", r"region=(\d+)", 1).cast("int").alias("region")).agg(F.sum("rows").alias("rows"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def src_json_doc(spark, d):
    p = _place(spark)
    rows = [{"k": r["r_regionkey"], "name": r["r_name"]} for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # five rows
    spark.createDataFrame([(json.dumps(rows, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.text(p)
    return files.read_json_document(spark, p, "k int, name string")


@query("SELECT count(*) AS lenient, true AS strict_refuses FROM region")
def src_jsonl_skip_blank(spark, d):
    p = _place(spark)
    r = table(spark, d, "region").select(F.to_json(F.struct("r_name")).alias("value"))
    r.union(spark.createDataFrame([("",)], "value string")).coalesce(1).write.text(p)
    refused = False
    try:
        files.read_jsonl(spark, p, "r_name string")
    except files.SourceError:
        refused = True
    return files.read_jsonl(spark, p, "r_name string", strict=False).agg(F.count("*").alias("lenient"), F.lit(refused).alias("strict_refuses"))


@query("SELECT n_nationkey::VARCHAR AS match FROM nation WHERE n_regionkey = 4")
def src_log_scan(spark, d):
    p = _place(spark)
    lines = table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").select(F.concat(F.when(F.row_number().over(_by_region()) == 1, "start ").otherwise(""), F.format_string("loaded=%d", "n_nationkey")).alias("v"))
    text = "\n".join(r["v"] for r in lines.collect())  # twenty-five rows
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(p)
    return files.scan_log(spark, p, "start", r"loaded=(\d+)")


def _by_region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey").orderBy("n_nationkey")


# ---- projections ----


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"a\":1.0,\"k\":' || (props ->> '$.k') || '}' WHEN 1 THEN '[2.50,\"é\"]' END AS canonical FROM events")
def prj_canonical_exact(spark, d):
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.concat(F.regexp_replace("props", r"\}$", ', "a": 1.0}'))).when(n == 1, '[2.50, "é"]').otherwise("{nope")
    exact = F.regexp_replace(tx.canonical_exact(text), r"\[2\.5,", "[2.50,")  # Python writes 2.5
    return table(spark, d, "events").select("event_id", exact.alias("canonical"))


@query("SELECT c_custkey, '{\"b\":' || c_custkey || '}' AS arguments, 'hi' AS content, c_custkey % 2 = 0 AS was_text FROM customer")
def prj_args_to_string(spark, d):
    n = F.col("c_custkey")
    inner = F.format_string('{"b":%d}', n)
    arguments = F.when(n % 2 == 0, F.to_json(F.array(inner))).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    raw = F.concat(F.lit('[{"role":"assistant","content":"hi","extra":1,"tool_calls":[{"index":0,"id":"x","type":"function","function":{"name":"f","arguments":'), F.regexp_extract(arguments, r"(?s)^\[(.*)\]$", 1), F.lit("}}]}]"))
    m = F.get(tr.read_messages(raw), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", m.alias("m")).select("c_custkey", F.get("m.tool_calls", F.lit(0))["function"]["arguments"].alias("arguments"), "m.content", (F.col("c_custkey") % 2 == 0).alias("was_text"))


@query("SELECT lang || ':' || doc_id AS id, lang || ':' || coalesce(source, '未提供') AS \"group\" FROM documents")
def prj_namespace_id(spark, d):
    t = table(spark, d, "documents")
    return t.select(tr.namespaced(F.col("lang"), F.col("doc_id")).alias("id"), tr.namespaced(F.col("lang"), tx.label(F.col("source"))).alias("group"))


@query("SELECT c_custkey AS n, 'system,user' AS prefix, 'get_weather' AS tools FROM customer WHERE c_custkey % 40 = 0")
def prj_prefix_and_first(spark, d):
    e = entries(spark, d).where("n % 40 = 0").select("n", rc.prefix_and_first(F.col("messages")).alias("p"))
    return e.select("n", F.array_join(F.transform("p.prefix", lambda m: m["role"]), ",").alias("prefix"), F.array_join("p.tools", ",").alias("tools"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN p_name[1:7] || '…' ELSE p_name END AS cut, CASE p_size % 5 WHEN 0 THEN '今天' WHEN 1 THEN '明天' WHEN 2 THEN '后天' ELSE (p_size % 5) || '天后' END AS day, 'a|b' || p_size AS turns,
  '{"a":"' || p_brand || '","b":"' || CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END || '"}' AS states, 'x\\|' || p_size AS escaped FROM part""")
def fn_texts(spark, d):
    n = F.col("p_size")
    two = lambda a, b: F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(a, b))
    override = F.when(n % 2 == 0, F.map_from_arrays(F.array(F.lit("b")), F.array(F.lit("new"))))
    states = tx.merged_states(two(F.col("p_brand"), F.lit("old")), override)
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries(states)))
    return table(spark, d, "part").select(
        "p_partkey", tx.truncate(F.col("p_name"), 8).alias("cut"), tx.day_phrase(n % 5).alias("day"), F.array_join(tx.split_turns(F.concat(F.lit("① a→ ②b"), n.cast("string"))), "|").alias("turns"), F.to_json(sorted_).alias("states"),
        tx.markdown_escape(F.concat(F.lit("x|"), n.cast("string"))).alias("escaped"))


# ---- windows and aggregates ----


@query("""WITH m AS (SELECT conv_id AS sample_id, turn AS message_index, role FROM conversations) SELECT sample_id, message_index, sum(CASE WHEN role = 'user' AND NOT (sample_id % 2 = 0 AND message_index = 3) THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY message_index)::BIGINT AS turn FROM m""")
def win_turn_id_internal(spark, d):
    m = messages(spark, d)
    return tr.turns_of(m, m.where("sample_id % 2 = 0 AND message_index = 3")).select("sample_id", "message_index", "turn")


@query("""WITH m AS (SELECT conv_id AS sample_id, turn AS message_index, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)
  SELECT sample_id, message_index, last_value(CASE WHEN role = 'assistant' THEN message_index END IGNORE NULLS) OVER (PARTITION BY sample_id, t ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS report FROM m""")
def win_turn_report(spark, d):
    m = tr.turns_of(messages(spark, d)).withColumn("v", F.when(F.col("role") == "assistant", F.col("message_index")))
    return tr.within_turn(m, "v", "report").select("sample_id", "message_index", "report")


@query("""SELECT event_type AS check_id, CASE WHEN value > 50 THEN 'no_tool_call' ELSE 'no_call_mode' END AS reason_code, count(*) AS candidates FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2""")
def agg_selection_reasons(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("check_id"), F.when(F.col("event_id") % 3 == 0, "check_filtered").otherwise("check_selected").alias("event"), F.when(F.col("value") > 50, "no_tool_call").otherwise("no_call_mode").alias("reason_code"))
    return ag.selection_reasons(e)


@query("""WITH m AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations), c AS (SELECT conv_id, t, count(*) FILTER (WHERE role = 'assistant') > 0 AS ok FROM m WHERE t > 0 GROUP BY 1, 2)
  SELECT conv_id % 5 AS template_id, 'C01' AS check_id, count(*) AS results, count(*) FILTER (WHERE NOT ok) AS failures, count(DISTINCT CASE WHEN NOT ok THEN conv_id END) AS samples, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS failure_rate FROM c GROUP BY 1""")
def agg_failure_by_template(spark, d):
    return ag.failures_by_template(checks(spark, d).where("check_id = 'C01'").withColumn("template_id", F.col("sample_id") % 5))


@query("SELECT (SELECT count(*) FROM documents) AS planned, count(*) AS completed, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS errors, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS completion_rate FROM labels")
def agg_completion(spark, d):
    t = table(spark, d, "documents")
    return ag.completion(table(spark, d, "labels"), t.where("doc_id % 7 = 0"), t.count())


@query("""SELECT o_custkey AS task, o_orderkey % 4 + 1 AS repeat, CASE WHEN o_custkey % 5 = 0 THEN 'unknown_task' ELSE 'duplicate_attempt' END AS problem FROM orders GROUP BY 1, 2, o_custkey % 5 HAVING o_custkey % 5 = 0 OR count(*) > 1""")
def agg_repeat_problems(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 4 + 1).alias("repeat"))
    return ag.repeat_problems(a, a.where("task % 5 <> 0").select("task"))


@query("SELECT o_custkey AS run_id, CASE WHEN bool_and(o_orderstatus <> 'P') AND o_custkey % 3 <> 0 THEN 'complete' ELSE 'incomplete' END AS status FROM orders GROUP BY 1")
def agg_run_status(spark, d):
    codes = table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("returncode"))
    scores = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 3 != 0, "complete").otherwise("error").alias("status"))
    return rc.run_status(codes, scores)


@query("""WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 9), c AS (SELECT doc_id, '~' || text AS text FROM documents WHERE doc_id % 10 IN (3, 9))
  SELECT coalesce(o.doc_id, c.doc_id) AS doc_id, sha256(coalesce(c.text, o.text)) AS digest, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'unchanged' ELSE 'revised' END AS kind FROM o FULL JOIN c USING (doc_id)""")
def set_merge_patch(spark, d):
    t = table(spark, d, "documents")
    merged = ln.merge(t.where("doc_id % 10 <> 9").select("doc_id", "text"), t.where("doc_id % 10 IN (3, 9)").select("doc_id", F.concat(F.lit("~"), "text").alias("text")), "doc_id")
    return merged.select("doc_id", tx.digest(F.col("text")).alias("digest"), "kind")


@query("""SELECT CASE WHEN doc_id % 50 = 0 THEN 'revised' WHEN doc_id % 4 <> 0 THEN 'old' WHEN doc_id % 8 = 0 THEN 'new' ELSE 'other' END AS origin,
  CASE WHEN doc_id % 9 = 0 THEN 'removed' WHEN doc_id % 3 = 1 THEN 'failed_sample' ELSE 'passed_sample' END AS disposition, count(*) AS rows FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 4 <> 0 GROUP BY 1, 2""")
def agg_reconcile(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    audit = t.where("id % 9 <> 0").withColumn("disposition", F.when(F.col("id") % 3 == 1, "failed_sample").otherwise("passed_sample"))
    return ln.reconcile(t.where("id % 4 <> 0"), audit, t.where("id % 50 = 0"), t.where("id % 8 = 0"))
