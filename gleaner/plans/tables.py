"""Queries on the other tables: tool calls made of ``events``, seeds made of ``documents`` and ``part``, set and sampling
operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import aggregates as ag
from gleaner.operators import seeds as sd
from gleaner.operators import traces as tr
from gleaner.plans.conversations import messages, per_trace, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- tool calls: an event is a call of the tool named by its type, its props are the arguments ----

#: What call number n modulo 9 does to its arguments.
SHAPES = [None, '{"k":"x"}', '{"k":true}', '{"k":1.0}', '{}', '{"k":1,"z":2}', "[1]", '{"k":null}', "no json"]


def calls(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    n = F.col("event_id") % len(SHAPES)
    args = F.element_at(F.array(*[F.col("props") if s is None else F.lit(s) for s in SHAPES]), (n + 1).cast("int"))
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("sample_id"), F.col("event_type").alias("name"), args.alias("arguments"))


CALLS = "c AS (SELECT event_id AS call_id, user_id AS sample_id, event_type AS name, CASE event_id % 9 WHEN 0 THEN props " + " ".join(
    f"WHEN {k} THEN '{s}'" for k, s in enumerate(SHAPES) if s) + " END AS arguments FROM events)"


def tools(spark, d) -> DataFrame:
    """All but one event type take an integer k; half of them only some values."""
    names = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    known = names.withColumn("r", F.row_number().over(Window.orderBy("event_type"))).where("r > 1")
    return known.select(F.col("event_type").alias("name"), F.lit("k").alias("param"), F.lit("integer").alias("type"), F.lit(True).alias("required"),
                        F.when(F.col("r") % 2 == 0, F.transform(F.sequence(F.lit(0), F.lit(60)), lambda x: x.cast("string"))).alias("enum"))


ISSUES = CALLS + """, tn AS (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)),
  j AS (SELECT c.*, r, CASE WHEN json_valid(arguments) THEN arguments END AS a FROM c LEFT JOIN tn ON c.name = tn.name AND r > 1),
  i AS (SELECT call_id, name, CASE WHEN r IS NULL THEN 'unknown_tool' WHEN a IS NULL OR json_type(a) <> 'OBJECT' THEN 'arguments_not_object'
    WHEN NOT list_contains(json_keys(a), 'k') THEN 'arguments_missing_required' WHEN len(json_keys(a)) > 1 THEN 'arguments_unknown_property'
    WHEN json_type(a, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'arguments_not_integer' WHEN r % 2 = 0 AND (a ->> '$.k')::BIGINT NOT BETWEEN 0 AND 60 THEN 'arguments_invalid_enum' END AS issue FROM j)"""


@query(f"WITH {ISSUES} SELECT call_id, name, issue FROM i")
def flt_json_schema(spark, d):
    return tr.argument_issues(calls(spark, d), tools(spark, d)).select("call_id", "name", "issue")


@query(f"WITH {ISSUES} SELECT call_id FROM i WHERE issue = 'unknown_tool'")
def flt_unknown_tool(spark, d):
    return calls(spark, d).join(F.broadcast(tools(spark, d).select("name")), "name", "left_anti").select("call_id")


@query("SELECT event_id, '{\"k\":' || (props ->> '$.k') || '}' AS canonical, sha256('{\"k\":' || (props ->> '$.k') || '}') AS digest FROM events")
def prj_canonical_json(spark, d):
    c = tx.canonical_json(F.col("props"))
    return table(spark, d, "events").select("event_id", c.alias("canonical"), tx.digest(c).alias("digest"))


@query("SELECT user_id AS sample_id, event_id AS call_id, 'call_' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new_id FROM events")
def win_call_seq(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("call_id"), F.concat(F.lit("call_"), F.row_number().over(w).cast("string")).alias("new_id"))


@query("SELECT user_id AS sample_id, event_type AS name, count(*) AS calls FROM events GROUP BY 1, 2")
def agg_tool_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("name")).agg(F.count("*").alias("calls"))


@query("""WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)),
  e AS (SELECT t.r, CASE WHEN event_id % 3 = 0 THEN 'check_filtered' ELSE 'check_selected' END AS event, events.event_type AS check_id FROM events JOIN t USING (event_type))
  SELECT check_id, count(*) AS candidates, count(*) FILTER (WHERE event = 'check_selected') AS selected, count(*) FILTER (WHERE event <> 'check_selected') AS filtered FROM e GROUP BY 1""")
def agg_selection(spark, d):
    e = table(spark, d, "events")
    return ag.selection(e.select(F.col("event_type").alias("check_id"), F.when(F.col("event_id") % 3 == 0, "check_filtered").otherwise("check_selected").alias("event")))


# ---- evidence and scores ----

@query("""WITH e AS (SELECT conv_id AS sample_id, turn AS message_index, CASE turn % 3 WHEN 0 THEN substr(text, 1, 12) WHEN 1 THEN substr(text, 1, 5) || '#' ELSE '' END AS quote, turn + CASE WHEN conv_id % 10 = 0 THEN 50 ELSE 0 END AS at FROM conversations)
  SELECT e.sample_id, e.message_index, CASE WHEN quote = '' OR m.text IS NULL THEN 'invalid_score_evidence' WHEN NOT contains(m.text, quote) THEN 'stale_score_evidence' END AS reason
  FROM e LEFT JOIN conversations m ON m.conv_id = e.sample_id AND m.turn = e.at""")
def jn_evidence_quote(spark, d):
    m = messages(spark, d)
    i = F.col("message_index")
    quote = F.when(i % 3 == 0, F.substring("content", 1, 12)).when(i % 3 == 1, F.concat(F.substring("content", 1, 5), F.lit("#"))).otherwise("")
    e = m.select("sample_id", "message_index", quote.alias("quote"), (i + F.when(F.col("sample_id") % 10 == 0, 50).otherwise(0)).alias("at"))
    said = m.select("sample_id", F.col("message_index").alias("at"), "content")
    why = F.when((F.col("quote") == "") | F.col("content").isNull(), "invalid_score_evidence").when(~F.contains("content", "quote"), "stale_score_evidence")
    return e.join(said, ["sample_id", "at"], "left").select("sample_id", "message_index", why.alias("reason"))


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missing_score' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_trace_score(spark, d):
    right = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("scored"))
    j = table(spark, d, "documents").select("doc_id").join(right, "doc_id", "left")
    return j.select("doc_id", "quality", F.when(F.col("scored").isNull(), "missing_score").alias("reason"))


# ---- seeds: a part is a seed, its brand the template, its size the group ----

def seeds(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("seed_id"), F.col("p_brand").alias("template_id"), (F.col("p_partkey") % 40).alias("variable_group_id"),
        F.concat(F.lit("P"), (F.col("p_partkey") % 3 + 1).cast("string")).alias("question_pattern_id"), F.array(F.concat(F.lit("  part   "), F.col("p_name")), F.col("p_type")).alias("user_turns"),
        F.col("p_size").alias("target_size"), F.col("p_type").alias("target_type"),
    )


SEEDS = "s AS (SELECT *, sha256('{\"target_size\":' || p_size || ',\"target_type\":\"' || p_type || '\",\"template_id\":\"' || p_brand || '\"}') AS semantic FROM part)"


@query(f"WITH {SEEDS} SELECT p_partkey AS seed_id, semantic FROM s")
def set_semantic_fp(spark, d):
    return sd.semantic_fingerprint(seeds(spark, d)).select("seed_id", "semantic")


@query(f"""WITH {SEEDS} SELECT p_brand AS template_id, p_partkey % 40 AS variable_group_id,
  count(*) = 3 AND count(DISTINCT p_partkey % 3) = 3 AND count(DISTINCT semantic) = 1 AS complete FROM s GROUP BY 1, 2""")
def set_group_complete(spark, d):
    return sd.complete_groups(sd.semantic_fingerprint(seeds(spark, d)))


@query("""SELECT p_partkey AS seed_id, sha256('["part ' || p_name || '","' || p_type || '"]') AS wording FROM part""")
def set_wording_turns(spark, d):
    return sd.wording_fingerprint(seeds(spark, d)).select("seed_id", "wording")


@query("""WITH c AS (SELECT p_brand AS template_id, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS s, count(*) OVER () AS k FROM c),
  f AS (SELECT *, (n * (60 - k)) // s AS fl, (n * (60 - k)) % s AS le FROM t), r AS (SELECT *, row_number() OVER (ORDER BY le DESC, template_id) AS rk, (60 - k) - sum(fl) OVER () AS op FROM f)
  SELECT template_id, n, (1 + fl + CASE WHEN rk <= op THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def srt_largest_remainder(spark, d):
    counts = seeds(spark, d).groupBy("template_id").agg(F.count("*").alias("n"))
    return sd.largest_remainder(counts, "template_id", "n", 60)


@query(f"""WITH {SEEDS}, x AS (SELECT DISTINCT semantic FROM s WHERE p_partkey % 5 = 0) SELECT p_partkey AS seed_id, CASE WHEN x.semantic IS NOT NULL THEN 'source_semantic' END AS rejected FROM s LEFT JOIN x USING (semantic) WHERE p_partkey % 5 <> 0""")
def jn_candidate_excluded(spark, d):
    s = sd.semantic_fingerprint(seeds(spark, d))
    return sd.exclude(s.where("seed_id % 5 <> 0"), s.where("seed_id % 5 = 0"), "semantic", "source_semantic").select("seed_id", "rejected")


@query("SELECT p_partkey AS seed_id, format('{}-E{:03d}', p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS new_group_id FROM part")
def prj_rename_group(spark, d):
    return sd.rename_groups(seeds(spark, d), "template_id", "seed_id").select("seed_id", "new_group_id")


@query("SELECT p_partkey AS seed_id, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 4)::INTEGER AS shard FROM part")
def smp_shard(spark, d):
    return sd.shard(seeds(spark, d), "seed_id", 4, "template_id").select("seed_id", "shard")


@query("SELECT p_partkey AS seed_id, unnest(range(1, CASE WHEN p_size = 7 THEN 4 ELSE 2 END))::INTEGER AS copy FROM part")
def smp_oversample(spark, d):
    s = seeds(spark, d)
    return sd.oversample(s.select("seed_id"), "seed_id", s.where("target_size = 7").select("seed_id"), 3)


@query("""WITH r AS (SELECT p_partkey AS seed_id, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
  a AS (SELECT DISTINCT p_brand, round_even(i * (n - 1) / 9.0, 0)::BIGINT AS k FROM r CROSS JOIN range(10) t(i)) SELECT seed_id FROM r JOIN a USING (p_brand, k)""")
def smp_even_spaced(spark, d):
    return sd.even_spaced(seeds(spark, d), "seed_id", "template_id", 10).select("seed_id")


@query("""WITH r AS (SELECT p_partkey AS seed_id, p_brand AS template_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT template_id, seed_id FROM r WHERE k = n // 2""")
def smp_median_pick(spark, d):
    return sd.median_pick(seeds(spark, d), "seed_id", "template_id").select("template_id", "seed_id")


@query("SELECT lang, max(n_chars) AS n_chars, arg_min(doc_id, (-n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1")
def win_preview_longest(spark, d):
    return sd.longest(table(spark, d, "documents").select("lang", "n_chars", "doc_id"), "lang", "n_chars", "doc_id")


@query("""WITH l AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id) AS b FROM documents)
  SELECT lang, doc_id FROM l WHERE a = 1 OR b <= 4""")
def smp_smoke(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    best = sd.longest(docs, "lang", "n_chars", "doc_id").select("lang", "doc_id")
    draw = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id")
    return docs.withColumn("r", F.row_number().over(draw)).where("r <= 4").select("lang", "doc_id").union(best).distinct()


# ---- sets, joins and states ----

@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def jn_common_subset(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey")):
        n = n.join(table(spark, d, t).select(F.col(c).alias("n_nationkey")), "n_nationkey", "left_semi")
    return n


@query("""WITH s AS (SELECT doc_id AS id FROM labels), e AS (SELECT doc_id AS id FROM documents)
  SELECT 'missing' AS problem, count(*) AS rows FROM (SELECT id FROM e EXCEPT ALL SELECT id FROM s) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT id FROM s EXCEPT ALL SELECT id FROM e)""")
def set_equality(spark, d):
    e, s = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    count = lambda a, b, name: a.exceptAll(b).agg(F.lit(name).alias("problem"), F.count("*").alias("rows"))
    return count(e, s, "missing").union(count(s, e, "unexpected"))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS f FROM documents), b AS (SELECT DISTINCT f FROM a WHERE doc_id % 2 = 0) SELECT count(*) AS overlap FROM a WHERE doc_id % 2 = 1 AND f IN (SELECT f FROM b)""")
def set_overlap_report(spark, d):
    f = table(spark, d, "documents").select("doc_id", tx.digest(F.col("text")).alias("f"))
    return f.where("doc_id % 2 = 1").join(f.where("doc_id % 2 = 0").select("f"), "f", "left_semi").agg(F.count("*").alias("overlap"))


@query("""WITH f AS (SELECT doc_id, sha256(text) AS f FROM documents), m AS (SELECT f, min(doc_id) AS low FROM f GROUP BY 1) SELECT doc_id, CASE WHEN low < doc_id THEN low END AS duplicate_of FROM f JOIN m USING (f)""")
def set_exact_dedup(spark, d):
    f = table(spark, d, "documents").select("doc_id", tx.digest(F.col("text")).alias("f"))
    low = f.groupBy("f").agg(F.min("doc_id").alias("low"))
    return f.join(low, "f").select("doc_id", F.when(F.col("low") < F.col("doc_id"), F.col("low")).alias("duplicate_of"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), i AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM w), f AS (SELECT doc_id, x, min(k) AS k FROM i GROUP BY 1, 2)
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS words FROM f GROUP BY 1""")
def set_ordered_unique(spark, d):
    w = F.array_distinct(F.split("text", " ", -1))
    return table(spark, d, "documents").select("doc_id", F.array_join(w, " ").alias("words"))


@query("""SELECT r_name AS scenario, n_name AS sample_id, r::INTEGER AS repeat FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN range(1, 5) t(r)""")
def gen_run_plan(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("r_name").alias("scenario"), F.col("n_name").alias("sample_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("repeat"))


@query("SELECT s_suppkey, regexp_full_match(s_name, '[A-Za-z0-9][A-Za-z0-9_.-]*') AS valid FROM supplier")
def flt_id_regex(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.regexp_like("s_name", F.lit(r"^[A-Za-z0-9][A-Za-z0-9_.-]*\z")).alias("valid"))


@query("""SELECT c_custkey, regexp_replace(regexp_replace(c_mktsegment, '[\\s]+', '', 'g'), 'E$', '') = regexp_replace('MACHIN', 'E$', '') AS matches FROM customer""")
def fn_remove_suffix(spark, d):
    return table(spark, d, "customer").select("c_custkey", (tx.remove_suffix(F.regexp_replace("c_mktsegment", r"\s+", ""), "E") == "MACHIN").alias("matches"))


@query("""SELECT o_orderkey, (o_orderdate::DATE + (o_orderkey % 40 - 20)::INTEGER)::DATE AS day,
  CASE WHEN abs(o_orderkey % 40 - 20) <= 31 THEN (o_orderdate::DATE + (o_orderkey % 40 - 20)::INTEGER)::DATE END AS resolved FROM orders""")
def fn_resolve_date(spark, d):
    base = F.col("o_orderdate").cast("date")
    day = F.date_add(base, (F.col("o_orderkey") % 40 - 20).cast("int"))
    text = F.concat(F.lit("于"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), tx.resolve_date(text, base).alias("resolved"))


#: What is written after a report's head, by the order's number modulo their count; {a}, {b} are days, {m} a day without its year.
REPORTS = [
    "未来7天预报：\n{a}：晴，气温 9~3°\n{b}晴 3\n（如需更多",
    "未来7天预报：\n{a}晴 3\n{b}：小雨，气温 1至2度",
    "未来7天预报：\n{a}：晴，气温 -3~9.5℃\n{a}：小雨，气温 1至2度\n（如需更多",
    "未来7天预报：\n{a}：晴，气温 -3~9.5℃\n\n 15:00气温为20度\n{b}: 小雨, 气温 1至2度\n（如需更多\n{a}晴",
    "前三天：\n{a}：晴，气温 1~2",
    "未来7天预报：\n降水概率30%\n（如需",
    "未来7天预报：\n{m}：多云，气温 2～8\n{b}：阴，气温 0~0\n",
    "未来7天预报：\n某天：晴，气温 1~2\n{b}：晴，气温 5~1",
    "未来7天预报：\n湿度五十\n未来7天预报：\n{a}：晴，气温 1~2",
]


def _report(sql: bool, head: str, a: str, b: str, m: str, n: str):
    """The report's text as SQL of either engine, from the same patterns."""
    parts = " ".join(f"WHEN {k} THEN '" + t.replace("\n", "' || chr(10) || '") + "'" for k, t in enumerate(REPORTS))
    return f"({head} || chr(10) || replace(replace(replace(CASE {n} % {len(REPORTS)} {parts} END, '{{a}}', {a}), '{{b}}', {b}), '{{m}}', {m}))"


_ROW_SQL = tx.ROW.replace("'", "''")
_FIELDS_SQL = "|".join(tx.FIELD_PATTERNS.values())


@query(f"""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, {_report(True, "'您查询的位置是：' || c_name", "strftime(o_orderdate::DATE, '%Y-%m-%d')", "strftime(o_orderdate::DATE + 1, '%Y-%m-%d')",
    "(month(o_orderdate::DATE + 3)::VARCHAR || '月' || day(o_orderdate::DATE + 3)::VARCHAR || '日')", "o_orderkey")} AS x FROM orders JOIN customer ON c_custkey = o_custkey),
  b AS (SELECT *, string_split(substr(x, instr(x, '未来7天预报：') + 8), '（如需')[1] AS body FROM t),
  l AS (SELECT o_orderkey, d, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS k FROM b WHERE contains(x, '未来7天预报：')),
  p AS (SELECT o_orderkey, k, d, trim(line) AS line, regexp_extract(trim(line), '{_ROW_SQL}', 1) AS day, try_cast(regexp_extract(trim(line), '{_ROW_SQL}', 3) AS DOUBLE) AS low, try_cast(regexp_extract(trim(line), '{_ROW_SQL}', 4) AS DOUBLE) AS high FROM l WHERE trim(line) <> ''),
  r AS (SELECT *, coalesce(try_cast(regexp_extract(day, '\\d+-\\d+-\\d+') AS DATE),
      (SELECT arg_min(c, abs(c - d)) FROM (SELECT try_cast((year(d) + y)::VARCHAR || '-' || regexp_extract(day, '(\\d+)月(\\d+)日', 1) || '-' || regexp_extract(day, '(\\d+)月(\\d+)日', 2) AS DATE) AS c FROM (VALUES (-1), (0), (1)) v(y)))) AS date FROM p),
  e AS (SELECT *, CASE WHEN low IS NULL THEN CASE WHEN NOT regexp_matches(line, '{_FIELDS_SQL}') THEN 'invalid_forecast_row' END WHEN date IS NULL THEN 'invalid_forecast_date' WHEN low > high THEN 'invalid_temperature_range' END AS fault FROM r),
  g AS (SELECT o_orderkey, arg_min(fault, k) FILTER (WHERE fault IS NOT NULL) AS fault, count(date) AS days, count(DISTINCT date) AS different, arg_min(date, k) FILTER (WHERE date IS NOT NULL) AS first_day, max(high) AS high FROM e GROUP BY 1),
  z AS (SELECT t.o_orderkey, regexp_extract(x, '^您查询的位置是[：:]\\s*([^\\n]+)', 1) AS city, CASE WHEN NOT contains(x, '未来7天预报：') THEN 'missing_forecast_section' WHEN fault IS NOT NULL THEN fault WHEN coalesce(days, 0) = 0 THEN 'empty_forecast'
    WHEN different < days THEN 'duplicate_forecast_date' END AS error, first_day, days, high FROM t LEFT JOIN g USING (o_orderkey))
  SELECT o_orderkey, city, error, CASE WHEN error IS NULL THEN first_day END AS first_day, CASE WHEN error IS NULL THEN days END AS days, CASE WHEN error IS NULL THEN high END AS highest FROM z""")
def chk_parse_report(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("_d", F.col("o_orderdate").cast("date"))
    text = _report(False, "'您查询的位置是：' || c_name", "cast(_d AS string)", "cast(date_add(_d, 1) AS string)", "(cast(month(date_add(_d, 3)) AS string) || '月' || cast(day(date_add(_d, 3)) AS string) || '日')", "o_orderkey")
    r = o.select("o_orderkey", "_d", F.expr(text).alias("x")).select("o_orderkey", tx.parse_report(F.col("x"), F.col("_d")).alias("r"))
    days = F.col("r.forecast")
    return r.select("o_orderkey", "r.city", "r.error", F.get(days, F.lit(0))["date"].alias("first_day"), F.when(days.isNotNull(), F.size(days).cast("long")).alias("days"), F.array_max(F.transform(days, lambda x: x["high"])).alias("highest"))
