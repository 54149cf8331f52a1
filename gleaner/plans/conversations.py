"""Queries on ``conversations`` and its neighbours, each with the SQL that must give the same rows.

A conversation is a trace: conv_id its sample, turn the message's place. Its score is the quality label of the document
with the same number, its template the number modulo 20. Checks are rules on the messages themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import aggregates as ag
from gleaner.operators import formats as fm
from gleaner.operators import traces as tr
from gleaner.operators.ordering import dense_index

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"), F.lit(0).alias("n_calls"))


M = "m AS (SELECT conv_id AS sample_id, turn AS message_index, role, text AS content FROM conversations)"
REASONS = M + """, p AS (
  SELECT *, lag(role) OVER (PARTITION BY sample_id ORDER BY message_index) AS prev FROM m
), r AS (
  SELECT *, CASE WHEN message_index = 0 THEN CASE WHEN role <> 'system' THEN 'missing_initial_system' WHEN content IS NULL THEN 'invalid_system' END
    WHEN role NOT IN ('user', 'assistant', 'tool') THEN 'invalid_message_role'
    WHEN role = 'user' AND prev NOT IN ('system', 'assistant') THEN 'invalid_user_order'
    WHEN role = 'assistant' AND prev NOT IN ('user', 'tool') THEN 'invalid_assistant_order'
    WHEN coalesce(content, '') = '' THEN 'empty_message' END AS reason FROM p
), t AS (
  SELECT sample_id, coalesce(arg_min(reason, message_index) FILTER (WHERE reason IS NOT NULL),
    CASE WHEN count(*) < 2 OR arg_max(role, message_index) <> 'assistant' THEN 'unfinished_conversation' END) AS reason FROM r GROUP BY sample_id
)"""


@query(f"WITH {REASONS} SELECT coalesce(reason, 'valid') AS reason, count(*) AS traces FROM t GROUP BY 1")
def agg_quarantine_reasons(spark, d):
    return tr.trace_reasons(messages(spark, d)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("traces"))


def body(spark, d):
    return messages(spark, d).groupBy("sample_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("message_index", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("body")
    )


def routed(spark, d):
    """Passing traces by (first user message, roles): rows of one digest are duplicates of the first."""
    m = messages(spark, d)
    key = m.where("role <> 'system'").groupBy("sample_id").agg(F.max("message_index").alias("last"), F.min_by("role", "message_index").alias("first_role"))
    rows = key.withColumn("digest", F.sha2(F.concat_ws("|", F.col("last").cast("string"), "first_role"), 256))
    score = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 0).alias("failed"))
    rows = rows.join(tr.trace_reasons(m).withColumn("reason", F.when(F.col("reason") != "missing_initial_system", F.col("reason"))), "sample_id").join(score, "sample_id", "left")
    rows = rows.withColumn("failed", F.coalesce("failed", F.lit(False)))
    return tr.disposition(rows.select(F.format_string("conversation:%06d", "sample_id").alias("id"), "digest", "reason", "failed"))


ROUTED = REASONS + """, k AS (
  SELECT sample_id, sha256(concat_ws('|', max(message_index)::VARCHAR, arg_min(role, message_index))) AS digest FROM m WHERE role <> 'system' GROUP BY sample_id
), d0 AS (
  SELECT format('conversation:{:06d}', k.sample_id) AS id, digest, nullif(reason, 'missing_initial_system') AS reason, coalesce(quality = 0, false) AS failed
  FROM k JOIN t USING (sample_id) LEFT JOIN labels l ON l.doc_id = k.sample_id
), d1 AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN failed THEN 'failed_sample' ELSE 'passed_sample' END AS route FROM d0),
d2 AS (SELECT *, min(id) FILTER (WHERE route = 'passed_sample') OVER (PARTITION BY digest) AS f FROM d1),
d AS (SELECT id, digest, reason, failed, CASE WHEN route = 'passed_sample' AND id <> f THEN 'duplicate' ELSE route END AS disposition,
             CASE WHEN route = 'passed_sample' AND id <> f THEN f END AS duplicate_of FROM d2)"""


@query(f"WITH {ROUTED} SELECT * FROM d")
def flt_disposition(spark, d):
    return routed(spark, d)


@query(f"WITH {ROUTED} SELECT disposition, count(*) AS traces FROM d GROUP BY 1")
def agg_disposition_counts(spark, d):
    return routed(spark, d).groupBy("disposition").agg(F.count("*").alias("traces"))


@query(f"WITH {ROUTED} SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_index FROM d WHERE disposition = 'passed_sample'")
def win_row_index(spark, d):
    return dense_index(routed(spark, d).where("disposition = 'passed_sample'").select("id"), "id")


@query(f"""WITH {M} SELECT sample_id, message_index, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
  OVER (PARTITION BY sample_id ORDER BY message_index)::BIGINT AS turn FROM m""")
def win_turn_id(spark, d):
    return tr.turns_of(messages(spark, d)).select("sample_id", "message_index", "role", "turn")


TURNS = M + """, u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY message_index)::BIGINT AS turn FROM m)"""


@query(f"""WITH {TURNS} SELECT sample_id, turn, min(message_index) AS start, max(message_index) AS "end", count(*) FILTER (WHERE role = 'assistant') AS replies,
  sum(length(content))::BIGINT AS characters FROM u WHERE turn > 0 GROUP BY 1, 2""")
def win_turn_span(spark, d):
    t = tr.turns_of(messages(spark, d)).where("turn > 0")
    return t.groupBy("sample_id", "turn").agg(
        F.min("message_index").alias("start"), F.max("message_index").alias("end"), F.count_if(F.col("role") == "assistant").alias("replies"), F.sum(F.length("content")).alias("characters"))


@query(f"""WITH {M} SELECT sample_id, message_index, lag(role) OVER (PARTITION BY sample_id ORDER BY message_index) AS previous FROM m""")
def win_role_order(spark, d):
    return tr.message_reasons(messages(spark, d)).select("sample_id", "message_index", "previous")


@query(f"""WITH {M}, v AS (SELECT *, CASE WHEN role = 'assistant' THEN sha256(content) END AS report FROM m)
  SELECT sample_id, message_index, last_value(report) OVER w AS as_of, last_value(report IGNORE NULLS) OVER w AS latest
  FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def jn_turn_asof(spark, d):
    m = messages(spark, d).withColumn("report", F.when(F.col("role") == "assistant", tx.digest(F.col("content"))))
    m = tr.as_of(tr.as_of(m, "report", "as_of"), "report", "latest", True)
    return m.select("sample_id", "message_index", "as_of", "latest")


@query(f"""WITH {M} SELECT a.sample_id, a.message_index, min(b.message_index) AS next_reply FROM m a LEFT JOIN m b
  ON a.sample_id = b.sample_id AND b.message_index > a.message_index AND b.role = 'assistant' GROUP BY 1, 2""")
def jn_after_read(spark, d):
    m = messages(spark, d)
    out = tr.next_after(m, F.when(F.col("role") == "assistant", F.col("message_index")), "next_reply")
    return out.select("sample_id", "message_index", "next_reply")


@query(f"""WITH {M}, q AS (SELECT sample_id, min(message_index) FILTER (WHERE role = 'user') AS basis, max(message_index) FILTER (WHERE role = 'assistant') AS claim FROM m GROUP BY 1)
  SELECT sample_id, coalesce(basis < claim, false) AS grounded FROM q""")
def jn_claim_basis(spark, d):
    m = messages(spark, d)
    basis, claim = F.min(F.when(F.col("role") == "user", F.col("message_index"))), F.max(F.when(F.col("role") == "assistant", F.col("message_index")))
    return m.groupBy("sample_id").agg(F.coalesce(basis < claim, F.lit(False)).alias("grounded"))


def per_trace(spark, d):
    return messages(spark, d).groupBy("sample_id").agg(
        F.count("*").alias("messages"), F.sum(F.length("content")).alias("characters"), F.count_if(F.col("role") == "user").alias("turns"))


PER = M + ", s AS (SELECT sample_id, count(*) AS messages, sum(length(content))::BIGINT AS characters, count(*) FILTER (WHERE role = 'user') AS turns FROM m GROUP BY 1)"
DIST = "count({0}) AS count, min({0}) AS min, median({0}) AS median, quantile_disc({0}, 0.9)::DOUBLE AS p90, max({0}) AS max"


@query(f"WITH {PER} SELECT {DIST.format('messages')} FROM s")
def agg_messages_distribution(spark, d):
    return per_trace(spark, d).agg(*ag.distribution("messages"))


@query(f"WITH {PER} SELECT {DIST.format('characters')} FROM s")
def agg_characters_distribution(spark, d):
    return per_trace(spark, d).agg(*ag.distribution("characters"))


@query("SELECT count(n_chars) AS count, min(n_chars) AS min, median(n_chars) AS median, quantile_disc(n_chars, 0.9)::DOUBLE AS p90, quantile_disc(n_chars, 0.95)::DOUBLE AS p95, max(n_chars) AS max FROM documents")
def agg_stats_p95(spark, d):
    return table(spark, d, "documents").agg(*ag.distribution("n_chars", True))


@query("""WITH v AS (SELECT doc_id AS sample_id, CASE WHEN source IS NULL OR source = '' THEN '未提供' ELSE source END AS label FROM documents)
  SELECT label, count(DISTINCT sample_id) AS samples FROM v GROUP BY 1""")
def agg_field_counts(spark, d):
    return ag.field_counts(table(spark, d, "documents").withColumnRenamed("doc_id", "sample_id"), "source")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(list_transform(string_split(lower(text), ' '), lambda x: x[1:1]))) AS label FROM documents)
  SELECT CASE WHEN label = '' THEN '未提供' ELSE label END AS label, count(DISTINCT doc_id) AS samples FROM w WHERE label <> '' GROUP BY 1""")
def agg_multi_label_counts(spark, d):
    t = table(spark, d, "documents")
    tags = F.array_distinct(F.transform(F.split(F.lower("text"), " ", -1), lambda x: F.substring(x, 1, 1)))
    return ag.field_counts(t.select(F.col("doc_id").alias("sample_id"), tags.alias("tags")), "tags").where(F.col("label") != tx.MISSING)


def checks(spark, d):
    """Three checks per turn: the turn is answered (C01), the answer is long enough (C02), it ends as a sentence does (C03)."""
    t = tr.turns_of(messages(spark, d)).where("turn > 0")
    last = F.max_by("content", F.when(F.col("role") == "assistant", F.col("message_index")))
    per = t.groupBy("sample_id", "turn").agg(F.count_if(F.col("role") == "assistant").alias("n"), last.alias("reply"))
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    c = [
        ("C01", F.array(F.lit("S1")), verdict(F.col("n") > 0)), ("C02", F.array(F.lit("S1"), F.lit("S2")), verdict(F.coalesce(F.length("reply") > 80, F.lit(False)))),
        ("C03", F.array(F.lit("S3")), verdict(F.coalesce(F.regexp_like("reply", F.lit(r"[.!?]$")), F.lit(False)))),
    ]
    return per.select("sample_id", "turn", F.explode(F.array(*[F.struct(F.lit(i).alias("check_id"), s.alias("scenario_ids"), v.alias("status")) for i, s, v in c])).alias("c")).select("sample_id", "turn", "c.*")


CHECKS = TURNS + """, v AS (
  SELECT sample_id, turn, count(*) FILTER (WHERE role = 'assistant') AS n, arg_max(content, message_index) FILTER (WHERE role = 'assistant') AS reply FROM u WHERE turn > 0 GROUP BY 1, 2
), c AS (
  SELECT sample_id, turn, 'C01' AS check_id, ['S1'] AS scenario_ids, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status FROM v
  UNION ALL SELECT sample_id, turn, 'C02', ['S1', 'S2'], CASE WHEN length(reply) > 80 THEN 'pass' ELSE 'fail' END FROM v
  UNION ALL SELECT sample_id, turn, 'C03', ['S3'], CASE WHEN regexp_matches(reply, '[.!?]$') THEN 'pass' ELSE 'fail' END FROM v
), tu AS (SELECT sample_id, turn, CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status FROM c GROUP BY 1, 2)"""


@query(f"WITH {CHECKS} SELECT sample_id, turn, check_id, status FROM c")
def chk_rules(spark, d):
    return checks(spark, d).select("sample_id", "turn", "check_id", "status")


@query(f"WITH {CHECKS} SELECT * FROM tu")
def agg_turn_rollup(spark, d):
    return ag.turn_rollup(checks(spark, d))


@query(f"WITH {CHECKS} SELECT sample_id, CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status, count(*) AS turns FROM tu GROUP BY 1")
def agg_sample_rollup(spark, d):
    return ag.sample_rollup(checks(spark, d))


@query(f"""WITH {CHECKS}, e AS (SELECT DISTINCT sample_id, turn, check_id, status, unnest(scenario_ids) AS scenario_id FROM c),
  pl AS (SELECT DISTINCT sample_id, s AS scenario_id FROM m CROSS JOIN (VALUES ('S1'), ('S2'), ('S4')) x(s)),
  g AS (SELECT sample_id, scenario_id, CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status FROM e GROUP BY 1, 2)
  SELECT pl.sample_id, pl.scenario_id, coalesce(status, 'error') AS status, CASE WHEN status IS NULL THEN 'empty_scenario_result' END AS reason FROM pl LEFT JOIN g USING (sample_id, scenario_id)""")
def agg_scenario_rollup(spark, d):
    planned = messages(spark, d).select("sample_id").distinct().withColumn("scenario_id", F.explode(F.array(F.lit("S1"), F.lit("S2"), F.lit("S4"))))
    return ag.scenario_rollup(checks(spark, d), planned)


RATE = "count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status IN ('pass', 'fail')) AS count, avg(CASE status WHEN 'pass' THEN 1.0 WHEN 'fail' THEN 0.0 END) AS pass_rate"


@query(f"WITH {CHECKS} SELECT check_id, {RATE} FROM c GROUP BY 1")
def agg_rate(spark, d):
    return checks(spark, d).groupBy("check_id").agg(*ag.rate("status"))


@query(f"""WITH {CHECKS}, e AS (SELECT check_id, {RATE} FROM c GROUP BY 1), mem(check_id, category) AS (VALUES ('C01', 'rule'), ('C02', 'rule'), ('C03', 'style'), ('C04', 'style'), ('C05', 'judge'))
  SELECT category, count(*) AS planned, count(*) FILTER (WHERE count > 0) AS covered, avg(pass_rate) AS macro_pass_rate FROM mem LEFT JOIN e USING (check_id) GROUP BY 1""")
def agg_report(spark, d):
    members = spark.createDataFrame([("C01", "rule"), ("C02", "rule"), ("C03", "style"), ("C04", "style"), ("C05", "judge")], "check_id string, category string")
    return ag.macro_report(checks(spark, d), members, "check_id", "category")


@query(f"""WITH {CHECKS} SELECT check_id, count(*) AS results, count(*) FILTER (WHERE status = 'fail') AS failures, count(DISTINCT sample_id) FILTER (WHERE status = 'fail') AS samples,
  avg(CASE WHEN status = 'fail' THEN 1.0 ELSE 0.0 END) AS failure_rate FROM c GROUP BY 1""")
def agg_failure_summary(spark, d):
    return ag.failure_summary(checks(spark, d))


COMBO = CHECKS + ", co AS (SELECT sample_id, string_agg(DISTINCT check_id, ' + ' ORDER BY check_id) AS combination FROM c WHERE status = 'fail' GROUP BY 1)"


@query(f"WITH {COMBO} SELECT combination, count(*) AS samples FROM co GROUP BY 1")
def agg_failure_combinations(spark, d):
    return ag.failure_combinations(checks(spark, d))


@query(f"WITH {COMBO} SELECT combination, count(*) AS samples FROM co GROUP BY 1 ORDER BY samples DESC, combination LIMIT 3")
def srt_combos(spark, d):
    return ag.failure_combinations(checks(spark, d)).orderBy(F.col("samples").desc(), "combination").limit(3)


@query(f"""WITH {CHECKS}, a AS (SELECT sample_id // 4 AS task, (sample_id % 4 + 1)::INTEGER AS repeat, CASE WHEN sample_id % 7 = 0 THEN 'error' WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status FROM tu
    GROUP BY sample_id), p AS (SELECT DISTINCT conv_id // 4 AS task, r AS repeat FROM conversations CROSS JOIN (VALUES (1), (2), (3), (4)) y(r)),
  s AS (SELECT task, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status IN ('pass', 'fail')) AS completed FROM p LEFT JOIN a USING (task, repeat) GROUP BY 1)
  SELECT *, CASE WHEN completed < 4 THEN 'incomplete' WHEN passed = 4 THEN 'all_pass' WHEN passed = 0 THEN 'all_fail' ELSE 'mixed' END AS category FROM s""")
def agg_repeats(spark, d):
    s = ag.sample_rollup(checks(spark, d))
    status = F.when(F.col("sample_id") % 7 == 0, "error").otherwise(F.col("status"))
    attempts = s.select(F.expr("sample_id div 4").alias("task"), (F.col("sample_id") % 4 + 1).cast("int").alias("repeat"), status.alias("status"))
    return ag.repeats(attempts, messages(spark, d).select(F.expr("sample_id div 4").alias("task")).distinct())


@query(f"""WITH {PER} SELECT l AS "limit", count(*) FILTER (WHERE characters > l) AS over FROM s CROSS JOIN (VALUES (512::BIGINT), (1024), (2048)) x(l) GROUP BY 1""")
def agg_lengths(spark, d):
    return ag.over_limits(per_trace(spark, d), "characters", [512, 1024, 2048])


@query(f"WITH {PER} , g AS (SELECT turns, count(*) AS traces FROM s GROUP BY 1) SELECT traces, string_agg(turns::VARCHAR, ',' ORDER BY turns::VARCHAR) AS keys FROM g GROUP BY 1")
def agg_compact_distribution(spark, d):
    g = per_trace(spark, d).groupBy(F.col("turns").cast("string").alias("turns")).agg(F.count("*").alias("traces"))
    return ag.compact(g, "turns", "traces")


@query(f"""WITH {M} SELECT sample_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY message_index) AS rendered FROM m GROUP BY 1""")
def fmt_render(spark, d):
    return fm.render(messages(spark, d))


SPANS = M + """, z AS (SELECT *, length(role) + 13 AS head, length(role) + 13 + length(content) + 11 AS size FROM m),
  sp AS (SELECT sample_id, message_index, role, coalesce(sum(size) OVER (PARTITION BY sample_id ORDER BY message_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS "start", length(content) AS n FROM z)"""


@query(f"""WITH {SPANS} SELECT sample_id, message_index, role, "start"::BIGINT AS "start", ("start" + n)::BIGINT AS "end" FROM sp""")
def win_span_sweep(spark, d):
    s = fm.spans(messages(spark, d))
    return s.select("sample_id", "message_index", "role", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def tokens(spark, d):
    """Blank-separated tokens of the renderings with their character offsets."""
    r = fm.render(messages(spark, d))
    t = r.select(F.col("sample_id").alias("row_index"), F.posexplode(F.split("rendered", " ", -1)).alias("position", "token"))
    w = Window.partitionBy("row_index").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(F.length("token") + 1).over(w), F.lit(0))
    return t.select("row_index", F.col("position").cast("long").alias("position"), F.length("token").cast("long").alias("id"), left.alias("left"), (left + F.length("token")).alias("right"))


@query(f"""WITH {SPANS}, r AS (SELECT sample_id AS row_index, string_split(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY message_index), ' ') AS w FROM m GROUP BY 1),
  tk AS (SELECT row_index, unnest(w) AS tok, unnest(range(len(w))) AS position FROM r),
  t AS (SELECT row_index, position, length(tok)::BIGINT AS id, coalesce(sum(length(tok) + 1) OVER (PARTITION BY row_index ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM tk),
  a AS (SELECT sample_id AS row_index, "start" AS s, "start" + n AS e FROM sp WHERE role = 'assistant')
  SELECT t.row_index, position, id, coalesce(max(CASE WHEN l >= s AND l + id <= e THEN id END), -100)::BIGINT AS label, coalesce(bool_or(s IS NOT NULL AND NOT (l >= s AND l + id <= e)), false) AS crossing
  FROM t LEFT JOIN a ON t.row_index = a.row_index AND l < e AND l + id > s GROUP BY 1, 2, 3""")
def jn_token_overlap(spark, d):
    learned = fm.spans(messages(spark, d)).where("role = 'assistant'").select(F.col("sample_id").alias("row_index"), "start", "end")
    return fm.mask(tokens(spark, d), learned)


@query(f"""WITH {PER}, w AS (SELECT sample_id // 10 AS batch, max(messages) AS w FROM s GROUP BY 1)
  SELECT sample_id, list_resize(list_transform(range(messages), lambda i: i), w, 0) AS input_ids, list_resize(list_transform(range(messages), lambda i: i), w, -100) AS labels,
         list_resize(list_transform(range(messages), lambda i: 1::BIGINT), w, 0) AS attention_mask FROM s JOIN w ON s.sample_id // 10 = w.batch""")
def fmt_pad(spark, d):
    s = per_trace(spark, d).withColumn("batch", F.floor(F.col("sample_id") / 10)).withColumn("input_ids", F.sequence(F.lit(0).cast("long"), F.col("messages") - 1))
    return fm.pad(s.withColumn("labels", F.col("input_ids")), "batch").select("sample_id", "input_ids", "labels", "attention_mask")


@query("""SELECT doc_id, contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR contains(text, '<|endoftext|>') AS marked FROM documents""")
def flt_control_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", fm.has_control_marker(F.col("text")).alias("marked"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g'))) AS wording FROM documents""")
def set_wording_fp(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.digest(tx.collapse(F.col("text"))).alias("wording"))
