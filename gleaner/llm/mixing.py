"""Mixing sources to target weights by weighted fair queueing.

Each source is shuffled by the MD5 digest of (seed, doc_id). A document's virtual finish time in a pass is its source's
cumulative size, itself included, divided by the source's target; a second pass over the source adds the source's whole
size. All copies are sorted globally by virtual finish time and cut where the running total passes the budget. Since
the targets add up to the budget, every source is cut near time 1.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
ordered last; rows that agree in doc_id, source and text are numbered and queued one by one; an empty table gives an empty
result; other columns are carried by ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD_SQL, Scratch, documents, running_totals, tune

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, "mix"


def _targets(sizes: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """A row per source: its size and target. Water filling: sources in the order of the level at which their cap
    binds; the first that stays below its cap fixes the level of all that follow. One row per source throughout."""
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    t = t.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("_w", w).withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.partitionBy()
    t = t.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("_caps", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_budget") - F.coalesce("_caps", F.lit(0.0))) / F.col("_rest"))
    free = F.min(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level").alias("level")))).over(everything)
    t = t.withColumn("_level", free["level"])
    target = F.when(F.col("_level").isNull() | (F.col("_cap") <= F.col("_level") * F.col("_w")), F.col("_cap")).otherwise(F.col("_level") * F.col("_w"))
    starts = F.sum("source_size").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1))
    return t.select("source", "source_size", "_rank", target.alias("target"), F.coalesce(starts, F.lit(0)).alias("_start"), "_budget")


def fair_queue(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """A row per document, equal ones numbered (_nth, from 0, of _rows): size, source_size, target and copies taken (0 to
    repeats). Only these narrow columns are shuffled, never the texts."""
    spark, scratch = tune(docs.sparkSession), Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("_hash"), F.regexp_count(text, F.lit(WORD_SQL)).cast("long").alias("size")
    )
    sizes = scratch.settle(sizes.groupBy("doc_id", "source", "_hash", "size").agg(F.count("*").alias("_rows")))
    targets = scratch.settle(_targets(sizes.select("source", (F.col("size") * F.col("_rows")).alias("size")), weights, share, repeats))
    sizes = sizes.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
    keyed = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(sizes["*"], "source_size", "target", "_rank", "_start", "_budget")
    keyed = keyed.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queued = scratch.settle(running_totals(scratch, keyed, ["_rank", "_key", "doc_id", "_hash", "_nth"], ["size"]))
    ends = F.col("size_before") - F.col("_start") + F.col("size")
    copies = queued.where("size > 0").select(
        "size", "_rank", "_key", "doc_id", "_hash", "_nth", "_budget",
        F.explode(F.array(*[((ends + F.col("source_size") * k) / F.col("target")) for k in range(repeats)])).alias("finish"),
    )
    cut = running_totals(scratch, copies, ["finish", "_rank", "_key", "doc_id", "_hash", "_nth"], ["size"])
    over = cut.where(F.col("size_before") + F.col("size") > F.col("_budget")).agg(F.min("finish").alias("over")).first()["over"]  # one number
    inside = lambda k: F.lit(True) if over is None else (ends + F.col("source_size") * k) / F.col("target") < F.lit(over)
    taken = sum((F.when(inside(k), 1).otherwise(0) for k in range(repeats)), F.lit(0))
    return queued.select(
        "doc_id", "source", "_hash", "_rows", "_nth", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).alias("copies")
    )


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixture itself: docs' rows and columns, each as often as the queue takes it."""
    scratch = Scratch(docs.sparkSession)
    q = scratch.settle(fair_queue(docs, **params).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_hash", "_rows", "_nth", "copies"))
    # A row is carried as one struct, so none of its columns meets a name of the queue's.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_i"), docs["source"].alias("_s"), F.xxhash64(docs["text"]).alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_h") == F.col("_hash"))
    taken = rows.join(q.where("_rows = 1 AND copies > 0"), same)
    equal = q.where("_rows > 1")
    if equal.head(1):  # equal rows are numbered over their order, and the n-th takes the copies of the n-th in the queue
        groups = scratch.settle(equal.select("_id", "_source", "_hash", "_rows").distinct())
        found = rows.join(groups, same, "left_semi").withColumn("_one", F.lit(1).cast("long")).withColumn("_tie", F.monotonically_increasing_id())
        placed = scratch.settle(running_totals(scratch, found, ["_i", "_s", "_h", "_tie"], ["_one"]))
        first = placed.groupBy("_i", "_s", "_h").agg(F.min("_one_before").alias("_first"))
        first = scratch.settle(first.select(F.col("_i").alias("_id"), F.col("_s").alias("_source"), F.col("_h").alias("_hash"), "_first"))
        placed = placed.join(first, same).select("_row", "_i", "_s", "_h", (F.col("_one_before") - F.col("_first")).alias("_k"))
        taken = taken.select("_row", "copies").union(placed.join(equal.where("copies > 0"), same & (F.col("_k") == F.col("_nth"))).select("_row", "copies"))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fair_queue(documents(spark, sf_dir))
    return q.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s GROUP BY source
), w AS (
  SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         (2 * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM t
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w
), g AS (SELECT arg_min(own, cap / w) AS level FROM l WHERE cap / w > own),
targets AS (
  SELECT source, source_size, budget,
         CASE WHEN level IS NULL OR cap <= level * w THEN cap ELSE level * w END AS target FROM l CROSS JOIN g
), q AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || s.doc_id::VARCHAR), s.doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS ends
  FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT doc_id, size, budget, (ends + k * source_size) / target AS finish FROM q CROSS JOIN (VALUES (0), (1)) AS p(k) WHERE size > 0
), cum AS (SELECT finish, budget, sum(size) OVER (ORDER BY finish) AS total FROM c),
cut AS (SELECT min(finish) AS over FROM cum WHERE total > budget)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE size * (
          CASE WHEN over IS NULL OR ends / target < over THEN 1 ELSE 0 END
        + CASE WHEN over IS NULL OR (ends + source_size) / target < over THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM q CROSS JOIN cut
"""
