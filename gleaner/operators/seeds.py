"""Evaluation seeds: fingerprints, complete groups, quotas, exclusion and sampling that repeats exactly."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import canonical_json, collapse
from gleaner.operators.ordering import dense_index
from gleaner.settled import Scratch, components, running_totals

#: Fields of a seed that say how it is worded, not what it asks.
WORDING = ("seed_id", "variable_group_id", "question_pattern_id", "user_turns")


def semantic_fingerprint(seeds: DataFrame) -> DataFrame:
    """Adds ``semantic``: the digest of a seed without its identity and wording."""
    fields = [c for c in sorted(seeds.columns) if c not in WORDING]
    return seeds.withColumn("semantic", F.sha2(canonical_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), 256))


def wording_fingerprint(seeds: DataFrame) -> DataFrame:
    """Adds ``wording``: the digest of the user turns with white space collapsed."""
    return seeds.withColumn("wording", F.sha2(F.to_json(F.transform("user_turns", collapse)), 256))


def complete_groups(seeds: DataFrame, patterns: tuple[str, ...] = ("P1", "P2", "P3")) -> DataFrame:
    """Groups with each pattern once and one meaning, and whether each group is complete."""
    want = F.array(*[F.lit(p) for p in patterns])
    return seeds.groupBy("template_id", "variable_group_id").agg(
        ((F.count("*") == len(patterns)) & (F.sort_array(F.collect_set("question_pattern_id")) == want) & (F.count_distinct("semantic") == 1)).alias("complete")
    )


def largest_remainder(counts: DataFrame, name: str, count: str, total: int) -> DataFrame:
    """Quotas of ``total`` over names: one each, the floor of the rest's share, and what is left by largest remainder,
    then name. Exact in whole numbers. One row per name."""
    everything = Window.partitionBy()
    c = counts.withColumn("_sum", F.sum(count).over(everything)).withColumn("_n", F.count("*").over(everything))
    rest = F.lit(total) - F.col("_n")
    c = c.withColumn("_floor", F.expr(f"({count} * ({total} - _n)) div _sum")).withColumn("_left", F.col(count) * rest % F.col("_sum"))
    c = c.withColumn("_open", rest - F.sum("_floor").over(everything))
    c = c.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_left").desc(), name)))
    return c.select(name, count, (1 + F.col("_floor") + F.when(F.col("_rank") <= F.col("_open"), 1).otherwise(0)).cast("long").alias("quota"))


def exclude(candidates: DataFrame, excluded: DataFrame, fingerprint: str, reason: str) -> DataFrame:
    """Adds ``rejected``: the reason where the fingerprint is among the excluded ones."""
    ex = excluded.select(fingerprint).distinct().withColumn("_hit", F.lit(reason))
    return candidates.join(ex, fingerprint, "left").withColumnRenamed("_hit", "rejected")


def apportion(counts: DataFrame, name: str, count: str, ratio: float, patterns: int = 3) -> DataFrame:
    """Quotas of groups over names for a share of all seeds: a third of the seeds that the share asks for (halves round to even),
    rounded up, and one group each at least."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio_out_of_range")
    r = counts.agg(F.sum(count).alias("n"), F.count("*").alias("k"), F.min(count).alias("low")).first()  # one row
    if not r["k"] or r["low"] is None or r["low"] <= 0:
        raise ValueError("counts_not_positive")
    return largest_remainder(counts, name, count, max(ceil(round(r["n"] * ratio) / patterns), r["k"]))


def fill_quota(candidates: DataFrame, group: str, order: list[str], quota: str = "quota", semantic: str | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Candidates in order with ``state``: accepted up to their group's quota; source_semantic where the meaning is excluded;
    evaluation_semantic where an earlier candidate of the group has it; not_needed once the quota is full. ``place`` numbers
    the accepted. Without ``semantic`` all candidates differ."""
    c = candidates
    if excluded is not None:
        c = c.join(excluded.select(semantic).distinct().withColumn("_out", F.lit(True)), semantic, "left")
    else:
        c = c.withColumn("_out", F.lit(None).cast("boolean"))
    c = c.withColumn("_out", F.coalesce("_out", F.lit(False)))
    if semantic is not None:
        first = c.groupBy(group, semantic).agg(F.min(F.struct(*order)).alias("_first"))
        c = c.join(first, [group, semantic]).withColumn("_again", F.struct(*order) != F.col("_first")).drop("_first")
    else:
        c = c.withColumn("_again", F.lit(False))
    fresh = F.when(~F.col("_out") & ~F.col("_again"), 1).otherwise(0)
    w = Window.partitionBy(group).orderBy(*order)
    c = c.withColumn("_before", F.coalesce(F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    state = F.when(F.col("_before") >= F.col(quota), "not_needed").when(F.col("_out"), "source_semantic").when(F.col("_again"), "evaluation_semantic").otherwise("accepted")
    c = c.withColumn("state", state)
    return c.withColumn("place", F.when(F.col("state") == "accepted", F.col("_before") + 1)).drop("_out", "_again", "_before")


def shortages(filled: DataFrame, quotas: DataFrame, group: str, quota: str = "quota") -> DataFrame:
    """Groups whose accepted candidates don't reach their quota, and by how many."""
    got = filled.where("state = 'accepted'").groupBy(group).agg(F.count("*").alias("_n"))
    j = quotas.select(group, quota).join(got, group, "left")
    return j.select(group, (F.col(quota) - F.coalesce("_n", F.lit(0))).alias("missing")).where("missing > 0")


def fill_until(batch: Callable[[int], DataFrame], quotas: DataFrame, group: str, order: list[str], semantic: str, excluded: DataFrame, max_attempts: int, quota: str = "quota") -> DataFrame:
    """Candidates of as many batches as the quotas take, with their states; batch(k) are those of attempt k. Quotas that stay short
    after ``max_attempts`` are an error that names them."""
    scratch = Scratch(quotas.sparkSession)
    pool = None
    for k in range(max_attempts):
        more = batch(k).withColumn("attempt", F.lit(k))
        pool = scratch.settle(more if pool is None else pool.unionByName(more))
        wanted = pool.join(F.broadcast(quotas.select(group, quota)), group)  # a row per template
        filled = fill_quota(wanted, group, ["attempt", *order], quota, semantic, excluded)
        short = shortages(filled, quotas, group, quota).orderBy(group).limit(20).collect()
        if not short:
            return filled
    raise ValueError("quota_shortage: " + ", ".join(f"{r[group]} lacks {r['missing']}" for r in short))


def rename_groups(groups: DataFrame, template: str, order: str, suffix: str = "E") -> DataFrame:
    w = Window.partitionBy(template).orderBy(order)
    return groups.withColumn("new_group_id", F.format_string(f"%s-{suffix}%03d", F.col(template).cast("string"), F.row_number().over(w)))


def shard(rows: DataFrame, order: str, n: int, group: str | None = None) -> DataFrame:
    """Round robin: row k of the order (a unique column) goes to shard k mod n."""
    if group is None:
        return dense_index(rows, order, "_k").withColumn("shard", F.pmod("_k", F.lit(n)).cast("int")).drop("_k")
    return rows.withColumn("shard", F.pmod(F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1, F.lit(n)))


def oversample(rows: DataFrame, key: str, listed: DataFrame, factor: int) -> DataFrame:
    """Listed keys ``factor`` times, the copies numbered from 1; copy 1 is the base row."""
    hit = listed.select(F.col(key).alias("_k")).distinct().withColumn("_listed", F.lit(True))
    times = F.when(F.col("_listed"), F.lit(factor)).otherwise(F.lit(1))
    return rows.join(hit, F.col(key) == F.col("_k"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_k", "_listed")


def even_spaced(rows: DataFrame, order: str, group: str, picks: int) -> DataFrame:
    """``picks`` rows of each group at even spaces of its order, ends included (halves round to even)."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(picks - 1)).cast("long"))
    return r.where(F.array_contains(at, F.col("_k").cast("long"))).drop("_k", "_n")


def median_pick(rows: DataFrame, order: str, group: str, prefer: Column | None = None) -> DataFrame:
    """The element n // 2 of each group's order; of the preferred rows alone where a group has any."""
    w = Window.partitionBy(group)
    r = rows
    if prefer is not None:
        r = r.withColumn("_p", F.coalesce(prefer, F.lit(False))).withColumn("_any", F.bool_or("_p").over(w)).where("_p OR NOT _any").drop("_p", "_any")
    r = r.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return r.where(F.col("_k") == F.floor(F.col("_n") / 2)).drop("_k", "_n")


def longest(rows: DataFrame, group: str, length: str, order: str) -> DataFrame:
    """The longest row of each group, the first on ties: an aggregate, not a window."""
    fields = [c for c in rows.columns if c not in (group, length, order)]
    best = rows.groupBy(group).agg(F.max(F.struct(F.col(length), (-F.col(order)).alias("_o"), *fields)).alias("b"))
    return best.select(group, f"b.{length}", (-F.col("b._o")).alias(order), *[f"b.{c}" for c in fields])


def split_groups(rows: DataFrame, group: str, query: str) -> DataFrame:
    """(group, component): groups that share a query, directly or through others, get the smallest group's name."""
    scratch = Scratch(rows.sparkSession)
    pairs = scratch.settle(rows.select(F.col(group).alias("g"), F.col(query).alias("q"), F.xxhash64(group).alias("node")).distinct())
    low = pairs.groupBy("q").agg(F.min("node").alias("v"))
    roots = components(scratch, pairs.join(low, "q").select(F.col("node").alias("u"), "v"))
    named = pairs.select("g", "node").distinct().join(roots, "node", "left").select("g", F.coalesce("root", "node").alias("root"))
    named = scratch.settle(named)
    return named.join(named.groupBy("root").agg(F.min("g").alias("component")), "root").select(F.col("g").alias(group), "component")


def assign_splits(rows: DataFrame, group: str, query: str, scenario: str, seed: str, fraction: float) -> DataFrame:
    """(group, component, split): scenario by scenario in order, components go to validation in the order of the digest of
    seed and component until ``fraction`` of the scenario's rows is there; one of its components at least is left to train.

    Scenarios depend on each other only through components that several of them hold. All others are decided at once, by running totals
    over (scenario, digest); only scenarios with a shared component are taken one after the other."""
    scratch = Scratch(rows.sparkSession)
    found = scratch.settle(split_groups(rows, group, query))
    key = F.sha2(F.to_json(F.array(F.lit(seed), F.col("component").cast("string"))), 256)
    sizes = rows.join(found, group).groupBy("component", F.col(scenario).alias("_scenario")).agg(F.count("*").alias("n"))
    sizes = scratch.settle(sizes.withColumn("digest", key).withColumn("one", F.lit(1).cast("long")))
    placed = running_totals(scratch, sizes, [F.col("_scenario").asc_nulls_first(), "digest", "component"], ["n", "one"])
    scenarios = placed.groupBy("_scenario").agg(F.sum("n").alias("_all"), F.count("*").alias("_m"), F.min("n_before").alias("_n0"), F.min("one_before").alias("_one0"))
    scenarios = scratch.settle(scenarios.withColumnRenamed("_scenario", "_name"))
    several = sizes.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
    late = [r["_scenario"] for r in sizes.join(several, "component", "left_semi").select("_scenario").distinct().orderBy(F.col("_scenario").asc_nulls_first()).collect()]  # scenarios
    whole = (F.col("n_before") - F.col("_n0") < F.col("_all") * fraction) & (F.col("_m") - (F.col("one_before") - F.col("_one0")) > 1)
    free = placed.join(scenarios, F.col("_scenario").eqNullSafe(F.col("_name")))
    for name in late:
        free = free.where(~F.col("_scenario").eqNullSafe(F.lit(name)))
    taken = scratch.settle(free.where(whole).select("component"))
    for name in late:
        here = sizes.where(F.col("_scenario").eqNullSafe(F.lit(name)))
        r = here.agg(F.sum("n").alias("n"), F.count("*").alias("m")).first()
        had = here.join(taken, "component", "left_semi").agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        left = running_totals(scratch, here.join(taken, "component", "left_anti"), ["digest", "component"], ["n", "one"])
        more = left.where((F.col("n_before") + had["n"] < r["n"] * fraction) & (r["m"] - had["m"] - F.col("one_before") > 1))
        taken = scratch.settle(taken.union(more.select("component")))
    split = F.when(F.col("_hit"), "validation").otherwise("train")
    return found.join(taken.withColumn("_hit", F.lit(True)), "component", "left").select(group, "component", split.alias("split"))
