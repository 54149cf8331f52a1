"""Preset configurations: distinct definitions, identities that ignore names, variants by hash, and generated seeds.

Random choices are digests of (seed, key), so that they repeat exactly on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.settled import Scratch, running_totals
from gleaner.operators.seeds import wording_fingerprint


def draw(seed: str, *key: Column) -> Column:
    """A number in [0, 1) from a seed and a key."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]), 256), 1, 12), 16, 10).cast("long")
    return h / F.lit(float(1 << 48))


def library(traces: DataFrame) -> DataFrame:
    """traces (preset, config as JSON text): one row per preset, with ``conflict`` where its definitions differ."""
    canon = F.to_json(F.try_parse_json("config"))
    return traces.withColumn("_c", canon).groupBy("preset").agg(F.min("_c").alias("config"), (F.count_distinct("_c") > 1).alias("conflict"))


#: A preset's devices keep their order, which the model sees; so they are an array, not a map.
DEVICES = "array<struct<entity_id:string,name:string,aliases:array<string>,room:string,state:string,controllable:boolean>>"


def identity(presets: DataFrame) -> DataFrame:
    """Adds ``identity``: the digest of devices (in order), candidates, rules and turns without names and descriptions."""
    parts = [c for c in ("devices", "candidates", "initial", "rules", "turns") if c in presets.columns]
    return presets.withColumn("identity", F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def grounded_fingerprint(seeds: DataFrame, presets: DataFrame) -> DataFrame:
    """Adds ``grounded`` to seeds (preset, semantic: digest of the seed without wording and preset name)."""
    known = identity(presets).select("preset", "identity")
    return seeds.join(known, "preset", "left").withColumn("grounded", F.sha2(F.concat_ws("|", "semantic", F.coalesce("identity", F.lit(""))), 256)).drop("identity")


def public_catalog(devices: Column, hidden: Column) -> Column:
    """The keys of visible devices that a model may see, in order."""
    shown = F.filter(devices, lambda d: ~F.array_contains(hidden, d["entity_id"]))
    return F.transform(shown, lambda d: F.struct(*[d[k].alias(k) for k in ("entity_id", "name", "aliases", "room", "controllable")]))


def expand(presets: DataFrame, variants: int = 8, seed: str = "presets") -> DataFrame:
    """Variants of presets (preset, devices, locked: the ids that rules bind): devices in a drawn order, states of free controllable ones
    flipped by a fair draw; in every second variant the first locked device changes places with a drawn free one, states
    included. Variants equal to their original are dropped. Adds derived_from, changed, moved_from and moved_to; rules go with
    ``remap`` of the two."""
    rows = presets.withColumn("_v", F.explode(F.sequence(F.lit(1), F.lit(variants)))).withColumn("derived_from", F.col("preset"))
    key = lambda d: (F.col("preset"), F.col("_v"), d["entity_id"])
    free = lambda d: d["controllable"] & ~F.array_contains("locked", d["entity_id"])
    flips = lambda d: free(d) & (draw(seed + ":flip", *key(d)) < 0.5)
    other = lambda d: F.when(flips(d), F.when(d["state"] == "on", "off").otherwise("on")).otherwise(d["state"])
    placed = F.array_sort(F.transform("devices", lambda d: F.struct(draw(seed + ":order", *key(d)).alias("o"), d.withField("state", other(d)).alias("d"))))
    changed = F.transform(F.filter("devices", flips), lambda d: d["entity_id"])
    drawn = F.array_min(F.transform(F.filter("devices", free), lambda d: F.struct(draw(seed + ":fault", *key(d)).alias("o"), d["entity_id"].alias("e"))))["e"]
    swaps = (F.col("_v") % 2 == 0) & (F.size("locked") > 0) & drawn.isNotNull()
    rows = rows.withColumn("_d", F.transform(placed, lambda x: x["d"])).withColumn("changed", changed).withColumn("moved_from", F.when(swaps, F.array_min("locked"))).withColumn("moved_to", F.when(swaps, drawn))
    state_of = lambda e: F.get(F.filter("_d", lambda d: d["entity_id"] == e), F.lit(0))["state"]
    swapped = F.transform("_d", lambda d: d.withField("state", F.when(d["entity_id"] == F.col("moved_from"), state_of(F.col("moved_to"))).when(d["entity_id"] == F.col("moved_to"), state_of(F.col("moved_from"))).otherwise(d["state"])))
    out = rows.select(F.format_string("%s_%02d", "preset", "_v").alias("preset"), "derived_from", swapped.alias("devices"), "changed", "moved_from", "moved_to", F.col("devices").alias("_old"))
    return out.where((F.to_json("devices") != F.to_json("_old")) | F.col("moved_from").isNotNull()).drop("_old")


def swap(value: Column, a: Column, b: Column) -> Column:
    """JSON text with two ids exchanged wherever they stand as a whole text, as a key or as a value, at any depth."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    held = F.replace(value, quoted(a), F.lit('"\u0001"'))
    return F.when(a.isNull() | b.isNull(), value).otherwise(F.replace(F.replace(held, quoted(b), quoted(a)), F.lit('"\u0001"'), quoted(b)))


def remap(value: Column, mapping: dict[str, str]) -> Column:
    """An array of names with a mapping applied; the others stay."""
    if not mapping:
        return value
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    renamed = lambda n: F.coalesce(F.try_element_at(m, n), n)
    return F.transform(value, renamed)


def remap_json(value: Column, mapping: dict[str, str]) -> Column:
    """JSON text with a mapping applied to keys and values that are a whole text, at any depth. All names change at once, so two may
    change places."""
    out = value
    for k, old in enumerate(mapping):
        out = F.replace(out, F.lit(f'"{old}"'), F.lit(f'"\u0001{k}\u0001"'))
    for k, new in enumerate(mapping.values()):
        out = F.replace(out, F.lit(f'"\u0001{k}\u0001"'), F.lit(f'"{new}"'))
    return out


def rotate_patterns(seeds: DataFrame, excluded: DataFrame) -> DataFrame:
    """One seed per group: the pattern whose turn it is (groups in order take P1, P2, P3 in rotation), the next one if its
    wording is among the excluded or chosen by an earlier group, the first in turn if all are; then it is marked ``reused``.

    All groups choose anew from the choices of the groups before them until none changes. The first group's choice holds
    from the first round on, the second's from the second, and so on, so the rounds end with what choosing one by one gives."""
    scratch = Scratch(seeds.sparkSession)
    w = wording_fingerprint(seeds)
    groups = w.select("template_id", "variable_group_id").distinct().withColumn("_one", F.lit(1).cast("long"))
    groups = running_totals(scratch, groups, ["template_id", "variable_group_id"], ["_one"]).withColumnRenamed("_one_before", "_k").drop("_one")
    old = wording_fingerprint(excluded).select("wording").distinct().withColumn("_old", F.lit(1))
    turn = F.pmod(F.substring("question_pattern_id", 2, 9).cast("int") - 1 - F.col("_k"), F.lit(3))
    rows = w.join(groups, ["template_id", "variable_group_id"]).join(old, "wording", "left")
    rows = scratch.settle(rows.select("template_id", "variable_group_id", "_k", "seed_id", "question_pattern_id", "wording", F.coalesce("_old", F.lit(0)).alias("_old"), turn.alias("_turn")))
    last = None
    while True:
        r = rows.withColumn("_first", F.lit(None).cast("int"))
        if last is not None:
            r = rows.join(last.groupBy("wording").agg(F.min("_k").alias("_first")), "wording", "left")
        taken = F.when((F.col("_old") == 1) | F.coalesce(F.col("_first") < F.col("_k"), F.lit(False)), 1).otherwise(0)
        best = r.groupBy("template_id", "variable_group_id", "_k").agg(F.min(F.struct(taken.alias("o"), F.col("_turn").alias("t"), "seed_id", "question_pattern_id", "wording")).alias("b"))
        out = scratch.settle(best.select("template_id", "variable_group_id", "_k", "b.seed_id", "b.question_pattern_id", "b.wording", (F.col("b.o") == 1).alias("reused")))
        if last is not None:
            now = ["_k", "seed_id", "reused"]
            if not out.select(now).exceptAll(last.select(now)).head(1):
                break
            scratch.drop(last)
        last = out
    return out.select("template_id", "variable_group_id", "seed_id", "question_pattern_id", "reused")
