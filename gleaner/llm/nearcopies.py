"""SimHash near-dedup at a wide radius: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 at least.

Texts with equal sets are one node. At a similarity of 0.8 the fingerprints of two sets differ in some 10 of 64 bits, in at
most RADIUS with all but a chance of 1e-6; bands of a fingerprint can't be narrow enough for that and still tell texts
apart. So candidates come from BANDS keys of ROWS minimum hashes each (a pair at 0.8 shares none with a probability of
3e-6, less above), inside a bucket the fingerprints are compared bit-sliced as in ``simhash``, and what lies within
RADIUS is compared exactly.

Buckets with the same members are one. A bucket gives a spanning forest of its links. A bucket larger than BLOCK is dealt
out as pairs of blocks, as in ``simhash``. No bucket is capped.

Defined results: texts of fewer than five words are one shingle; null, empty and blank texts have the empty set and are
copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import components, lean, partitions, tune, Scratch
from gleaner.llm.simhash import fingerprint, hits, shingle_hashes, survivors

SHINGLE, NUMERATOR, DENOMINATOR, RADIUS, BANDS, ROWS, BLOCK, SLICE = 5, 4, 5, 28, 32, 5, 1024, 2048
_DRAW = np.random.default_rng(5)
_FLIP, _SCALE = (_DRAW.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_SCALE |= np.uint64(1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set of a text's k-word shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def node_of(units: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(units.tobytes(), 1)


def band_keys(units: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its ROWS minima."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(units), SLICE):
        np.minimum(least, ((units[None, at : at + SLICE] ^ _FLIP) * _SCALE).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64)


def forest(sets: list[np.ndarray], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning edges, as index pairs, of the graph of all pairs whose fingerprints lie within the radius and whose
    similarity is NUMERATOR / DENOMINATOR at least."""
    size = np.array([len(s) for s in sets])
    flat, out = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel(), []
    start = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    label = np.arange(len(sets))
    for i, j in hits(np.array([fingerprint(s) for s in sets], np.uint64), radius):
        near = j[(label[j] != label[i]) & (size[j] > 0)]  # the empty set is one node and has no copies
        near = near[DENOMINATOR * np.minimum(size[near], size[i]) >= NUMERATOR * np.maximum(size[near], size[i])]
        if not size[i] or not len(near):
            continue
        mine = flat[start[i] : start[i + 1]]
        mark[mine] = True
        ends = np.cumsum(size[near])
        at = np.repeat(start[near] - ends + size[near], size[near]) + np.arange(ends[-1])
        both = np.add.reduceat(mark[flat[at]], ends - size[near], dtype=np.int64)
        mark[mine] = False
        for k in near[DENOMINATOR * both >= NUMERATOR * (size[near] + size[i] - both)].tolist():
            if label[k] != label[i]:
                out.append((i, k))
                label[label == label[k]] = label[i]
    return out


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, th (XXH64 of the text), node and band keys of every row."""

    def each(batches):
        for b in batches:
            nodes, keys = [], []
            for t in b.column(1).to_pylist():
                units = shingles(t)
                nodes.append(node_of(units))
                keys.append(band_keys(units))
            keys = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * BANDS, pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64()), held], names=["doc_id", "th", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(lean(each), "doc_id long, th long, node long, keys array<long>")


def links(scratch: Scratch, docs: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between nodes whose components are those of all candidates that are verified."""
    nodes = scratch.settle(rows.groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "th", "keys")).alias("b")).select("node", "b.*"))
    placed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    full = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("n > 1")
    full = scratch.settle(full.groupBy("n", "members").agg(F.min(F.struct("band", "key")).alias("b")).select("n", "b.band", "b.key"))
    placed = scratch.settle(placed.join(full, ["band", "key"]))
    # A node's set is cut from one of its rows and goes to its buckets.
    wanted = scratch.settle(nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", "id", "th"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th"), "text")

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "units"])

    sets = texts.join(wanted, ["id", "th"]).select("node", "text").mapInArrow(lean(cut), "node long, units binary")
    sets = scratch.settle(sets.dropDuplicates(["node"]))  # equal rows
    g = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = placed.withColumn("g", g).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("z"), "node").join(sets, "node")
    dealt = dealt.select("band", "key", "a", "z", "node", "units").repartition(partitions(docs.sparkSession), "band", "key", "a", "z").sortWithinPartitions("band", "key", "a", "z", "node")

    def compare(batches):
        name, held, out = None, [], []

        def close():
            pairs = forest([np.frombuffer(u, np.uint64) for _, u in held])
            return [(held[i][0], held[j][0]) for i, j in pairs]

        def emit(edges):
            a = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])

        for b in batches:
            for *this, node, units in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if this != name:
                    out += close() if len(held) > 1 else []
                    name, held = this, []
                held.append((node, units))
            if len(out) > 10_000:
                yield emit(out)
                out = []
        out += close() if len(held) > 1 else []
        yield emit(out)

    return dealt.mapInArrow(lean(compare), "u long, v long")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without near-duplicates: one row of each component, as in ``simhash.survivors``."""
    scratch = Scratch(tune(docs.sparkSession))
    rows = scratch.settle(prints(docs))
    roots = components(scratch, scratch.settle(links(scratch, docs, rows, block)))
    roots = scratch.settle(roots.withColumnRenamed("node", "_node"))
    found = rows.join(roots, F.col("node") == F.col("_node"), "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    return survivors(scratch, docs, found)
