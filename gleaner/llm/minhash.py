"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A text's set of 2-word shingles is hashed once (XXH64); BANDS * ROWS bins cut the hashes' range, and a bin holds its smallest hash.
An empty bin takes the hash of the first filled one in an order of its own over all bins (Shrivastava, 2017), so that also
short texts agree in a bin with a probability of their similarity. ROWS bins are a band; texts that agree in a band share a bucket.
At a similarity of 0.8 two sets share no bucket with a probability of 1.3e-7.

Texts with equal sets are one node. A bucket gives a star: edges from its smallest node to each other one, so buckets of n nodes
give n - 1 candidates. Each candidate is confirmed on the full sets. A bucket whose nodes then still lie in several components
may hold links that don't touch its centre, and those are looked for within the bucket: it is dealt out as pairs of blocks of
bounded bytes, a block pair compares only nodes of different components whose sizes allow a link, and gives a spanning forest. So every
link of two nodes that share a bucket counts, whatever the bucket's size.

Defined results: words are lower-cased in A-Z only; a text of one word is one shingle; null, empty and blank texts have no shingles and are
linked with nothing; rows that are equal, or share doc_id, give a row each; a null doc_id takes part in links but is never the
smallest id (component_id is null where there is no other, and such rows are kept); an empty table gives an empty result; texts are taken whole.
Sets are compared as sets of 64-bit hashes, and a node is a 64-bit hash of its set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, components, documents, lean, partitions, tune
from gleaner.llm.simhash import shingle_hashes, survivors

SHINGLE, NUMERATOR, DENOMINATOR, BANDS, ROWS, BLOCK_BYTES = 2, 4, 5, 40, 5, 4 << 20
#: Row j: the order in which an empty bin j looks for a filled one.
_ORDER = np.argsort(np.random.default_rng(12).random((BANDS * ROWS, BANDS * ROWS)), axis=1).astype(np.int32)
_LOWEST = -(1 << 63)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set of a text's k-word shingles as hashes, in order."""
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def node_of(units: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(units.tobytes(), 1)


def signature(units: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """The bins' smallest hashes; the hashes come in order, so the first of a bin is its smallest."""
    at = ((units >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(at, prepend=np.uint64(bins)))
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    used = at[first].astype(np.int64)
    out[used], filled[used] = units[first], True
    if len(used) < bins:
        empty = np.flatnonzero(~filled)
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def band_keys(units: np.ndarray) -> np.ndarray:
    rows = signature(units).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64)


def linked(both: int, a: int, b: int) -> bool:
    return DENOMINATOR * both >= NUMERATOR * (a + b - both)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, th (XXH64 of the text), n, node and band keys of every row; without shingles node and keys are null."""

    def each(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            nodes = pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64), pa.int64(), mask=n == 0)
            keys = [band_keys(s) for s in sets if len(s)]
            keys = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n > 0))) * BANDS, pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), nodes, held], names=["doc_id", "th", "n", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(lean(each), "doc_id long, th long, n long, node long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, units): the set of each wanted node, cut from one of its texts."""

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "units"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64("text").alias("th"), "text")
    return texts.join(wanted, ["id", "th"]).select("node", "text").mapInArrow(lean(cut), "node long, units binary").dropDuplicates(["node"])


def _confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (u, v) whose sets are similar enough."""

    def check(batches):
        for b in batches:
            pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            good = []
            for x, y in pairs:
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                good.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    mine = sets.select(F.col("node").alias("u"), F.col("units").alias("x"))
    theirs = sets.select(F.col("node").alias("v"), F.col("units").alias("y"))
    return edges.join(theirs, "v").join(mine, "u").select("u", "v", "x", "y").mapInArrow(lean(check), "u long, v long")


def forest(sets: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """Spanning edges, as index pairs, of the links between sets of different labels, given that equal labels are connected."""
    size, out = np.array([len(s) for s in sets]), []
    label = np.unique(np.array(labels), return_inverse=True)[1].ravel()
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    start, mark = np.concatenate(([0], np.cumsum(size))), np.zeros(len(flat) + 1, bool)
    least, most = -(-NUMERATOR * size // DENOMINATOR), DENOMINATOR * size // NUMERATOR
    for i in range(len(sets) - 1):
        near = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (size[i + 1 :] >= least[i]) & (size[i + 1 :] <= most[i]))
        if not len(near):
            continue
        mine = flat[start[i] : start[i + 1]]
        mark[mine] = True
        for j in near.tolist():
            if label[j] != label[i] and linked(int(np.count_nonzero(mark[flat[start[j] : start[j + 1]]])), int(size[i]), int(size[j])):
                out.append((i, j))
                label[label == label[j]] = label[i]
        mark[mine] = False
    return out


def _inner(scratch: Scratch, members: DataFrame, roots: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links within the buckets that the stars leave in several components."""
    known = roots.withColumnRenamed("root", "known")
    rows = scratch.settle(members.where("size > 2").join(known, "node", "left").select("key", "node", "n", F.coalesce("known", "node").alias("root")))
    open_ = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("units")).where("low < high")
    g = F.ceil(F.col("units") * 8 / F.lit(block)).cast("int")
    dealt = rows.join(open_.select("key", g.alias("g")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("z"), "node", "root")
    order = ["key", "a", "z", "node"]
    dealt = dealt.join(sets, "node").select(*order, "root", "units").repartition(partitions(sets.sparkSession), "key", "a", "z").sortWithinPartitions(*order)

    def compare(batches):
        name, held = None, []

        def close():
            pairs = forest([u for _, _, u in held], [r for _, r, _ in held]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in side], pa.int64()) for side in (zip(*pairs) if pairs else ((), ()))], names=["u", "v"])

        for b in batches:
            for *this, node, root, units in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if this != name:
                    yield close()
                    name, held = this, []
                held.append((node, root, np.frombuffer(units, np.uint64)))
        yield close()

    return dealt.mapInArrow(lean(compare), "u long, v long")


def links(scratch: Scratch, docs: DataFrame, rows: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Edges (u, v) between nodes whose components are those of all links within buckets."""
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"), "th")).alias("b"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = scratch.settle(nodes.select("node", "b.*", "n", "keys"))
    placed = nodes.select("node", "n", F.explode("keys").alias("key"))
    full = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("size > 1")
    full = scratch.settle(full.groupBy("size", "centre", "who").agg(F.min("key").alias("key")))  # buckets with the same members are one
    members = scratch.settle(placed.join(full.select("key", "size", "centre"), "key"))
    sets = scratch.settle(_sets(docs, nodes.join(members.select("node").distinct(), "node", "left_semi").select("id", "th", "node")))
    edges = members.where("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v"), F.col("n").alias("nv")).distinct()
    size_u = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"))
    fits = f"{DENOMINATOR} * least(nu, nv) >= {NUMERATOR} * greatest(nu, nv)"
    edges = scratch.settle(edges.join(size_u, "u").where(fits).select("u", "v"))
    stars = scratch.settle(_confirmed(edges, sets))
    inner = scratch.settle(_inner(scratch, members, scratch.settle(components(scratch, stars)), sets, block))
    return stars.union(inner)


def grouped(scratch: Scratch, docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, th, n, node and root, the component's smallest node, of every row; node and root are null without shingles."""
    rows = scratch.settle(prints(docs))
    roots = components(scratch, scratch.settle(links(scratch, docs, rows, block)))
    roots = scratch.settle(roots.withColumnRenamed("node", "_node"))
    return scratch.settle(rows.join(roots, F.col("node") == F.col("_node"), "left").select("doc_id", "th", "n", "node", F.coalesce("root", "node").alias("root")))


def groups(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    scratch = Scratch(tune(docs.sparkSession))
    found = grouped(scratch, docs, block)
    low = scratch.settle(found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("low")))
    out = found.join(low, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """docs without near-duplicates: one row of each component, as in ``simhash.survivors``; of rows without shingles those stay that differ."""
    scratch = Scratch(tune(docs.sparkSession))
    found = grouped(scratch, docs, block)
    lone = F.xxhash64("doc_id", "th")  # rows without shingles are components of their own
    return survivors(scratch, docs, found.select("doc_id", "th", F.coalesce("root", lone).alias("root")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS units FROM d
), u AS (SELECT r, len(units) AS n, unnest(units) AS unit FROM s),
meets AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM u a JOIN u b ON a.unit = b.unit AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM meets WHERE 100 * n >= 80 * (na + nb - n)),
reach(r, x) AS (SELECT r, r FROM s UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.x),
low AS (SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.x GROUP BY reach.r)
SELECT doc_id, len(units)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN low USING (r)
"""
