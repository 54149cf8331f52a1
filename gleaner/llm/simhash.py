"""SimHash near-duplicates, compared by bit slices.

Fingerprints: a document's 3-word shingles vote on 64 bits with their XXH64. Each distinct fingerprint is one node,
however many documents share it. Fingerprints at most RADIUS bits apart agree in all but RADIUS of the BANDS bands, so
every link lies in a bucket of some choice of BANDS - RADIUS bands: of 40 bits and more, so that buckets stay small where
fingerprints are many. Inside a bucket the fingerprints are stored
vertically, one bit plane per fingerprint bit; 64 distances at a time are counted by carry-save adders over the planes,
and a block is abandoned as soon as every lane is over the radius. A bucket gives its spanning forest, not its pairs.
A bucket larger than BLOCK is dealt out as pairs of blocks to separate tasks, so no bucket is capped and none is one
task's work. Components of the forests are found by star rounds on settled tables.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts of one or two words
are one shingle; copies share a fingerprint and so a component; a null doc_id takes part in links but is never the
smallest id; rows that share doc_id give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import components, documents, lean, partitions, tune, Scratch

SHINGLE, RADIUS, BANDS, BLOCK, SEED = 3, 2, 6, 8192, 42
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> list[int]:
    """XXH64 of every k-word shingle, repeats included; of the whole word sequence if it is shorter."""
    words = _WORDS.findall((text or "").encode().translate(_LOWER))
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends[: -k]]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    h = np.array(hashes, dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, its fingerprint as a signed long, and long columns that are handed on; texts are read where they lie."""

    def each(batches):
        for b in batches:
            f = np.array([fingerprint(shingle_hashes(t)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64), pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(lean(each), "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of ceil(n / 64) words: row b holds bit b of every fingerprint."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-n // 64) * 64), np.uint8)
    lanes[:, :n] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def hits(fps: np.ndarray, radius: int = RADIUS):
    """For each fingerprint i that has any: (i, positions above i at most radius bits away), by bit-sliced counting. What is
    held at a time is bounded by a batch of queries, however many links there are."""
    planes = bit_planes(fps)
    words = planes.shape[1]
    valid = np.zeros(words * 64, np.uint8)
    valid[: len(fps)] = 1
    valid = np.packbits(valid, bitorder="little").view("<u8")
    step = max(1, (1 << 15) // words)
    size = max(1, radius.bit_length())

    def within(count, over):
        """Lanes whose counters hold at most the radius, compared from the highest digit down."""
        above, equal = over.copy(), ~over
        for k in reversed(range(size)):
            if radius >> k & 1:
                equal &= count[k]
            else:
                above |= equal & count[k]
                equal &= ~count[k]
        return ~above

    for at in range(0, len(fps), step):
        q = fps[at : at + step]
        # One set of counters per query and block of 64 lanes; blocks below the queries are done.
        low = at // 64
        row, block = (x.ravel() for x in np.meshgrid(np.arange(len(q)), np.arange(low, words), indexing="ij"))
        count, over = [np.zeros(len(row), np.uint64) for _ in range(size)], np.zeros(len(row), np.uint64)
        for b in range(64):
            flip = np.where((q >> np.uint64(b)) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            carry = planes[b][block] ^ flip[row]
            for c in count:  # carry-save: each digit takes the carry of the one below
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if b % 4 == 3 and b >= radius:
                live = (valid[block] & within(count, over)) != 0
                if not live.all():  # abandoned: every lane of the block is over the radius
                    row, block, over, *count = (x[live] for x in (row, block, over, *count))
                    if not len(row):
                        break
        good = valid[block] & within(count, over)
        cut = np.searchsorted(row, np.arange(len(q) + 1))
        for i in range(len(q)):
            mine = slice(cut[i], cut[i + 1])
            if cut[i + 1] > cut[i]:
                lanes = np.unpackbits(good[mine].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, lane = np.nonzero(lanes)
                j = block[mine][k] * 64 + lane
                j = j[j > at + i]
                if len(j):
                    yield at + i, j


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning edges, as index pairs, of the graph of all links between fingerprints."""
    label, out = np.arange(len(fps)), []
    for i, j in hits(fps, radius):
        while len(j := j[label[j] != label[i]]):
            out.append((i, int(j[0])))
            label[label == label[j[0]]] = label[i]
    return out


def link_forest(scratch: Scratch, nodes: DataFrame, radius: int = RADIUS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between fingerprints whose components are those of all links within the radius."""
    width = 64 // bands
    spans = [(k * width, width if k < bands - 1 else 64 - k * width) for k in range(bands)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(spans, bands - radius)):
        parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1)) for a, w in chosen]
        key = parts[0]
        for (_, w), p in zip(chosen[1:], parts[1:], strict=True):
            key = F.shiftleft(key, w).bitwiseOR(p)
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.t", "b.key")
    # Buckets with the same members are one.
    full = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("members")).where("n > 1")
    full = scratch.settle(full.groupBy("n", "members").agg(F.min(F.struct("t", "key")).alias("b")).select("n", "b.t", "b.key"))
    rows = scratch.settle(rows.join(full, ["t", "key"]))
    scratch.drop(full)
    # A bucket of g blocks is g * (g + 1) / 2 pairs of blocks; a fingerprint goes to the g pairs its block is in.
    g = F.ceil(F.col("n") / F.lit(block)).cast("int")
    rows = rows.withColumn("g", g).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("z"), "fp")
    dealt = rows.repartition(partitions(rows.sparkSession), "t", "key", "a", "z").sortWithinPartitions("t", "key", "a", "z", "fp")

    def compare(batches):
        held: list = []

        def close(parts):
            fps = np.concatenate(parts)
            return [(int(fps[i]), int(fps[j])) for i, j in forest(fps.view(np.uint64), radius)]

        def emit(edges):
            a = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])

        last, out = None, []
        for b in batches:
            t, key, a, z, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(t):
                continue
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(z) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(t)], strict=True):
                name = (t[lo], key[lo], a[lo], z[lo])
                if held and name != last:
                    out += close(held)
                    held = []
                last = name
                held.append(fp[lo:hi])
            if len(out) > 10_000:
                yield emit(out)
                out = []
        if held:
            out += close(held)
        yield emit(out)

    return dealt.mapInArrow(lean(compare), "u long, v long")


def linked(scratch: Scratch, prints: DataFrame, radius: int = RADIUS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Every fingerprint of prints with its smallest doc_id (low) and its component's smallest fingerprint (root)."""
    nodes = scratch.settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(scratch, scratch.settle(link_forest(scratch, nodes, radius, bands, block)))
    return scratch.settle(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))


def groups(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id of every row of docs."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    prints = scratch.settle(fingerprints(docs))
    named = linked(scratch, prints, radius, bands, block)
    low = scratch.settle(named.groupBy("root").agg(F.min("low").alias("component_id")))
    classes = scratch.settle(named.join(low, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def survivors(scratch: Scratch, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component the row of its smallest doc_id, then text hash, and of equal rows one; rows without a doc_id stay.
    found: doc_id, th (XXH64 of the text) and root, the component, of every row of docs. A doc_id may stand in several
    components, a (doc_id, th) only in one."""
    first = found.where("doc_id IS NOT NULL").groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    first = scratch.settle(first.groupBy("root").agg(F.min(F.struct("doc_id", "th", "n")).alias("b")).select(F.col("b.doc_id").alias("_kept"), F.col("b.th").alias("_text"), F.col("b.n").alias("_n")))
    # A row is carried as one struct, so none of its columns meets a name of this function's.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_hash"))
    kept = rows.join(first, (F.col("_id") == F.col("_kept")) & (F.col("_hash") == F.col("_text")), "left_semi")
    if first.where("_n > 1").head(1):
        kept = kept.dropDuplicates(["_id", "_hash"])
    return kept.select("_row.*").unionByName(docs.where(docs["doc_id"].isNull()))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """docs without near-duplicates: one row of each component, as in ``survivors``."""
    scratch = Scratch(tune(docs.sparkSession))
    prints = scratch.settle(fingerprints(docs.withColumn("th", F.xxhash64("text")), "th"))
    return survivors(scratch, docs, prints.join(linked(scratch, prints, **params), "fp").select("doc_id", "th", "root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
