"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the shortest string not yet in the dictionary, and joins it. The phrase
set is hashed and sketched by one-permutation minimum hashing with SLOTS slots of eight bits (empty slots borrow from
the next full one). The share of equal slots, corrected for chance, estimates the Jaccard similarity of two phrase sets,
a cheap stand-in for compression distance.

Neighbours: documents stand in the order of doc_id, then text hash. Running totals of their bytes over that order cut it into
ranges of about equal bytes; the first document of each range also goes to the range before it (the first of all to the
last), so every task finds its documents' successors among its own rows and the texts move once. A task streams its
sorted rows and holds a batch and one document at a time. Rows that are equal in doc_id and text are one row with a count: all but the
last of them are followed by their like. An edited text shares the parse of its unchanged front with the original.

Defined results: a null text is empty, has no phrase and the fingerprint of the empty set; equal phrase sets have
likeness 1; a null doc_id sorts first; rows that share doc_id are ordered by text (null first, then by hash) and give a
row each; a table of one row is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, documents, lean, partitions, running_totals, tune

SLOTS = 128


def parse(text: str, seen: set[str], at: int, stop: int, begin: int | None = None) -> int:
    """Parses text[at:stop] on into the dictionary ``seen``; a phrase may begin before ``at``. Returns where the
    unfinished phrase begins."""
    begin = at if begin is None else begin
    add = seen.add
    for end in range(at + 1, stop + 1):
        phrase = text[begin:end]
        if phrase not in seen:
            add(phrase)
            begin = end
    return begin


def signature(phrases: set[str]) -> bytes:
    """Minimum of the phrases' hashes in each slot, cut to eight bits."""
    if not phrases:
        return bytes(SLOTS)
    h = pd.util.hash_array(np.array(list(phrases), dtype=object), categorize=False)
    slot = (h >> np.uint64(57)).astype(np.int64)
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, slot, h << np.uint64(7))
    full = np.flatnonzero(low != np.iinfo(np.uint64).max)
    if len(full) < SLOTS:
        after = full[np.searchsorted(full, np.arange(SLOTS)) % len(full)]
        steps = (after - np.arange(SLOTS)) % SLOTS
        low = low[after] + (steps.astype(np.uint64) << np.uint64(50)) * np.uint64(0x9E3779B97F4A7C15)
    x = low * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two signatures."""
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / SLOTS
    return float(max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def print_of(text: str) -> bytes:
    seen: set[str] = set()
    end = parse(text, seen, 0, len(text))
    return signature(seen | ({text[end:]} if end < len(text) else set()))


def print_pair(text: str, following: str) -> tuple[bytes, bytes, str]:
    """Fingerprints of a text and of its edited form, and the edited text; the common front is parsed once."""
    cut = len(text) // 4
    keep = len(text) - cut
    edited = text[:keep] + following[:cut]
    seen: set[str] = set()
    begin = parse(text, seen, 0, keep)
    other = set(seen)
    end = parse(text, seen, keep, len(text), begin)
    if end < len(text):
        seen.add(text[end:])
    a = signature(seen)
    if edited == text:
        return a, a, edited
    end = parse(edited, other, keep, len(edited), begin)
    if end < len(edited):
        other.add(edited[end:])
    return a, signature(other), edited


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: solid: whether there is a text, less two where there is no doc_id, which is written as LOWEST.
ORDER = ["doc_id", "solid", "th"]
LOWEST = -(1 << 63)


def _walk(batches):
    """Ranges in order (part, ghost, doc_id, solid, text, n). A ghost is the next range's first document: it ends the
    walk of its range and is no result."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    last = None  # the document that waits for its successor's text: part, id, text, n
    held = None  # the one before it, whose result waits for the successor's fingerprint

    for b in batches:
        out: list[tuple] = []

        def emit(doc, pair, near_next, times=1):
            a, e, edited = pair
            row = (doc[1], len(doc[2]), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), e.hex(), likeness(a, e), near_next)
            out.extend([row] * times)

        for part, ghost, doc_id, solid, text, n in zip(*(b.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "solid", "text", "n")), strict=True):
            doc = (part, None if solid < 0 else doc_id, text or "", n)
            if last is not None and last[0] == part:
                pair = print_pair(last[2], doc[2])
                if held is not None:
                    emit(*held, likeness(held[1][0], pair[0]))
                if last[3] > 1:
                    emit(last, print_pair(last[2], last[2]), 1.0, last[3] - 1)
                held = (last, pair)
            if ghost:
                if held is not None:
                    emit(*held, likeness(held[1][0], print_of(doc[2])))
                last = held = None
            else:
                last = doc
        cols = list(zip(*out, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def fingerprints(docs: DataFrame, ranges_per_partition: int = 4) -> DataFrame:
    """FIELDS of every row of docs."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), (F.col("text").isNotNull().cast("int") - F.when(F.col("doc_id").isNull(), 2).otherwise(0)).alias("solid"),
        F.xxhash64("text").alias("th"), "text",
    )
    size = F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size")
    keys = scratch.settle(docs.groupBy(*ORDER).agg(F.count("*").alias("n"), size))
    stats = keys.agg(F.sum("size").alias("size"), F.max("n").alias("n")).first()
    budget = max(1, -(-(stats["size"] or 0) // (ranges_per_partition * partitions(spark))))
    placed = running_totals(scratch, keys.drop("n"), ORDER, ["size"])
    # A row per range: a bounded number.
    first = sorted(tuple(r["h"]) for r in placed.groupBy(F.expr(f"size_before div {budget}")).agg(F.min(F.struct(*ORDER)).alias("h")).collect())
    scratch.drop(keys)
    at = np.array([h[0] for h in first], np.int64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series, solid: pd.Series, th: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(at, doc_id.to_numpy(), side=s) for s in ("left", "right"))
        out = high - 1
        for k in np.flatnonzero(high > low):  # ranges that begin with this doc_id
            key = (doc_id.iat[k], solid.iat[k], th.iat[k])
            out[k] = low[k] - 1 + sum(h <= key for h in first[low[k] : high[k]])
        return pd.Series(out.astype(np.int32))

    heads = [(*h, (k - 1) % len(first)) for k, h in enumerate(first)] or [(0, 0, 0, 0)]
    head = spark.createDataFrame(heads, "doc_id long, solid int, th long, _before int")
    rows = docs.withColumn("n", F.lit(1).cast("long"))
    if (stats["n"] or 0) > 1:  # rows that are equal in id and text
        rows = docs.groupBy(*ORDER).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    rows = rows.withColumn("part", range_of(*ORDER)).join(F.broadcast(head), ORDER, "left")
    places = F.when(F.col("_before").isNull(), F.array("part")).otherwise(F.array("part", "_before"))
    rows = rows.select(*ORDER, "text", "n", F.posexplode(places).alias("ghost", "part"))
    dealt = rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "ghost", *ORDER)
    return dealt.mapInArrow(lean(_walk), FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
