"""Sharding by a Hilbert curve over document metadata.

Four dimensions (source, language, the logarithm of the size and doc_id) are quantised to 2^BITS cells each, spread over the whole
range of a dimension, since values that shared their high bits would never part two shards. Documents are sorted by the
index of their cell on the Hilbert curve, then by doc_id, and the order is cut into runs of near equal bytes, so that
each shard covers a compact box of the metadata space and a file can be pruned on any of the four dimensions.

The law is ``bytes``: a document belongs to the shard in which the middle of its bytes falls.

Defined results: a null text counts as no bytes and has the CRC of the empty string; a null source or language is a
value of its own, ordered last; a null doc_id falls into the last cell and sorts last; equal texts are equal rows for
the curve only if their metadata agree (the law is about bytes, not groups); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, documents, running_totals, tune

SHARDS, BITS, ROW_BYTES = 40, 5, 16


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with len(axes) coordinates of ``bits`` bits (Skilling, 2004), vectorised."""
    x = [a.astype(np.int64).copy() for a in axes]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = out << 1 | ((a ^ t) >> b & 1)
    return out


def _ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A row per distinct value of a metadata column with its cell: the rank of the value spread over 2^BITS cells."""
    d = rows.select(column).distinct()
    by = Window.orderBy(F.col(column).asc_nulls_last())
    d = d.select(F.col(column).alias(f"_{name}_value"), (F.row_number().over(by) - 1).alias("_r"), F.count("*").over(Window.partitionBy()).alias("_n"))
    return d.select(f"_{name}_value", F.expr(f"cast(_r * {1 << BITS} div _n as long)").alias(name))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the curve index of every row. Texts are read once and not shuffled."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.settle(
        docs.select(
            "doc_id", "source", "lang", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
        )
    )
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("size").alias("least"), F.max("size").alias("most")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    least, most = (math.log2(ends[c] or 1) for c in ("least", "most"))
    s, g = _ranks(rows, "source", "s"), _ranks(rows, "lang", "g")
    top = (1 << BITS) - 1
    cells = (
        rows.join(s, rows["source"].eqNullSafe(s["_s_value"]))
        .join(g, rows["lang"].eqNullSafe(g["_g_value"]))
        .select(
            "doc_id", "size", "text_crc32", "s", "g",
            F.least(F.floor((F.log2("size") - F.lit(least)) / F.lit(most - least + 1e-9) * F.lit(top + 1)).cast("long"), F.lit(top)).alias("z"),
            F.coalesce(F.least(F.floor((F.col("doc_id").cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo) + 1.0) * F.lit(top + 1)).cast("long"), F.lit(top)), F.lit(top)).alias("d"),
        )
    )

    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([x.to_numpy() for x in (a, b, c, d)], BITS))

    curve = scratch.settle(cells.select("doc_id", "size", "text_crc32", index("s", "g", "z", "d").alias("curve"), F.lit(1).cast("long").alias("_one")))
    placed = running_totals(scratch, curve, ["curve", F.col("doc_id").asc_nulls_last(), "text_crc32", "size"], ["size", "_one"])
    total = curve.agg(F.sum("size")).first()[0] or 1
    shard = F.least(F.lit(shards - 1), F.expr(f"cast((2 * size_before + size) * {int(shards)} div {2 * int(total)} as int)"))
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("_one_before").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_one_before") - F.col("_first")).alias("slot"), "curve"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
