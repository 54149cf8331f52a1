"""Tables settled in the folder that the cluster shares, and what is built on them: running totals over a global order and
connected components. Operators and the training-data subpackage use these alike."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shuffle files of an execution go when it ends, where the release of Spark can do so.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on this machine alone
    gets a folder of its own, which goes at exit; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gleaner.own.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.gleaner.own.dir", root)
    return root.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Tables settled in the shared folder: written once, so that a lost executor costs a re-read and not a
    recomputation, and nothing that ran before is kept in the lineage. What ``drop`` doesn't delete earlier is deleted when
    the driver's JVM ends, since results read these tables as long as the session lives."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}", 0

    def _filesystem(self, path: str):
        jvm = getattr(self.spark, "_jvm", None)  # a remote session has none; its folders stay
        if jvm is None:
            return None, None
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def settle(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        conf = self.spark.conf
        before = conf.get(CLEAN, None)
        with contextlib.suppress(Exception):  # not in every release
            conf.set(CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            with contextlib.suppress(Exception):
                conf.set(CLEAN, before or "false")
        if self.made == 1:
            fs, p = self._filesystem(self.root)
            if fs is not None:
                fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._settled = path
        return out

    def place(self) -> str:
        """A new path below the scratch's folder, for files of another kind."""
        fs, p = self._filesystem(self.root)
        if fs is not None:
            fs.mkdirs(p)
            fs.deleteOnExit(p)
        self.made += 1
        return f"{self.root}/{self.made - 1}"

    def drop(self, *tables: DataFrame) -> None:
        """Deletes settled tables that no later plan reads."""
        for t in tables:
            if path := getattr(t, "_settled", None):
                fs, p = self._filesystem(path)
                if fs is not None:
                    fs.delete(p, True)


def running_totals(scratch: Scratch, df: DataFrame, order: list, values: list[str]) -> DataFrame:
    """Adds ``<v>_before``, the sum of each long column v over all rows that stand earlier in the global order.

    The rows are range-partitioned by the whole order key, so a value that a third of the rows share is cut like any
    other stretch of the order; each partition sums its own rows in order and one total per partition is added later.
    """
    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    fields = [pa.field(f"{v}_before", pa.int64()) for v in values]

    def walk(batches):
        carry = [0] * len(values)
        for b in batches:
            for k, (v, f) in enumerate(zip(values, fields, strict=True)):
                x = b.column(b.schema.get_field_index(v)).fill_null(0).to_numpy(zero_copy_only=False)
                c = np.cumsum(x)
                b = b.append_column(f, pa.array(c - x + carry[k], pa.int64()))
                carry[k] += int(c[-1]) if len(c) else 0
            yield b

    schema = T.StructType([*ranged.schema.fields, *[T.StructField(f"{v}_before", T.LongType()) for v in values]])
    local = scratch.settle(ranged.mapInArrow(walk, schema))
    # One row a partition: a bounded table.
    per = sorted(local.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).collect(), key=lambda r: r["_part"])
    starts, total = [], [0] * len(values)
    for r in per:
        starts.append((r["_part"], *total))
        total = [t + (r[v] or 0) for t, v in zip(total, values, strict=True)]
    off = df.sparkSession.createDataFrame(starts or [(0, *total)], "_part int, " + ", ".join(f"_o{k} long" for k in range(len(values))))
    out = local.join(F.broadcast(off), "_part").drop("_part")
    for k, v in enumerate(values):
        out = out.withColumn(f"{v}_before", F.col(f"{v}_before") + F.col(f"_o{k}")).drop(f"_o{k}")
    return out


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node over undirected edges (u, v) of longs.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Neighbour minima are partial
    aggregates and the joins read settled tables on either side, so Spark can split a hub's rows. Edges only ever go to
    smaller nodes, so the rounds end; there is no limit on their number.
    """
    e = scratch.settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def digest(t):
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last, now = None, digest(e)
    while now != last:
        old = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        e2 = scratch.settle(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        low2 = scratch.settle(e2.groupBy("u").agg(F.min("v").alias("m")))
        # small star: u and its smaller neighbours go to the smallest of them
        star = e2.join(low2, "u")
        e = scratch.settle(
            star.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        scratch.drop(old, low, e2, low2)
        last, now = now, digest(e)
    # At the fixed point every node's only edge goes to its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
