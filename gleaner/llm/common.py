"""What the training-data operators share beside ``gleaner.settled``."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleaner.settled import Scratch, components, partitions, running_totals, shared_dir

__all__ = ["Scratch", "components", "partitions", "running_totals", "shared_dir", "WORD", "WORD_SQL", "documents", "tune", "lean"]

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same for Java's and RE2's regex dialects.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded by bytes as well as by rows, so a run of very long texts can't swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    with contextlib.suppress(Exception):  # not in every release of Spark
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def lean(walk):
    """Wraps a function on Arrow batches: when a task has ended, its worker gives freed memory back to the system, since
    an idle worker's memory counts beside the next stage's."""

    def run(batches):
        yield from walk(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(Exception):  # the C library's own call, where there is one
            ctypes.CDLL(None).malloc_trim(0)

    return run
