"""Readers and writers: JSON documents, JSON lines (strict and lenient), canonical lines, hashed manifests, write-once outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SourceError(ValueError):
    """A source or an output that breaks its contract; the message is the code."""


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one JSON array or object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One object per line. strict: a blank line is an error as well; otherwise it is skipped. A bad line is an error in both."""
    if strict and spark.read.text(path).where(F.trim("value") == "").head(1):
        raise SourceError("blank_line")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_sources(spark: SparkSession, sources: list[dict], schema: StructType | str) -> DataFrame:
    """Several sources tagged with source_index and scenario; sample ids must be present and unique in all of them."""
    parts = [
        read_jsonl(spark, s["path"], schema, strict=False).withColumns({"source_index": F.lit(k), "scenario": F.lit(s["scenario"])}) for k, s in enumerate(sources)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bad = out.groupBy("scenario", "sample_id").count().where("sample_id IS NULL OR sample_id = '' OR count > 1")
    if bad.head(1):
        raise SourceError("missing_or_duplicate_sample_id")
    return out


def read_many(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """All files of a glob with their path in ``file``; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(pattern).withColumn("file", F.col("_metadata.file_path"))


def file_counts(spark: SparkSession, pattern: str, rows: DataFrame) -> DataFrame:
    """Rows of each file of a glob (as in ``read_many``); a file without rows counts 0 (Spark lists no file of no bytes)."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"))
    n = rows.groupBy("file").agg(F.count("*").alias("rows"))
    return files.join(n, "file", "left").select("file", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


def canonical_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON text per row: keys sorted at every level, nulls kept, nothing escaped needlessly."""
    return df.select(F.to_json(F.parse_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Canonical lines into a folder that must not exist yet."""
    canonical_lines(df).write.mode("errorifexists").text(path)


def write_json_pretty(rows: list[dict], path: str) -> None:
    """A small collected result as an indented JSON document, on the driver; an existing file is an error."""
    with open(path, "x", encoding="utf-8") as f:
        f.write(json.dumps(rows, ensure_ascii=False, indent=2) + "\n")


def save_once(df: DataFrame, path: str) -> bool:
    """Writes, or accepts an existing output of the same content; different content is an error. True if written."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        write_jsonl(df, path)
        return True
    new, old = canonical_lines(df), spark.read.text(path)
    if new.exceptAll(old).head(1) or old.exceptAll(new).head(1):
        raise SourceError("output_differs")
    return False


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against a manifest; empty if all agree."""
    now = manifest(spark, path).select("name", F.col("sha256").alias("found"))
    both = expected.select("name", "sha256").join(now, "name", "full_outer")
    code = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("name", code.alias("problem")).where("problem IS NOT NULL")


def scan_log(spark: SparkSession, path: str, marker: str, pattern: str) -> DataFrame:
    """Matches of a pattern in a log's last segment after a marker."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all(F.substring_index("value", marker, -1), F.lit(pattern), F.lit(1))).alias("match"))
