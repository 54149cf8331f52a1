"""Hashes of files of any size: a data source with a partition a file, whose reader takes a chunk at a time.

``binaryFile`` holds a file in one row, so a row's limit and a task's memory bound the file; here a task holds a chunk. SHA-256 is
sequential, so a file is one task's work, and files are spread over the cluster. Files are opened by their URI (local, hdfs, s3, gs,
as pyarrow knows them) in the executors; a store that only Spark's own readers reach falls back to ``binaryFile`` in ``file_hashes``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.sources.files import SourceError

CHUNK = 4 << 20
SCHEMA = "path string, bytes long, sha256 string"
#: Schemes of URIs that the executors open themselves.
OPENED = ("file", "hdfs", "s3", "s3a", "gs")


class FileHashes(DataSource):
    """Option ``paths``: a JSON list of URIs."""

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]), int(self.options.get("chunk", CHUNK)))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], chunk: int):
        self.paths, self.chunk = paths, chunk

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        import pyarrow.fs as pafs

        digest, size = hashlib.sha256(), 0
        # Paths come as they are written, without escapes, so only the store's address is read as a URI.
        scheme, rest = partition.value.split("://", 1)
        host, _, below = rest.partition("/")
        if scheme == "file":
            system, path = pafs.LocalFileSystem(), f"/{below}"
        elif scheme == "hdfs":
            system, path = pafs.FileSystem.from_uri(f"hdfs://{host}/")[0], f"/{below}"
        else:
            system, path = pafs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}")[0], f"{host}/{below}"
        with system.open_input_stream(path) as stream:
            while chunk := stream.read(self.chunk):
                digest.update(chunk)
                size += len(chunk)
        yield partition.value, size, digest.hexdigest()


def file_hashes(spark: SparkSession, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """path, bytes and sha256 of every file that matches or lies below; empty files included where the store lists them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    # A file list, as a manifest is one; contents are not read for it.
    paths = sorted(r["path"] for r in listed.select("path").collect())
    uris = [p if "://" in p else p.replace("file:/", "file:///", 1) for p in paths]
    if not all(u.split("://")[0] in OPENED for u in uris):
        return listed.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    spark.dataSource.register(FileHashes)
    return spark.read.format("file_hashes").option("paths", json.dumps(uris)).option("chunk", chunk).load()


def named_hashes(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Name (below the folder), bytes and sha256 of every file below a folder."""
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    return file_hashes(spark, folder, chunk).select(F.substring_index("path", root + "/", -1).alias("name"), "bytes", "sha256")


def model_dir_problems(spark: SparkSession, folder: str, files: DataFrame, index: tuple[str, int, str], weights: DataFrame) -> DataFrame:
    """(name, problem) of a model's folder against a fixed snapshot. files: name, sha256; index: name, bytes and sha256 of the weight index, a
    JSON object whose weight_map names each tensor's shard; weights: name, bytes, sha256 of the shards. An index that isn't the
    snapshot's is an error, since nothing it says can be used."""
    found = named_hashes(spark, folder).cache()
    name, size, digest = index
    if not found.where((F.col("name") == name) & (F.col("bytes") == size) & (F.col("sha256") == digest)).head(1):
        raise SourceError("local_model_weight_index_mismatch")
    shards = spark.read.schema("weight_map map<string,string>").option("multiLine", True).json(f"{folder.rstrip('/')}/{name}").select(F.explode("weight_map").alias("tensor", "name")).select("name").distinct()
    has = found.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    other = files.join(has, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("_sha256"))).select("name", F.lit("local_model_snapshot_mismatch").alias("problem"))
    both = shards.withColumn("_said", F.lit(True)).join(weights.withColumn("_known", F.lit(True)), "name", "full_outer").join(has, "name", "left")
    outside = F.contains("name", F.lit("/")) | ~F.endswith("name", F.lit(".safetensors"))
    same = F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("sha256").eqNullSafe(F.col("_sha256"))
    code = F.when(F.col("_said").isNull() | F.col("_known").isNull(), "local_model_weight_set_mismatch").when(outside, "invalid_local_weight_path").when(~same, "local_model_weight_mismatch")
    return other.unionByName(both.select("name", code.alias("problem")).where("problem IS NOT NULL"))
