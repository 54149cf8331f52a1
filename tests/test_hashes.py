"""Hashes of files by chunks, and a model's folder against its snapshot."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.sources import files as fl
from gleaner.sources import hashes as hs


def put(folder, contents):
    for name, content in contents.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}


def test_files_are_hashed_a_chunk_at_a_time(spark, tmp_path):
    want = put(tmp_path, {"a.bin": b"x" * 1_000_003, "sub/é b.txt": "ü".encode() * 77, "c": b"1"})
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in hs.named_hashes(spark, str(tmp_path), chunk=1000).collect()}
    assert got == want
    assert hs.file_hashes(spark, f"{tmp_path}/a*").count() == 1
    assert hs.named_hashes(spark, str(tmp_path)).rdd.getNumPartitions() == 3  # a task a file


def test_a_file_larger_than_a_row_may_be(spark, tmp_path):
    """A sparse file of over 2 GB, which ``binaryFile`` refuses."""
    size = (2 << 30) + 5
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    r = hs.named_hashes(spark, str(tmp_path)).first()
    h = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        h.update(bytes(1 << 20))
    h.update(bytes(size % (1 << 20)))
    assert (r["bytes"], r["sha256"]) == (size, h.hexdigest())
    with pytest.raises(Exception, match="(?i)exceeds the max length|too large|max length"):
        spark.read.format("binaryFile").load(f"{tmp_path}/large").select(F.length("content")).collect()


def test_a_model_folder_against_its_snapshot(spark, tmp_path):
    index = json.dumps({"weight_map": {"t1": "m-1.safetensors", "t2": "m-2.safetensors", "t3": "m-1.safetensors"}}).encode()
    had = put(tmp_path, {"config.json": b"{}", "m-1.safetensors": b"one", "m-2.safetensors": b"two", "model.index.json": index})
    rows = lambda names, cols: spark.createDataFrame([(n, *had[n])[:1] + ((had[n][1],) if cols == 2 else had[n]) for n in names], "name string, sha256 string" if cols == 2 else "name string, bytes long, sha256 string")
    files, weights = rows(["config.json"], 2), rows(["m-1.safetensors", "m-2.safetensors"], 3)
    known = ("model.index.json", *had["model.index.json"])
    problems = lambda w=weights, f=files: {(r["name"], r["problem"]) for r in hs.model_dir_problems(spark, str(tmp_path), f, known, w).collect()}
    assert problems() == set()
    assert problems(weights.where("name LIKE 'm-1%'")) == {("m-2.safetensors", "local_model_weight_set_mismatch")}
    assert problems(weights.withColumn("bytes", F.col("bytes") + F.when(F.col("name") == "m-2.safetensors", 1).otherwise(0))) == {("m-2.safetensors", "local_model_weight_mismatch")}
    (tmp_path / "config.json").write_bytes(b"[]")
    assert problems() == {("config.json", "local_model_snapshot_mismatch")}
    (tmp_path / "model.index.json").write_bytes(b"{}")
    with pytest.raises(fl.SourceError, match="index_mismatch"):
        problems()
