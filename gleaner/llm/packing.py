"""Packing by power-of-two decomposition.

A document's ids and its end mark are cut into whole sequences of MAX_TOKENS and then the binary digits of what is left,
longest first. Every piece is a sequence of its own, whose length is a power of two, so no sequence crosses documents
and none is padded. Sequences are numbered by length, longest first, so that equal lengths form one contiguous bucket of
numbers from which batches of one shape are drawn.

Ids are those of the vocabulary file in the library tokenizers with add_special_tokens=False. The library tiktoken gives
the same ids from the same vocabulary about four times as fast and does the work; what it can't be sure of (a text that
contains a special token's string, or that it fails on) goes through tokenizers itself. Tests hold the two together.

Defined results: a null or empty text is its end mark alone; rows that share doc_id, or are equal, are packed as
separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, lean, running_totals, tune, Scratch

MAX_TOKENS, END = 2048, 1
VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS):
    """text -> list of ids; loaded once in a Python worker."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return plain
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: plain(text) if SPECIAL in text else fast.encode_ordinary(text)


def decompose(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then n's remaining binary digits from the highest."""
    out = [most] * (n // most)
    rest = n % most
    while rest:
        bit = 1 << (rest.bit_length() - 1)
        out.append(bit)
        rest -= bit
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _slot long, ids array<int>"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str | None = RANKS, most: int = MAX_TOKENS, with_ids: bool = True) -> DataFrame:
    """The pieces of every document with their ids (the ids are left out if only digests are wanted)."""

    def cut(batches):
        ids_of = encoder(vocabulary, ranks)
        for b in batches:
            rows: list[tuple] = []
            kept = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*ids_of(text or ""), END], dtype="<u4")
                at = 0
                for length in decompose(len(ids), most):
                    piece = ids[at : at + length]
                    rows.append((doc, at, length, zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        kept.append(piece.astype(np.int32))
                    at += length
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, pa.int64()) for c in cols]
            arrays.append(pa.array(np.ones(len(rows), np.int64)))
            arrays.append(pa.array(kept, pa.list_(pa.int32())) if with_ids else pa.nulls(len(rows), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_slot", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), SCHEMA)


def pack(docs: DataFrame, with_ids: bool = False, **params) -> DataFrame:
    """Pieces with sequence_id and offset. Numbers come from a range sort by (length, doc_id, start) over narrow rows."""
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    cut = scratch.settle(pieces(docs, with_ids=with_ids, **params))
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), "start", "ids_crc32"]
    out = running_totals(scratch, cut if with_ids else cut.drop("ids"), order, ["_slot"])
    return out.withColumn("sequence_id", F.col("_slot_before")).withColumn("offset", F.lit(0).cast("long")).drop("_slot", "_slot_before")


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
