"""The corpus pipeline: documents are filtered, deduplicated, mixed and packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, and what else the table has.

Defined results of all stages: an empty table gives an empty one; rows that are equal, or share doc_id, are rows of their own unless
a stage says otherwise; texts are taken whole, however long; columns that a stage uses itself may stand in the table under the
same names without meaning anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import mixing, nearcopies, packing, suffix, toxicity
from gleaner.llm.common import Scratch, documents, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels are read from sf_dir. Null and empty texts stay; without labels of both
    kinds nothing goes."""
    return toxicity.reject(docs, toxicity.trained(tune(spark), docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 at least) stays: the one with the smallest
    doc_id, then text hash, and of equal rows one. Null, empty and blank texts are copies of each other; rows without a doc_id stay."""
    return nearcopies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of over 50 words are cut out at all their places, and n_chars follows the text. No row goes; a null text stays
    null, and a text may become empty."""
    return suffix.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document is as many rows as the queue takes it, and none if it isn't taken. A null source is one like any other;
    documents without a word have no size and aren't taken."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of whole sequences; the columns are those of the packing query. A null text is empty: a piece of one id. A document that
    the mixture repeats is packed as often."""
    return packing.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Neither the classifier nor the fingerprints nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.settle(docs)
            scratch.drop(before)
    return docs
