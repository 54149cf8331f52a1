"""Queries by name, with the SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import conversations, exports, files, reporting, runs, scoring, tables, training


def queries() -> dict:
    return {**conversations.QUERIES, **tables.QUERIES, **scoring.QUERIES, **exports.QUERIES, **runs.QUERIES, **files.QUERIES, **training.QUERIES, **reporting.QUERIES}


def oracle_sql() -> dict:
    return {**conversations.SQL, **tables.SQL, **scoring.SQL, **exports.SQL, **runs.SQL, **files.SQL, **training.SQL, **reporting.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace with its disposition."""
    return conversations.flt_disposition(spark, sf_dir)
