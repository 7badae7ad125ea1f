"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.plans import data_queries, kept_queries, score_queries, text_queries

QUERIES = {**text_queries.QUERIES, **score_queries.QUERIES, **data_queries.QUERIES, **kept_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **score_queries.ORACLES, **data_queries.ORACLES, **kept_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.text_moderation_summary(spark, sf_dir)
