"""Scrub and restore as streams: rows of text are independent, so no state or watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import job


def scrub_stream(spark: SparkSession, mapping_path: str, texts: DataFrame, col: str = "text") -> DataFrame:
    """texts: a streaming DataFrame."""
    return job.scrub(spark, mapping_path, texts, col)


def restore_stream(spark: SparkSession, mapping_path: str, texts: DataFrame, col: str = "text") -> DataFrame:
    return job.restore(spark, mapping_path, texts, col)
