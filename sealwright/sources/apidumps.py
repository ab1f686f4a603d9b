"""Dumps of repository API pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import API_DUMPS


def read_api_dump(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """One object per line, all pages of one kind in one folder."""
    return spark.read.schema(API_DUMPS[kind]).json(path)
