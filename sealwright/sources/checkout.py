"""Checkout event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import CHECKOUT_EVENT


def read_checkout_events(spark: SparkSession, path: str, stream: bool = False,
                         max_files_per_trigger: int = 1000) -> DataFrame:
    """JSON events, one per line, batch or stream, flattened to one row per event."""
    if stream:
        raw = (spark.readStream.schema(CHECKOUT_EVENT).option("maxFilesPerTrigger", max_files_per_trigger).json(path))
    else:
        raw = spark.read.schema(CHECKOUT_EVENT).json(path)
    return flatten_events(raw)


def flatten_events(raw: DataFrame) -> DataFrame:
    return raw.select("recv_ts", "signature_header", "type", "data.object.*").withColumnRenamed("id", "session_id")
