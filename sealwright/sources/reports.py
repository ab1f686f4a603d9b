"""Page reports and page rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import reports as fr
from ..schemas import PAGE_REPORT


def read_page_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Report documents; ``page_id`` falls back to the file they came from."""
    df = spark.read.schema(PAGE_REPORT).option("multiLine", str(multi_line).lower()).json(path)
    return df.withColumn("page_id", F.coalesce("page_id", F.col("_metadata.file_path")))


def with_findings(reports: DataFrame) -> DataFrame:
    """One row per finding: page_id, position, level, text."""
    c = F.col
    items = fr.findings(c("status"), F.coalesce(c("repair.illumination_flattened"), F.lit(False)),
                        F.coalesce(c("repair.shadow_filled"), F.lit(False)),
                        F.greatest(F.size("glare_regions"), F.lit(0)), F.greatest(F.size("shadow_regions"), F.lit(0)),
                        F.coalesce(c("masked_fraction"), F.lit(0.0)), F.coalesce(c("reading_order_nodes"), F.lit(0)))
    return reports.select("page_id", F.posexplode(items).alias("position", "item")).select(
        "page_id", "position", "item.level", "item.text")


def _luma(data: bytes, channels: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if channels == 1:
        return raw
    bgr = raw.reshape(-1, channels)[:, :3].astype(np.int64)
    return ((bgr @ np.array([1868, 9617, 4899]) + 8192) >> 14).astype(np.uint8)


def _histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, channels, data in zip(pdf["path"], pdf["channels"], pdf["data"]):
            counts = np.bincount(_luma(data, int(channels)), minlength=256)
            levels = np.flatnonzero(counts)
            yield pd.DataFrame({"page_id": path, "v": levels, "n": counts[levels]})


def raster_histogram(pages: DataFrame) -> DataFrame:
    """Grey histogram of decoded rasters: counted where the raster is, never exploded to pixels."""
    decoded = pages.where(F.col("width") > 0).select("path", "channels", "data")
    return decoded.mapInPandas(_histograms, "page_id string, v int, n bigint")


def _pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, width, channels, data in zip(pdf["path"], pdf["width"], pdf["channels"], pdf["data"]):
            grey = _luma(data, int(channels))
            for start in range(0, len(grey), 1_000_000):
                part = grey[start:start + 1_000_000]
                at = np.arange(start, start + len(part))
                yield pd.DataFrame({"page_id": path, "y": at // width, "x": at % width, "v": part.astype(np.int32)})


def raster_pixels(pages: DataFrame) -> DataFrame:
    """Grey pixel rows of decoded rasters, for the operators that need positions."""
    decoded = pages.where(F.col("width") > 0).select("path", "width", "channels", "data")
    return decoded.mapInPandas(_pixels, "page_id string, y int, x int, v int")
