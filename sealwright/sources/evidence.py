"""File sources: evidence folders, vault listings and page rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.files import base_name, claimed_extension, folder


def _binary_files(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(root)


def scan_evidence(spark: SparkSession, root: str, recursive: bool = True,
                  exts: Sequence[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Regular files under ``root`` with folder and name. Content is read only when selected, and
    a ``max_bytes`` filter reaches the listing, so oversized files are never opened."""
    df = _binary_files(spark, root, recursive)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    df = df.withColumns({"folder": folder(F.col("path")), "name": base_name(F.col("path"))})
    if exts is not None:
        df = df.where(claimed_extension(F.col("path")).isin([e.lower().lstrip(".") for e in exts]))
    return df


def in_name_order(files: DataFrame) -> DataFrame:
    """Inputs sorted by name within their folder."""
    return files.orderBy("folder", "name")


def list_vaults(files: DataFrame, prefix: str = "", suffix: str = ".arcr") -> DataFrame:
    """Vault blobs with size, newest first. Takes any table with path, length, modificationTime."""
    return (files.where(F.col("path").endswith(suffix) & F.col("path").startswith(prefix))
            .select("path", F.col("length").alias("size_bytes"), "modificationTime")
            .orderBy(F.desc("modificationTime"), "path"))


def vault_totals(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("count"),
                       F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def scan_pages(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """Page rasters. Undecodable files stay as rows with width -1 unless dropped."""
    images = (spark.read.format("image").option("dropInvalid", str(drop_invalid).lower())
              .option("recursiveFileLookup", "true").load(root))
    return images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
                         F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"),
                         F.col("image.data").alias("data"))


