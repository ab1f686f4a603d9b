"""Case manifests and the row-level overwrite guard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schemas import MANIFEST
from ..session import stage


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents (one JSON object per file) as one row per evidence record."""
    docs = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    return docs.select("tool", "version", "case_id", "operator", "created_unix", "source_root",
                       F.explode("evidence").alias("e")).select(
        "tool", "version", "case_id", "operator", "created_unix", "source_root", "e.*")


def read_manifest_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifests written by ``write_manifest``."""
    return spark.read.schema(schema).json(path)


def write_manifest(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Evidence rows, one folder per case, one record per line. Never overwrites.

    Rows are rebalanced by case first: adaptive execution puts small cases together and splits a
    large one, so there are neither crumbs nor one giant task.
    """
    rows.hint("rebalance", F.col("case_id")).write.mode("errorifexists").partitionBy("case_id").format(fmt).save(path)


def append_new(rows: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Appends only rows whose key is not in the table yet; returns the rows that were refused.

    Of rows that share a key within ``rows`` the one with the smallest other values is taken and the others are
    refused. The verdicts are written before the append, so that reading them later does not see its effect.
    """
    existing = rows.sparkSession.read.parquet(path).select(*[F.col(k).alias(f"_has_{k}") for k in key]).distinct()
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_has_{k}")) for k in key])
    others = [c for c in rows.columns if c not in key]
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*(others or key)))
    judged = stage(rows.withColumn("_twin", number > 1).join(existing.withColumn("_known", F.lit(True)), match, "left").select(
        *rows.columns, (F.col("_twin") | F.coalesce("_known", F.lit(False))).alias("_refused")), "judged")
    judged.where("not _refused").drop("_refused").write.mode("append").parquet(path)
    return judged.where("_refused").drop("_refused")
