"""Equi-joins that stay balanced when one key holds a large share of the left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import broadcast_if_small

HOT_ROWS = 2_000_000
SALTS = 64


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``left`` joined to ``right`` with hot left keys spread over ``salts`` partitions.

    Hot keys are counted first (a map-side combined count over the key columns alone). Without
    any, this is the plain join. Otherwise only the right rows of hot keys are repeated, once
    per salt. ``how`` may be inner, left, left_semi or left_anti. The salt is a hash of the row
    itself, so a recomputed task deals its rows out as before.
    """
    keys = list(keys)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).drop("_n")
    if hot.isEmpty():
        return left.join(right, keys, how)
    marks = broadcast_if_small(hot.withColumn("_hot", F.lit(True)))
    rest = [f.name for f in left.schema.fields
            if f.name not in keys and f.dataType.typeName() not in ("map", "variant")] or keys
    spread = (left.join(marks, keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rest), F.lit(salts)))
                          .otherwise(F.lit(0)))
              .drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    repeated = (right.join(marks, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot"))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
