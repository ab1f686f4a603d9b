"""Products with prices and features, and drift between copies of a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .joins import skew_join


def catalogue(products: DataFrame, prices: DataFrame, features: DataFrame) -> DataFrame:
    """Product, price and feature rows (left joins). Children lead the joins, so a product with
    very many features is spread rather than gathered."""
    priced = products.join(prices, "product_id", "left")
    matched = skew_join(features, priced, ["product_id"], "inner")
    bare = priced.join(features.select("product_id").distinct(), "product_id", "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def feature_counts(products: DataFrame, prices: DataFrame, features: DataFrame) -> DataFrame:
    """Products with their price and number of features."""
    counted = features.groupBy("product_id").agg(F.count(F.lit(1)).alias("features"))
    return products.join(prices, "product_id", "left").join(counted, "product_id", "left").withColumn(
        "features", F.coalesce("features", F.lit(0)))


def catalogue_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one copy holds, with the side they are on; repeated rows count."""
    columns = a.columns
    left = a.exceptAll(b.select(columns)).withColumn("side", F.lit("a"))
    right = b.select(columns).exceptAll(a).withColumn("side", F.lit("b"))
    return left.unionByName(right)


def drift_columns(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key and column, the two values where the copies differ; a missing side shows null."""
    x = a.select(key, F.lit(True).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    y = b.select(key, F.lit(True).alias("_b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    joined = x.join(y, key, "full_outer")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b"))
                                for c in columns]))
    side = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    return joined.select(key, side.alias("present"), pairs.alias("d")).select(key, "present", "d.*").where(
        ~F.col("a").eqNullSafe(F.col("b")))
