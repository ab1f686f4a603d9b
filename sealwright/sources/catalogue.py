"""Product catalogue files: quoted CSV or TSV, and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import CATALOGUE_JSON


def read_catalogue_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Quoted tables. A ``features`` column becomes an array, split at semicolons."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("sep", sep)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if "features" in df.columns:
        df = df.withColumn("features", F.split("features", ";"))
    return df


def feed_price(price: Column) -> Column:
    """struct(cents, currency) from merchant feed text such as ``3500.00 USD``."""
    cents = F.rint(F.regexp_extract(price, r"^\s*([\d.]+)", 1).try_cast("decimal(18,2)") * 100).cast("bigint")
    return F.struct(cents.alias("cents"), F.lower(F.regexp_extract(price, r"([A-Za-z]{3})\s*$", 1)).alias("currency"))


def read_catalogue_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested catalogue as (products, prices, features)."""
    docs = spark.read.schema(CATALOGUE_JSON).option("multiLine", str(multi_line).lower()).json(path)
    p = docs.select(F.explode("products").alias("p"))
    products = p.select(F.col("p.id").alias("product_id"), "p.name", "p.description",
                        F.try_element_at("p.metadata", F.lit("tier")).alias("tier"))
    prices = p.select(F.col("p.id").alias("product_id"), F.explode("p.prices").alias("r")).select(
        "product_id", F.col("r.id").alias("price_id"), F.col("r.unit_amount").alias("amount"), "r.currency", "r.type")
    features = p.select(F.col("p.id").alias("product_id"), F.posexplode("p.features").alias("position", "feature"))
    return products, prices, features
