"""A training corpus from raw documents: toxic and poor texts go, one of each group of near copies stays, and what
is left is packed into token sequences.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and is written as Parquet and
read again before the next one. All but the last return the columns of ``docs``. Rows with a null id or text pass
the filters by the same rules as any other: their text decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealwright.llm import lshforest, packing, rule_ensemble, toxicity
from sealwright.session import settle, stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier does not reject."""
    plain = docs.select("doc_id", "text")
    net = toxicity.fit_on(plain, _labels(spark, sf_dir))
    # the verdict's columns get names no table has, so that none of the documents' own is replaced
    marked = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    scored = toxicity.toxicity_scores(marked.select("doc_id", "text", "__row"), _labels(spark, sf_dir), model=net)
    return scored.where("predicted = 0").select("__row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    scored, _ = rule_ensemble.quality_scores(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    # ids are not unique by contract, so the verdict is joined by id and text digest
    poor = scored.where("predicted = 0").select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    return docs.join(poor, F.col("doc_id").eqNullSafe(F.col("__id")) & (
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__md5")), "left_anti")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each document in ``__n``; rows with one id and different texts are different
    documents. Numbers follow the order of the ids; a null id has none."""
    digest = F.coalesce(F.md5(F.col("text").cast("string")), F.lit("")).alias("__md5")
    pairs = docs.where("doc_id is not null").select("doc_id", digest)
    if pairs.groupBy("doc_id").agg((F.min("__md5") != F.max("__md5")).alias("several")).where("several").isEmpty():
        return docs.withColumn("__n", F.col("doc_id"))
    ordered = pairs.distinct().repartitionByRange("doc_id", "__md5").sortWithinPartitions("doc_id", "__md5")
    numbers = stage(ordered.withColumn("__n", F.monotonically_increasing_id()), "numbers")
    return stage(docs.withColumn("__md5", digest).join(numbers, ["doc_id", "__md5"], "left").select(*docs.columns, "__n"), "numbered")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; rows that repeat its id and text once."""
    settle(spark)
    known = _numbered(docs)
    copies = lshforest.near_duplicates(known.select(F.col("__n").alias("doc_id"), "text")).where("not kept").select(
        F.col("doc_id").alias("__n")).distinct()
    kept = known.join(copies, "__n", "left_anti")
    named = kept.where(F.col("__n").isNotNull()).dropDuplicates(["__n"])
    return named.unionByName(kept.where(F.col("__n").isNull())).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    settle(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_copies), ("packing", pack)]

#: Learned models, hashed sets and a tokenizer are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = settle(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
