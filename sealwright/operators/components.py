"""Connected components by star contraction, with a written table between rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import remove_path, scratch_path, stage
from .joins import HOT_ROWS, skew_join


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))).first())


def _plain_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys)


def connected_components(nodes: DataFrame, edges: DataFrame, scope: Sequence[str],
                         max_rounds: int = 100) -> DataFrame:
    """Adds ``component``, the smallest node number reachable within ``scope``.

    ``nodes``: scope, node. ``edges``: scope, a, b. Each round links every node's larger
    neighbours to its smallest one and then re-hangs chains (alternating large and small stars),
    so the number of rounds grows with the logarithm of the component size, not its diameter.
    """
    scope = list(scope)
    links = edges.where("a <> b").select(*scope, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark = links.sparkSession
    path = scratch_path(spark, "components")
    links = stage(links, "components", path=path)
    before = _signature(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*scope, "u").agg(F.min("v").alias("m"))
        lowest = lowest.select(*scope, "u", F.least("u", "m").alias("m"))
        # fewer edges in all than make one key hot: nothing to spread
        spread = skew_join if 2 * before[0] > HOT_ROWS else _plain_join
        large = spread(both, lowest, [*scope, "u"]).where("v > u").select(
            *scope, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*scope, "u").agg(F.min("v").alias("m"))
        joined = spread(large, least, [*scope, "u"])
        moved = joined.where("v <> m").select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
        following = scratch_path(spark, "components")
        links = stage(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "components", path=following)
        after = _signature(links)
        remove_path(spark, path)
        path = following
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(*scope, F.col("u").alias("node"), F.col("v").alias("_root"))
    return nodes.join(roots, [*scope, "node"], "left").withColumn(
        "component", F.coalesce("_root", "node")).drop("_root")
