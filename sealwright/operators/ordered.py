"""Ordered operators that never hold a whole key in one task.

A key (a case, a page, an install) may own a third of all rows, so a plain
``Window.partitionBy(key)`` would sort that third in one task. Here every key is cut into
*buckets*, contiguous stretches of its order column with a bounded number of rows. The inner
window runs per (key, bucket); only one summary row per bucket is ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

BUCKET_ROWS = 100_000


def bucket_of(order: Column, rows: int = BUCKET_ROWS) -> Column:
    """Bucket number of a unique integer order column: at most ``rows`` rows share one."""
    return F.call_function("div", order.cast("bigint"), F.lit(rows))


@dataclass(frozen=True)
class Running:
    """One running value: ``count``, ``sum``, ``max``, ``last`` (last non-null so far) or ``first``."""

    out: str
    kind: str
    value: Column | None = None
    inclusive: bool = True


def _total(spec: Running, order: Column) -> Column:
    if spec.kind == "count":
        return F.count(F.lit(1))
    if spec.kind == "sum":
        return F.sum(spec.value)
    if spec.kind == "max":
        return F.max(spec.value)
    if spec.kind == "first":
        return F.min_by(spec.value, order)
    return F.max_by(spec.value, F.when(spec.value.isNotNull(), order))


def _inner(spec: Running, window) -> Column:
    w = window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    if spec.kind == "count":
        return F.count(F.lit(1)).over(w)
    if spec.kind == "sum":
        return F.sum(spec.value).over(w)
    if spec.kind == "max":
        return F.max(spec.value).over(w)
    if spec.kind == "first":
        return F.first(spec.value).over(w)
    return F.last(spec.value, ignorenulls=True).over(w)


def prefix_scan(df: DataFrame, keys: Sequence[str], bucket: str, order: str,
                specs: Sequence[Running]) -> DataFrame:
    """Running values per key in ``order``, computed bucket by bucket.

    ``bucket`` must be a non-decreasing function of ``order`` within a key, and ``order``
    must be unique within a key.
    """
    group = [*keys, bucket]
    w = Window.partitionBy(*group).orderBy(order)
    inner = df.select("*", *[_inner(s, w).alias(f"_in_{s.out}") for s in specs])
    totals = df.groupBy(*group).agg(*[_total(s, F.col(order)).alias(f"_t_{s.out}") for s in specs])
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for s in specs:
        col = F.col(f"_t_{s.out}")
        if s.kind in ("count", "sum"):
            value = F.sum(col).over(across)
        elif s.kind == "max":
            value = F.max(col).over(across)
        elif s.kind == "first":
            value = F.first(col).over(across)
        else:
            value = F.last(col, ignorenulls=True).over(across)
        carried.append(value.alias(f"_c_{s.out}"))
    carry = totals.select(*[F.col(k).alias(f"_k_{n}") for n, k in enumerate(group)], *carried)
    # null keys and orders are keys of their own: their rows stay
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{n}")) for n, k in enumerate(group)])
    joined = inner.join(carry, same, "left")
    outs = []
    for s in specs:
        here, before = F.col(f"_in_{s.out}"), F.col(f"_c_{s.out}")
        if s.kind in ("count", "sum"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif s.kind == "max":
            value = F.greatest(here, before)
        elif s.kind == "first":
            value = F.coalesce(before, here)
        else:
            value = F.coalesce(here, before)
        outs.append(value.alias(s.out))
    return joined.select(*df.columns, *outs)


def with_position(df: DataFrame, keys: Sequence[str], order: str, out: str = "pos",
                  rows: int = BUCKET_ROWS) -> DataFrame:
    """1-based row number per key by a unique integer ``order`` column."""
    bucketed = df.withColumn("_bucket", bucket_of(F.col(order), rows))
    return prefix_scan(bucketed, keys, "_bucket", order, [Running(out, "count")]).drop("_bucket")


def range_bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``_bucket`` and ``_ord`` for an order that is not an integer column.

    Rows are range-partitioned on (keys, order), so a large key spreads over many partitions;
    the partition is the bucket. The ids are frozen by writing them before use.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return stage(ranged.withColumns({"_bucket": F.spark_partition_id(),
                                     "_ord": F.monotonically_increasing_id()}), "ranged")
