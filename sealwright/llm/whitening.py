"""Whitening of embeddings: leading eigenpairs of the covariance by spectrum slicing.

Entries become integers, ``x = floor(1024 * entry) + 100000``. Sums and covariance are gathered by two passes over all
rows; only d sums and d*(d+1)/2 products reach the driver, whatever the number of rows. There the number of eigenvalues
above a shift is read from the signs of an LDL^T factorisation with Bunch-Kaufman pivots. Bisection on that count
isolates one eigenvalue after the other, Rayleigh quotient iteration converges to it, and the counts on both sides of
the result certify its number. A further pass measures the covariance of the whitened rows.

Defined results: rows whose vector is null, holds null or non-finite entries, or entries beyond 2^52 take no part. The
dimension is that of most rows (the larger of equally many); rows of another one, empty vectors too, take no part.
Repeated rows count as often as they occur. Components without variance (fewer than d independent rows) are put out
with null ``whitened`` and ``explained`` 0. ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more have no exact integer beside the shift in double precision.
LARGEST = 2.0 ** 52
_ALPHA = (1 + 17 ** 0.5) / 8


# ---- spectrum slicing (bounded by d x d) -------------------------------------------------------

def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: the positive pivots of LDL^T of the shifted matrix."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).tiny
    positive = 0
    while len(a):
        n = len(a)
        if n == 1:
            return positive + int(a[0, 0] > 0)
        below = np.abs(a[1:, 0])
        r = int(below.argmax()) + 1
        most = below[r - 1]
        if max(abs(a[0, 0]), most) <= tiny:
            a = a[1:, 1:]                       # a zero column: a pivot of zero, not above the shift
            continue
        block = 1
        if abs(a[0, 0]) < _ALPHA * most:
            beside = np.abs(a[r])
            beside[r] = 0
            far = beside.max()
            if abs(a[0, 0]) * far < _ALPHA * most * most:
                if abs(a[r, r]) >= _ALPHA * far:
                    order = np.arange(n)
                    order[[0, r]] = r, 0
                    a = a[np.ix_(order, order)]
                else:
                    block = 2
                    order = np.arange(n)
                    order[[1, r]] = r, 1
                    a = a[np.ix_(order, order)]
        if block == 1:
            positive += int(a[0, 0] > 0)
            column = a[1:, 0]
            a = a[1:, 1:] - np.outer(column, column / a[0, 0])
        else:
            positive += 1                       # such a pivot has one eigenvalue of either sign
            columns = a[2:, :2]
            a = a[2:, 2:] - columns @ np.linalg.solve(a[:2, :2], columns.T)
        a = (a + a.T) / 2
    return positive


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    """One step of inverse iteration, of length one; a shift that is an eigenvalue to the last digit is moved a hair."""
    size = np.abs(matrix).max() or 1.0
    for nudge in (0.0, 4e-16, 4e-15):
        try:
            w = np.linalg.solve(matrix - (shift + nudge * size) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        length = np.linalg.norm(w)
        if np.isfinite(length) and length > 0:
            return w / length
    return v


def _clear_of(v: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``v`` without its parts along the rows of ``found``, of length one."""
    for _ in range(2):
        v = v - found.T @ (found @ v)
    length = np.linalg.norm(v)
    return v / length if length else v


@dataclass(frozen=True)
class Sliced:
    """Leading eigenpairs, largest first; ``vectors`` has one row each. ``certified`` tells for each whether the counts
    on both sides of the value prove its number."""

    values: np.ndarray
    vectors: np.ndarray
    certified: tuple[bool, ...]


def leading(matrix: np.ndarray, k: int) -> Sliced:
    """The ``k`` largest eigenpairs of a symmetric matrix.

    Eigenvalues closer than rounding are one group: its vectors are chosen within the group and kept orthogonal.
    """
    d = len(matrix)
    k = min(k, d)
    span = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0      # no eigenvalue lies outside +-span
    grain = 8 * np.finfo(float).eps * max(span, 1e-280)
    known: dict[float, int] = {}

    def above(x: float) -> int:
        if x not in known:
            known[x] = count_above(matrix, x)
        return known[x]

    known[-span - grain], known[span + grain] = d, 0
    values, vectors, proofs = np.zeros(k), np.zeros((k, d)), []
    for i in range(k):
        low = max(x for x, n in known.items() if n > i)
        high = min(x for x, n in known.items() if n <= i)

        def halve() -> None:
            nonlocal low, high
            middle = (low + high) / 2
            if above(middle) > i:
                low = middle
            else:
                high = middle

        while high - low > grain and above(low) - above(high) > 1:
            halve()
        # any start that is not orthogonal to the vector will do; these are fixed
        start = _clear_of(np.cos(np.arange(d) * (i + 1.0) + 0.5), vectors[:i])
        while True:
            middle = (low + high) / 2
            v = start
            for _ in range(2):
                v = _clear_of(_solved(matrix, middle, v), vectors[:i])
            value = float(v @ matrix @ v)
            for _ in range(12):
                w = _clear_of(_solved(matrix, value, v), vectors[:i])
                better = float(w @ matrix @ w)
                settled = abs(better - value) <= grain / 64
                v, value = w, better
                if settled:
                    break
            off = np.linalg.norm(matrix @ v - value * v)
            if low - grain <= value <= high + grain and off <= grain:
                break
            if high - low <= grain:
                break
            halve()
        values[i], vectors[i] = value, v
        margin = 4 * grain
        proofs.append(above(value + margin) <= i < above(value - margin))
    # values of one group may come out of order by rounding
    order = np.argsort(-values, kind="stable")
    return Sliced(values[order], vectors[order], tuple(np.array(proofs, bool)[order].tolist()))


# ---- passes over the rows ------------------------------------------------------------------------

def _fit_rows(rows: DataFrame, vector: str) -> Column:
    """Whether a vector takes part, its dimension aside."""
    entry = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(entry, lambda c: F.coalesce(F.abs(c) < LARGEST / SCALE, F.lit(False))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """x of a column of vectors of one dimension, as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _pairs(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: n, exact sums, eigenpairs, trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Rows to project on, over sqrt(e); rows of zeros where there is no variance."""
        solid = self.solid
        return np.where(solid[:, None], self.vectors / np.sqrt(np.where(solid, self.values, 1.0))[:, None], 0.0)

    @property
    def solid(self) -> np.ndarray:
        """Components whose variance is not rounding."""
        return self.values > 1e-13 * max(self.trace, 0.0) * max(len(self.sums), 1)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts are taken off as integers, so nothing is lost to the shift."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exactly."""
        if not len(x):
            return []
        sums = np.array(self.sums, object)
        widest = max(max(abs(self.n * int(x[:, j].max()) - s), abs(self.n * int(x[:, j].min()) - s)) for j, s in enumerate(self.sums))
        # the products may wrap, but then the difference wraps back
        if widest * widest * len(sums) < 2 ** 63 and max(abs(s) for s in self.sums) < 2 ** 63:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = self.n * x.astype(object) - sums
        exact = (gap * gap).sum(axis=1).tolist()
        return [v if v < 2 ** 63 else None for v in exact]


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # integers below 2^53 by at most some 10,000 rows of a batch may pass 2^63, hence Python's integers beyond it
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            n += len(x)
            if int(np.abs(x).max()) * len(x) < 2 ** 62:
                total = total + x.sum(axis=0).astype(object)
            else:
                total = total + x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                                          "total": pa.array([str(t) for t in total], pa.string())})
    return run


def _products(make, d: int):
    """Per task the upper triangle of the sum of outer products of ``make(x)``, and its plain sums below it."""
    rows, columns = _pairs(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = make(_matrix(batch.column(0)))
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(rows, pa.int32()), "j": pa.array(columns, pa.int32()),
                                          "v": pa.array(total[rows, columns], pa.float64())})
    return run


def _gathered(rows: DataFrame, make, d: int) -> np.ndarray:
    """Sum of outer products over all rows; d*(d+1)/2 numbers reach the driver."""
    parts = rows.mapInArrow(_products(make, d), "i int, j int, v double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` for every row
    that takes part and each of the leading ``components``. Other columns are not read."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    part = embeddings.where(_fit_rows(embeddings, vector)).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    # one row for each dimension that occurs, of which only the most frequent is fetched
    usual = part.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    d = usual["d"]
    part = part.where(F.size("v") == d)
    vectors = part.select("v")
    found = vectors.mapInArrow(_sums(d), "i int, n bigint, total string").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = {r["i"]: int(r["total"]) for r in found}
    n = found[0]["n"]
    start = Whitening(n, tuple(sums[i] for i in range(d)), np.zeros(0), np.zeros((0, d)), 0.0)
    covariance = _gathered(vectors, start.centred, d) / n
    best = leading(covariance, components)
    if not all(best.certified):
        raise ArithmeticError("an eigenvalue could not be numbered by its counts")
    fit = Whitening(n, start.sums, best.values, best.vectors, float(np.trace(covariance)))
    k = len(best.values)
    again = _gathered(vectors, lambda x: fit.centred(x) @ fit.scaled.T, k) / n
    solid = np.flatnonzero(fit.solid)
    error = float(np.abs(again[np.ix_(solid, solid)] - np.eye(len(solid))).max()) if len(solid) else 0.0
    explained = np.where(fit.solid, fit.values / fit.trace if fit.trace > 0 else 0.0, 0.0)
    out_types = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                           ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            m = len(x)
            if not m:
                continue
            whitened = pa.array((fit.centred(x) @ fit.scaled.T).ravel(), mask=np.tile(~fit.solid, m))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(fit.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation,
                whitened, pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], schema=out_types)

    return part.select("vec_id", "v").mapInArrow(project, schema)
