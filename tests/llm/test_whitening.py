"""Whitening against exact integers and a dense eigen-solver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealwright.llm import whitening

TESTDATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>"


def _plain(vectors):
    """(n, deviations, values, unit vectors, centred rows) of equal-length vectors, sums by Python's integers."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    deviation = [sum((n * row[j] - sums[j]) ** 2 for j in range(d)) for row in x]
    centred = np.array([[float(row[j] * n - sums[j]) / n for j in range(d)] for row in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, values[::-1], vecs[:, ::-1].T, centred


def _compare(found, ids, vectors):
    n, deviation, values, vecs, centred = _plain(vectors)
    k = min(8, len(vectors[0]))
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(ids) * k
    signs = {}
    for at, vec_id in enumerate(ids):
        for c in range(1, k + 1):
            row = got[vec_id, c]
            assert row["n"] == n and row["deviation"] == deviation[at]
            assert row["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert row["identity_error"] < 1e-9
            want = centred[at] @ vecs[c - 1] / math.sqrt(values[c - 1])
            sign = signs.setdefault(c, 1.0 if row["whitened"] * want >= 0 else -1.0) if abs(want) > 1e-3 else signs.get(c, 0)
            if sign:
                assert row["whitened"] == pytest.approx(sign * want, abs=1e-6)


def test_driver_table(spark):
    table = spark.read.parquet(f"{TESTDATA}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    _compare(whitening.whiten(table).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=5) * [1, 5, 2, 3, 4]).tolist()) for i in range(40)]
    good += [(100, good[0][1]), (100, good[0][1]), (None, good[1][1])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (204, []),
           (205, [1.0, 2.0]), (206, [1e300] * 5)]
    table = spark.createDataFrame(good + bad, SCHEMA).withColumn("n", F.lit("x")).withColumn("component", F.lit(7)).repartition(5)
    found = whitening.whiten(table).collect()
    assert len(found) == len(good) * 5
    assert {r["vec_id"] for r in found} == {g[0] for g in good}
    once = {r["vec_id"]: r for r in found if r["component"] == 1}
    _, deviation, *_ = _plain([g[1] for g in good])
    assert all(once[g[0]]["deviation"] == dev for g, dev in zip(good, deviation))


def test_empty_constant_and_few_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], SCHEMA)).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in same)
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], SCHEMA)).collect()
    assert [abs(r["whitened"]) for r in two if r["component"] == 1] == pytest.approx([1.0, 1.0])
    assert all(r["whitened"] is None for r in two if r["component"] == 2)


def test_deviation_beyond_a_long(spark):
    far = 4.0e9
    rows = [(1, [far, 0.0]), (2, [-far, 0.0]), (3, [0.0, 1.0])]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    _, deviation, *_ = _plain([r[1] for r in rows])
    assert [found[i] for i in (1, 2, 3)] == [v if v < 2 ** 63 else None for v in deviation]


@pytest.mark.parametrize("values", [[3.0, 2.0, 2.0, 2.0, 1.0, 0.0], [1.0] * 12, [10.0 ** -i for i in range(14)], [0.0] * 3, [5.0]])
def test_slicing_with_ties(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    sliced = whitening.leading(matrix, 8)
    k = min(8, d)
    assert all(sliced.certified)
    assert sliced.values == pytest.approx(sorted(values, reverse=True)[:k], abs=1e-13 * max(values + [1.0]))
    assert np.abs(sliced.vectors @ sliced.vectors.T - np.eye(k)).max() < 1e-12
    assert np.abs(matrix @ sliced.vectors.T - sliced.vectors.T * sliced.values).max() < 1e-13 * max(values + [1.0])


def test_counts_by_inertia():
    rng = np.random.default_rng(8)
    for d in (1, 2, 3, 7, 20):
        a = rng.normal(size=(d, d))
        a = (a + a.T) / 2
        for shift in rng.normal(size=20) * d ** 0.5:
            assert whitening.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
