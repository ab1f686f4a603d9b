"""NN-descent and graph search against all inner products."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sealwright.llm import nndescent as nn, queries

SF = "/root/testdata/sf0.01"


def test_recall_and_scores(spark):
    got = queries.op5_nn_descent(spark, SF).toPandas()
    rows = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id", ignore_index=True)
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [k for k in np.lexsort((ids, -s)) if k != q][:20]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        at = mine["vec_id"].map({i: k for k, i in enumerate(ids)}).to_numpy()
        assert np.allclose(mine["score"], s[at], atol=1e-12) and ids[q] not in set(mine["vec_id"])
        assert list(zip(-mine["score"], mine["vec_id"])) == sorted(zip(-mine["score"], mine["vec_id"]))
        hits += len(set(order) & set(at))
        total += 20
    assert hits / total >= 0.9


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4)], "x") for i in range(1, 60)]
    rows += [(i, [1.0, 2.0, 0.5, -1.0], "x") for i in range(100, 190)]  # one common vector
    bad = [(0, None, "x"), (20, [0.0] * 4, "x"), (200, [1.0, None, 1.0, 1.0], "x"), (220, [float("nan")] * 4, "x"),
           (240, [float("inf"), 1.0, 1.0, 1.0], "x"), (260, [1.0], "x"), (None, [1.0] * 4, "x"), (280, [], "x")]
    rows = [r for r in rows if r[0] not in {b[0] for b in bad}]
    table = spark.createDataFrame(rows + bad + rows[:3], "vec_id bigint, embedding array<double>, score string")
    got = nn.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    x = {i: np.array(v) for i, v, _ in rows}
    for q in [i for i in x if i % 20 == 0]:
        want = sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert np.allclose(mine["score"], [-s for s, _ in want])
        if q >= 100:  # ties: the smallest ids of the common vector
            assert mine["vec_id"].tolist() == [i for i in range(100, 122) if i != q][:20]
    assert set(got["query_id"]) == {i for i in x if i % 20 == 0}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    table = spark.createDataFrame([(20 * i, [1.0, i + 1.0]) for i in range(n)], "vec_id bigint, embedding array<float>")
    assert nn.nearest(table, F.col("vec_id") % 20 == 0).count() == (2 if n == 2 else 0)


def test_queries_from_outside(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node bigint, vec binary")
    asked = spark.createDataFrame([(10_000 + i, bytearray(rng.normal(size=8).tobytes())) for i in range(10)],
                                  "query bigint, vec binary")
    graph = nn.build_graph(nodes, "<f8", 8)
    found = nn.search(graph, nodes, asked, "<f8", 8).toPandas()
    hits = 0
    for r in asked.collect():
        best = np.argsort(-(x @ np.frombuffer(bytes(r.vec))))[:20]
        mine = found[found["query"] == r.query].nlargest(20, "score")["node"]
        hits += len(set(best) & set(mine))
    assert hits >= 180


def test_search_goes_on_until_no_beam_has_an_unvisited_node(spark):
    # a path of nodes: the best one is more than 40 rounds away from the entries
    n = 3_000
    nodes = spark.createDataFrame([(i, bytearray(np.array([i + 1.0]).tobytes())) for i in range(n)], "node bigint, vec binary")
    graph = spark.createDataFrame([(i, i + 1, float(i)) for i in range(n - 1)], "u bigint, v bigint, score double")
    asked = nodes.where("node = 2955").select(F.col("node").alias("query"), "vec")
    found = nn.search(graph, nodes, asked, "<f8", 1, beam=4, stride=1).toPandas()
    assert found["node"].max() == n - 1
    assert nn.BEAM >= 96 and nn.SETTLED <= 0.02


def test_only_floats_are_cut_to_32_bits(spark):
    from pyspark.sql import types as T

    from sealwright.llm import nndescent

    for element, kind in ((T.DoubleType(), "<f8"), (T.LongType(), "<f8"), (T.IntegerType(), "<f8"), (T.FloatType(), "<f4")):
        for nulls in (True, False):
            schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.ArrayType(element, nulls))])
            value = 2 ** 24 + 1 if kind == "<f8" else 3
            rows = spark.createDataFrame([(1, [type(1.0)(value) if "Float" in str(element) or "Double" in str(element) else value])], schema)
            packed, found, dim = nndescent.pack_vectors(rows, "k", "v")
            assert (found, dim) == (kind, 1)
            assert np.frombuffer(packed.first()["vec"], kind)[0] == value
