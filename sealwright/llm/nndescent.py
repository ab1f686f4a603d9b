"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors become one node. A first graph comes from sorting the nodes along random hyperplane codes and
comparing them within short runs. NN-descent then improves it: in each round every node brings together its
neighbours and those it is a neighbour of, compares those that have not met, and each of them keeps its best.
The neighbours' vectors travel to the meeting place by joins; lists are bounded by the number of neighbours, and
a node that very many point to is cut to a sample of them inside the tasks, before the shuffle.

Queries walk the finished graph in both directions, all at once: each round joins the best unvisited nodes of
every query's beam to their neighbours and keeps the best, until no beam has an unvisited node.
Nearness is the inner product in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from ..session import remove_path, scratch_path, stage

NEIGHBOURS = 32  # of a node in the graph
ORDERS = 8  # random orders of the first graph
RUN = 128  # nodes compared with each other in the first graph
SETTLED = 0.02  # share of edges that change in a round, below which the graph is done
BEAM = 96  # nodes a query keeps
STRIDE = 32  # nodes of a beam visited in a round
ENTRIES = 32  # nodes a query begins from that is no node itself

EDGES = "u bigint, v bigint, score double, fresh boolean"


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & sound & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(packed: pd.Series, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(-1, dim).astype(np.float64)


def pack_vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, str, int]:
    """(vec_id, vec) of the usable rows, vectors as bytes; the number type and the dimension. If lengths differ,
    the most frequent one (the smallest of equals) counts and vectors of another take no part."""
    kind = "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"
    rows = rows.where(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("_v"))
    length = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = length["d"] if length else 0

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, kind).tobytes() for v in vectors], dtype=object)

    return rows.where(F.size("_v") == dim).select("vec_id", packed("_v").alias("vec")), kind, dim


def _runs(nodes: DataFrame, kind: str, dim: int, neighbours: int, orders: int, run: int, seed: int) -> DataFrame:
    """The first graph: in each random order, the best of the nodes in the same run."""
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(orders, 16, dim))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(15, -1, -1)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["vec"], kind, dim)
            for t in range(orders):
                bits = (x @ planes[t].T > 0)
                bits[:, 1:] ^= bits[:, :-1]  # Gray order: neighbouring codes differ in few planes
                yield pd.DataFrame({"t": t, "code": np.bitwise_xor.accumulate(bits, axis=1) @ weights,
                                    "node": batch["node"], "vec": batch["vec"]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in _with_end(batches):
            rows = batch if held is None else held if batch is None else pd.concat([held, batch], ignore_index=True)
            whole = len(rows) if batch is None else len(rows) - len(rows) % run
            held = rows.iloc[whole:] if batch is not None else None
            for low in range(0, whole, run):
                part = rows.iloc[low:low + run]
                x, ids = _matrix(part["vec"], kind, dim), part["node"].to_numpy()
                # the last nodes of one order and the first of the next may share a run: they are compared too
                s = x @ x.T
                s[ids[:, None] == ids[None]] = -np.inf
                k = min(neighbours, len(ids) - 1)
                if k < 1:
                    continue
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                score = np.take_along_axis(s, best, 1)
                u, v = np.repeat(ids, k), ids[best].ravel()
                ok = np.isfinite(score.ravel())
                yield pd.DataFrame({"u": u[ok], "v": v[ok], "score": score.ravel()[ok], "fresh": True})

    placed = stage(nodes.mapInPandas(place, "t int, code bigint, node bigint, vec binary"), "orders")
    ordered = placed.repartitionByRange("t", "code", "node").sortWithinPartitions("t", "code", "node")
    return ordered.select("node", "vec").mapInPandas(compare, EDGES)


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    """The non-empty batches, then None if there was any."""
    some = False
    for batch in batches:
        if len(batch):
            some = True
            yield batch
    if some:
        yield None


def _best(edges: DataFrame, neighbours: int) -> DataFrame:
    """The best ``neighbours`` of every node; an edge found again is not fresh if it was there before."""
    # dealt by u once: both the grouping and the ranking find their rows together
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.desc("score"), "v")
    return once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= neighbours).drop("_n")


def _meetings(graph: DataFrame, most: int, turn: int) -> DataFrame:
    """(u, v, fresh): whom every node brings together, its own neighbours and a sample of at most ``most`` of
    those that have it for one."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    order = Window.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "v", F.lit(turn)))
    back = back.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return graph.select("u", "v", "fresh").unionByName(back)


def _local_join(meetings: DataFrame, kind: str, dim: int, most: int) -> DataFrame:
    """Compares the members of each meeting; ``least`` is the worst score a member still keeps."""
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in _with_end(batches):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if batch is None:
                held = None
            else:
                last = rows["u"].iloc[-1]
                cut = int(np.searchsorted(rows["u"].to_numpy(), last))
                rows, held = rows.iloc[:cut], rows.iloc[cut:]
            if not len(rows):
                continue
            u = rows["u"].to_numpy()
            starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            sizes = np.diff(np.append(starts, len(u)))
            width = int(sizes.max())
            for low in range(0, len(starts), 256):
                at, n = starts[low:low + 256], sizes[low:low + 256]
                slot = at[:, None] + np.arange(width)
                real = np.arange(width) < n[:, None]
                slot = np.where(real, slot, at[:, None])
                end = at[-1] + n[-1]
                part = rows.iloc[at[0]:end]
                x = _matrix(part["vec"], kind, dim)[slot - at[0]]
                v = part["v"].to_numpy()[slot - at[0]]
                fresh = part["fresh"].to_numpy()[slot - at[0]] & real
                least = part["least"].to_numpy()[slot - at[0]]
                s = np.matmul(x, x.transpose(0, 2, 1))
                met = real[:, :, None] & real[:, None] & (fresh[:, :, None] | fresh[:, None])
                s[~met | (v[:, :, None] == v[:, None])] = -np.inf  # one that comes twice meets the others twice
                s[s <= least[:, :, None]] = -np.inf
                k = min(most, width)
                best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
                score = np.take_along_axis(s, best, 2)
                g, i, j = np.nonzero(np.isfinite(score))
                yield pd.DataFrame({"u": v[g, i], "v": v[g, best[g, i, j]], "score": score[g, i, j], "fresh": True})

    return meetings.repartition("u").sortWithinPartitions("u").select("u", "v", "fresh", "least", "vec").mapInPandas(
        join, EDGES)


def build_graph(nodes: DataFrame, kind: str, dim: int, neighbours: int = NEIGHBOURS, settled: float = SETTLED,
                seed: int = 7) -> DataFrame:
    """(u, v, score): the neighbour graph over ``nodes`` (node, vec), written after every round. Rounds go on until the
    graph is settled; as edges only give way to better ones, it will be."""
    spark = nodes.sparkSession

    def kept(edges: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "graph")
        return stage(_best(edges, neighbours), "graph", path=path), path

    graph, path = kept(_runs(nodes, kind, dim, neighbours, ORDERS, RUN, seed))
    vectors = nodes.withColumnRenamed("node", "v")
    for turn in itertools.count():
        total, fresh = graph.agg(F.count(F.lit(1)), F.count(F.when(F.col("fresh"), 1))).first()
        if not total or (turn and fresh < settled * total):
            break
        # a node with fewer neighbours than it may have keeps anyone it meets
        least = graph.groupBy(F.col("u").alias("v")).agg(
            F.when(F.count(F.lit(1)) >= neighbours, F.min("score")).alias("least"))
        meetings = _meetings(graph, neighbours, turn).join(vectors, "v").join(least, "v", "left").withColumn(
            "least", F.coalesce("least", F.lit(float("-inf"))))
        found = _local_join(meetings, kind, dim, neighbours)
        following, after = kept(graph.withColumn("fresh", F.lit(False)).unionByName(found))
        remove_path(spark, path)
        graph, path = following, after
    return graph.select("u", "v", "score")


def _both_ways(graph: DataFrame, most: int) -> DataFrame:
    """(u, v): neighbours and those one is a neighbour of, the best ``most`` of the latter."""
    order = Window.partitionBy("v").orderBy(F.desc("score"), "u")
    back = graph.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return graph.select("u", "v").unionByName(back.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, kind: str, dim: int, beam: int = BEAM,
           stride: int = STRIDE) -> DataFrame:
    """(query, node, score): at most ``beam`` nodes found for every query (query, vec). A query that is a node
    begins at itself, others at ENTRIES nodes spread by a hash of their ids."""
    spark = nodes.sparkSession

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("nd,nd->n", _matrix(a, kind, dim), _matrix(b, kind, dim)) if len(a) else [],
                         dtype=float)

    links = _both_ways(graph, NEIGHBOURS).groupBy("u").agg(F.collect_list("v").alias("vs"))  # two lists of bounded length
    links = stage(links, "links")
    asked = queries.withColumnRenamed("vec", "query_vec")
    entries = nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node")
    inside = queries.join(nodes.select(F.col("node").alias("query")), "query", "left_semi").select(
        "query", F.col("query").alias("node"))
    outside = queries.join(nodes.select(F.col("node").alias("query")), "query", "left_anti").select("query").crossJoin(
        F.broadcast(entries))  # a fixed number of rows
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "node").join(asked, "query").select("query", "node",
                                                                     product("query_vec", "vec").alias("score"))

    beams = stage(scored(inside.unionByName(outside)).withColumn("seen", F.lit(False)), "beams")
    path = None
    while True:  # beams only get better, so they come to an end
        turn = beams.where(~F.col("seen")).withColumn("_n", F.row_number().over(best)).where(
            F.col("_n") <= stride).select("query", "node")
        if beams.where(~F.col("seen")).isEmpty():
            break
        near = turn.join(links, F.col("node") == F.col("u")).select("query", F.explode("vs").alias("node"))
        # what is known, just visited or new is told apart by one grouping
        known = beams.select("query", "node", "score", "seen").unionByName(
            turn.select("query", "node", F.lit(None).cast("double").alias("score"), F.lit(True).alias("seen"))).unionByName(
            near.select("query", "node", F.lit(None).cast("double").alias("score"), F.lit(False).alias("seen")))
        merged = known.groupBy("query", "node").agg(F.max("score").alias("score"), F.max("seen").alias("seen"))
        merged = stage(merged, "merged")
        both = merged.where("score is not null").unionByName(
            scored(merged.where("score is null").select("query", "node")).withColumn("seen", F.lit(False)))
        after = scratch_path(spark, "beams")
        beams = stage(both.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= beam).drop("_n"),
                      "beams", path=after)
        if path:
            remove_path(spark, path)
        path = after
    return beams.select("query", "node", "score")


def nearest(rows: DataFrame, wanted: Column, top: int = 20, key: str = "vec_id", vector: str = "embedding",
            neighbours: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """The ``top`` nearest other rows found for every row that meets ``wanted``: query_id, rank, vec_id, score.

    Rows with a null id or an unusable vector neither ask nor answer. Rows of equal vectors are one node of the
    graph; of a node's rows the ``top`` + 1 smallest ids can be needed, and these are picked before the shuffle.
    Equal scores go to the smaller id. Rows that repeat an id with another vector answer once for each vector,
    rows that repeat both count once. A single row finds nothing.
    """
    packed, kind, dim = pack_vectors(rows, key, vector)
    packed = stage(packed.distinct(), "vectors")
    order = Window.partitionBy("vec").orderBy("vec_id")
    members = packed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top + 1)
    # one id may stand for several vectors, so nodes get numbers of their own: the hash of the vector decides
    first = packed.groupBy("vec").agg(F.min("vec_id").alias("first"))
    taken = Window.partitionBy("first").orderBy("vec")
    nodes = stage(first.withColumn("_n", F.row_number().over(taken)).select(
        F.when(F.col("_n") == 1, F.col("first")).otherwise(-F.abs(F.xxhash64("vec")) - 1).alias("node"), "vec"), "nodes")
    members = stage(members.join(nodes, "vec").select("node", "vec_id"), "members")
    asking = stage(packed.where(wanted).join(nodes, "vec").select("vec_id", "node"), "asking")
    graph = build_graph(nodes, kind, dim, neighbours)
    queries = nodes.join(asking.select("node").distinct(), "node").select(F.col("node").alias("query"), "vec")
    found = search(graph, nodes, queries, kind, dim, beam)
    by_score = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    answers = found.join(members, "node").withColumn("_n", F.row_number().over(by_score("query"))).where(
        F.col("_n") <= top + 1).select(F.col("query").alias("node"), "vec_id", "score")
    answers = stage(answers, "answers")
    out = asking.withColumnRenamed("vec_id", "query_id").join(answers, "node").where("query_id <> vec_id").select(
        "query_id", "vec_id", "score")
    return out.withColumn("rank", F.row_number().over(by_score("query_id")).cast("int")).where(
        F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
