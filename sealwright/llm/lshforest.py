"""Near-duplicate documents with a MinHash forest.

Every document's 5-word shingles are hashed; equal sets become one class, whose smallest id stands for it. Each
tree of the forest sorts the classes by its own sequence of minimum hashes. Classes with a long common prefix lie
together, so candidates are those that share a prefix. How long it must be is decided region by region: where few
classes share BASE hashes all of them are compared, where many do the prefix grows until few are left. Direct
neighbours in the order are compared in any case. Candidates are checked by a bit sketch, then confirmed on the
full sets; links join classes into components.

Only a spanning forest of the pairs a tree finds likely is confirmed at first, and regions in which the prefix had
to grow may hide a link between classes that part further down in every tree. Both are gone through once more in
blocks: only pairs of classes that are not connected yet are looked at, so a dense group that is already one
component costs nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import stage

WORDS = 5  # of a shingle
SIMILAR = 85  # per cent of the union
TREES = 16
DEPTH = 12  # minimum hashes of a tree's order
BASE = 3  # hashes that candidates share at least
FEW = 64  # classes of a region that are all compared
NEAR = 3  # neighbours in the order that are compared in any case
SIGMA = 5.0  # a candidate may fall this far below the threshold on its sketch
BLOCK = 1024  # classes of a block in the second look
STEP = 1 << 18  # shingles hashed at a time

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_ROLL = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                    0xA0761D6478BD642F)]

BUCKETS = 128  # into which a set's hashes are counted

SKETCHED = "doc_id bigint, n_shingles bigint, digest binary, hashes binary, counts binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, known: dict | None = None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text: A-Z in lower case, words between ASCII
    white space, fewer words than ``width`` as one shingle, none without words."""
    known = _Words() if known is None else known
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([known[x] for x in words], np.uint64)
    n = max(len(w) - width + 1, 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(width, len(w))):
        total = _mix(total + w[j:j + n] * _ROLL[j % len(_ROLL)]) + np.uint64(j + 1)
    return np.unique(total)


def permutations(count: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1 << 62, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), \
        rng.integers(1 << 63, size=count, dtype=np.uint64)


def minima(sets: list[np.ndarray], count: int = TREES * DEPTH) -> np.ndarray:
    """The low 16 bits of each set's minimum under ``count`` permutations (sets x count); sets are not empty."""
    a, b = permutations(count)
    out = np.empty((len(sets), count), np.uint16)
    low = 0
    while low < len(sets):
        high, size = low, 0
        while high < len(sets) and (high == low or size + len(sets[high]) <= STEP):
            size += len(sets[high])
            high += 1
        flat = np.concatenate(sets[low:high])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[low:high]])[:-1]])
        for k in range(count):
            v = (flat * a[k] + b[k]) >> np.uint64(24)
            out[low:high, k] = np.minimum.reduceat(v, starts) & np.uint64(0xFFFF)
        low = high
    return out


def bucket_counts(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each bucket, modulo 16, two buckets to a byte."""
    n = np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=BUCKETS) & 15
    return (n[::2] | n[1::2] << 4).astype(np.uint8).tobytes()


def with_hashes(docs: DataFrame) -> DataFrame:
    """SKETCHED for every row: size and digest of its set, and its minimum hashes (null for empty sets)."""
    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.iloc[low:low + 500]
                if len(known) > 500_000:
                    known.clear()
                sets = [shingles(t, known) for t in part["text"]]
                some = [s for s in sets if len(s)]
                found = iter(minima(some)) if some else iter(())
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "hashes": [next(found).astype(">u2").tobytes() if len(s) else None for s in sets],
                    "counts": [bucket_counts(s) if len(s) else None for s in sets]})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(per_task, SKETCHED)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the two-bit fields that agree."""
    x = a ^ b
    both = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return 1 - np.bitwise_count(both).sum(-1, dtype=np.int64) / (a.shape[-1] * 32)


def _least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of how many hashes only one of two sets has: the buckets' differences, modulo 16."""
    out = 0
    for shift in (0, 4):
        d = (a >> shift & 15).astype(np.int16) - (b >> shift & 15)
        d = np.abs(d)
        out = out + np.minimum(d, 16 - d).sum(-1, dtype=np.int64)
    return out


def likely(sketch_a: np.ndarray, n_a: np.ndarray, sketch_b: np.ndarray, n_b: np.ndarray,
           similar: int = SIMILAR) -> np.ndarray:
    """Pairs that sizes and bucket counts allow to be similar (certain bounds) and whose minimum hashes do not
    speak against it (within SIGMA). Sketches are rows of bytes: two-bit fields, then bucket counts."""
    fields = sketch_a.shape[-1] - BUCKETS // 2
    sizes = 100 * np.minimum(n_a, n_b) >= similar * np.maximum(n_a, n_b)
    apart = _least_difference(sketch_a[..., fields:], sketch_b[..., fields:])
    sizes = sizes & (100 * (n_a + n_b - apart) >= similar * (n_a + n_b + apart))
    j = similar / 100
    p = j + (1 - j) / 4
    least = p - SIGMA * (p * (1 - p) / (4 * fields)) ** 0.5
    two = [np.ascontiguousarray(x[..., :fields]).view(np.uint64) for x in (sketch_a, sketch_b)]
    return sizes & (_agree(*two) >= least)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs, in their order, join what no pair before has joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out[k] = True
    return out


def regions(lcp: np.ndarray, base: int = BASE, depth: int = DEPTH, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """For rows in sorted order, with the length of the prefix each shares with the row before: the number of the
    region in which all are compared, and whether more than ``few`` rows share the base prefix."""
    n = len(lcp)
    region = np.zeros(n, np.int64)
    open_rows = np.ones(n, bool)
    crowded = np.zeros(n, bool)
    for d in range(base, depth + 1):
        run = np.cumsum(lcp < d)
        size = np.bincount(run)[run]
        fits = open_rows & (size <= few)
        region[fits] = run[fits] * (depth + 2) + d
        open_rows &= ~fits
        if d == base:
            crowded = open_rows.copy()
        if not open_rows.any():
            return region, crowded
    # the same order of all hashes: blocks of successive rows; the second look compares the blocks
    place = np.arange(n) - np.flatnonzero(np.append(True, run[1:] != run[:-1]))[run - run[0]]
    blocks = np.cumsum(np.append(True, (run[1:] != run[:-1]) | (place[1:] % few == 0)))
    region[open_rows] = blocks[open_rows] * (depth + 2) + depth + 1
    return region, crowded


def _rows_of(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def forest(classes: DataFrame, trees: int = TREES, depth: int = DEPTH, similar: int = SIMILAR) -> DataFrame:
    """Candidates of all trees, and rows to look at again: (a, b, region, n, sketch).

    Candidates have no region. Of the pairs a tree finds likely only a spanning forest is put forward, so a group
    of many near copies costs a few pairs for each of them. Rows of a pair left out, and crowded rows, come again
    with a = b and the base prefix as their region.
    """
    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            h = np.frombuffer(b"".join(batch["hashes"]), ">u2").reshape(len(batch), trees * depth)
            two = (h & 3).astype(np.uint64).reshape(len(batch), -1, 32)
            sketch = (two << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)
            sketches = [s.tobytes() + c for s, c in zip(sketch, batch["counts"])]
            for t in range(trees):
                keys = h[:, t * depth:(t + 1) * depth]
                yield pd.DataFrame({"tree": t, "key": [k.tobytes() for k in keys], "doc_id": batch["doc_id"],
                                    "n": batch["n_shingles"], "sketch": sketches})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(rows: pd.DataFrame) -> pd.DataFrame:
            key = np.frombuffer(b"".join(rows["key"]), ">u2").reshape(len(rows), depth)
            tree, n, ids = (rows[c].to_numpy() for c in ("tree", "n", "doc_id"))
            sketch = _rows_of(rows["sketch"].to_numpy())
            same = np.cumprod(key[1:] == key[:-1], axis=1).sum(1)
            lcp = np.append(0, np.where(tree[1:] == tree[:-1], same, 0))
            region, crowded = regions(lcp, depth=depth)
            low, high = [], []
            for gap in range(1, len(rows)):
                meet = region[gap:] == region[:-gap]
                if gap <= NEAR:
                    shared = lcp[gap:]
                    for k in range(1, gap):
                        shared = np.minimum(shared, lcp[gap - k:len(lcp) - k])
                    meet = meet | (shared >= BASE)
                elif not meet.any():
                    break
                i = np.flatnonzero(meet)
                i = i[ids[i] != ids[i + gap]]
                for k in range(0, len(i), 100_000):
                    part = i[k:k + 100_000]
                    part = part[likely(sketch[part], n[part], sketch[part + gap], n[part + gap], similar)]
                    low.append(part)
                    high.append(part + gap)
            low, high = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (low, high))
            first = spanning(ids[low], ids[high])
            again = crowded.copy()
            again[low[~first]] = again[high[~first]] = True
            x, y = ids[low[first]], ids[high[first]]
            pairs = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "region": None, "n": 0, "sketch": None})
            full = rows[again]
            crowd = pd.DataFrame({
                "a": full["doc_id"], "b": full["doc_id"],
                "region": [bytes([t]) + k[:2 * BASE] for t, k in zip(full["tree"], full["key"])],
                "n": full["n"], "sketch": full["sketch"]})
            return pd.concat([pairs.astype(object), crowd.astype(object)], ignore_index=True)

        # a partition is worked off in runs of whole base prefixes
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= 50_000:
                rows = pd.concat(held, ignore_index=True)
                prefix = rows["key"].str.slice(0, 2 * BASE)
                change = np.flatnonzero(((prefix != prefix.shift()) | (rows["tree"] != rows["tree"].shift())).to_numpy())
                cut = int(change[-1])
                if cut:
                    yield work(rows.iloc[:cut])
                    rows = rows.iloc[cut:]
                held, size = [rows], len(rows) if cut else 0
        if held:
            yield work(pd.concat(held, ignore_index=True))

    planted = classes.mapInPandas(plant, "tree int, key binary, doc_id bigint, n bigint, sketch binary")
    ordered = planted.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    return ordered.mapInPandas(compare, "a bigint, b bigint, region binary, n bigint, sketch binary")


def confirm(pairs: DataFrame, docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Only the texts in question are read again."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    @F.pandas_udf("binary")
    def full(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Words()
        for series in texts:
            if len(known) > 500_000:
                known.clear()
            yield pd.Series([shingles(t, known).tobytes() for t in series], dtype=object)

    @F.pandas_udf("boolean")
    def enough(one: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(one, other):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= similar * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(asked, "doc_id", "left_semi")
    sets = stage(texts.select("doc_id", full("text").alias("set")).distinct(), "sets")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return stage(both.where(enough("set_a", "set_b")).select("a", "b").distinct(), "links")


def second_look(crowd: DataFrame, component: DataFrame, similar: int = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Candidates of regions with more than one component, between these. Rows are sorted by component and cut
    into blocks; blocks of one and the same component are not compared with each other."""
    named = crowd.select("region", F.col("a").alias("doc_id"), "n", "sketch").join(component, "doc_id")
    mixed = named.groupBy("region").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where(
        "_low < _high").select("region")
    rows = named.join(mixed, "region", "left_semi").dropDuplicates(["region", "doc_id"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for region, part in batch.groupby("region", sort=False):
                for low in range(0, len(part), block):
                    b = part.iloc[low:low + block]
                    yield pd.DataFrame({
                        "region": [region], "place": [hashlib.blake2b(
                            b["doc_id"].to_numpy().tobytes(), digest_size=8).hexdigest()],
                        "low": [b["component"].min()], "high": [b["component"].max()],
                        "ids": [b["doc_id"].to_numpy(np.int64).tobytes()],
                        "sizes": [b["n"].to_numpy(np.int64).tobytes()],
                        "components": [b["component"].to_numpy(np.int64).tobytes()],
                        "sketches": [b"".join(b["sketch"])]})

    ordered = rows.repartitionByRange("region", "component", "doc_id").sortWithinPartitions(
        "region", "component", "doc_id").select("region", "doc_id", "n", "sketch", "component")
    names = ["region", "place", "low", "high", "ids", "sizes", "components", "sketches"]
    blocks = stage(ordered.mapInPandas(
        cut, "region binary, place string, low bigint, high bigint, ids binary, sizes binary, components binary, "
             "sketches binary"), "blocks")
    one, other = (blocks.select("region", *[F.col(c).alias(f"{c}_{side}") for c in names[1:]]) for side in "xy")
    meet = one.join(other, "region").where(
        "place_x <= place_y and not (low_x = high_x and low_y = high_y and low_x = low_y)")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, n, comp = ([np.frombuffer(getattr(r, f"{c}_{s}"), np.int64) for s in "xy"]
                                for c in ("ids", "sizes", "components"))
                sk = [np.frombuffer(getattr(r, f"sketches_{s}"), np.uint8).reshape(len(i), -1)
                      for s, i in zip("xy", ids)]
                for k in range(len(ids[0])):
                    apart = np.flatnonzero(comp[1] != comp[0][k])
                    ok = apart[likely(sk[0][k][None], n[0][k], sk[1][apart], n[1][apart], similar)]
                    if len(ok):
                        yield pd.DataFrame({"a": np.minimum(ids[0][k], ids[1][ok]),
                                            "b": np.maximum(ids[0][k], ids[1][ok])})

    return meet.mapInPandas(compare, "a bigint, b bigint").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links) and kept.

    Null and empty texts and texts of white space have no shingles and are linked with nothing; a row with a null
    id is linked with nothing, has no component and is kept. Rows that share an id are one document, linked by
    any of its texts. Other columns are not read.
    """
    hashed = stage(with_hashes(docs), "minhashes")
    known = hashed.where("digest is not null and doc_id is not null")
    heads = stage(known.groupBy("digest").agg(F.min("doc_id").alias("head")), "heads")
    classes = stage(known.join(heads, (F.col("doc_id") == F.col("head")) & (known["digest"] == heads["digest"]),
                               "left_semi").select("doc_id", "n_shingles", "hashes", "counts").dropDuplicates(), "classes")
    planted = stage(forest(classes, similar=similar), "forest")
    pairs = stage(planted.where("region is null").select("a", "b").distinct(), "candidates")
    links = confirm(pairs, docs, similar)
    # a document that heads several classes or lies in another's class links them
    same = known.join(heads, "digest").where("doc_id <> head").select(
        F.col("head").alias("a"), F.col("doc_id").alias("b"))
    members = stage(same.distinct(), "members")
    shared = members.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("b")
    heading = classes.select(F.col("doc_id").alias("b")).distinct()
    # only members with ties of their own need to be nodes
    ties = members.join(shared, "b", "left_semi").unionByName(members.join(heading, "b", "left_semi"))
    edges = links.unionByName(ties).distinct()
    nodes = classes.select(F.col("doc_id").alias("node")).distinct()
    component = stage(connected_components(nodes, edges, []), "component").select(
        F.col("node").alias("doc_id"), "component")
    crowd = planted.where("region is not null")
    if not crowd.isEmpty():
        more = confirm(stage(second_look(crowd, component, similar), "candidates"), docs, similar)
        if not more.isEmpty():
            component = stage(connected_components(nodes, edges.unionByName(more), []), "component").select(
                F.col("node").alias("doc_id"), "component")
    named = heads.join(component.withColumnRenamed("doc_id", "head"), "head").select("digest", "component")
    out = hashed.join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
