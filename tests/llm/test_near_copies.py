"""MinHash forest against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from sealwright.llm import lshforest as lf, queries

SCHEMA = "doc_id bigint, text string, kept string, digest int"


def brute(rows, similar=85):
    """Component of every id by comparing all pairs of word-shingle sets."""
    sets = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((i, {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    up = {i: i for i, _ in rows if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= similar * len(s | t):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in lf.near_duplicates(docs).collect()]
    want = [(i, n, c, i is None or i == c) for i, n, c in brute(rows)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def vary(words, share, rng):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in words)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    check(spark, [(9, None), (8, ""), (7, " \n"), (6, "a b"), (5, "A  B"), (4, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"),
                  (None, "a b c d e"), (None, None), (2, long), (1, long + " end"), (10, "É b"), (11, "é b")])


def test_one_id_with_several_texts_links_them(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(50)) for c in "xy")
    check(spark, [(5, one), (5, other), (7, one), (9, other), (3, other), (4, one)])


def test_empty_table(spark):
    assert lf.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_families(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(40):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 8)):
            rows.append((i, vary(words, rng.choice([0, 0.005, 0.02, 0.03, 0.1]), rng)))
            i += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_crowded_star(spark, monkeypatch):
    """Many variants that resemble one text but hardly each other: only the second look can join them all."""
    rng = random.Random(8)
    words = [f"s{k}" for k in range(400)]
    rows = [(1000, " ".join(words))]
    for i in range(300):
        own = list(words)
        for k in rng.sample(range(0, 400, 8), 6):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(lf, "FEW", 8)
    check(spark, rows)


@pytest.mark.parametrize("few", [2, 5, 64])
def test_regions_hold_all_or_grow(few):
    rng = np.random.default_rng(few)
    keys = np.sort(rng.integers(0, 3, (500, 6)).astype(">u2").view("S12").ravel()).view(">u2").reshape(500, 6)
    same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(1)
    region, crowded = lf.regions(np.append(0, same), base=2, depth=6, few=few)
    sizes = pd.Series(region).value_counts()
    assert sizes.max() <= few
    base = pd.Series([k[:2].tobytes() for k in keys])
    count = base.map(base.value_counts()).to_numpy()
    assert (crowded == (count > few)).all()
    for b in base[~crowded].unique():
        assert len(set(region[(base == b).to_numpy()])) == 1


def test_table(spark):
    got = queries.op2_lsh_forest(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    want = brute(list(zip(docs["doc_id"], docs["text"])))
    assert list(zip(got["doc_id"], got["n_shingles"], got["component_id"])) == want
