"""No rows lost: null keys, twins, childless parents, large pages, rejected orders."""

import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealwright import session
from sealwright.operators import apidumps as api, chains, entitlements as ent, ordered, pages as pg
from sealwright.schemas import API_DUMPS
from sealwright.sources import manifests


def test_null_keys_and_orders_keep_their_rows(spark):
    rows = [("a", 1, 5), (None, 1, 7), (None, 2, 8), ("a", None, 9), ("a", 2, 6)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").withColumn("b", ordered.bucket_of(F.col("o"), 2))
    out = ordered.prefix_scan(df, ["k"], "b", "o", [ordered.Running("s", "sum", F.col("v"))]).collect()
    got = {(r.k, r.o): r.s for r in out}
    assert len(out) == 5 and got[None, 2] == 15 and got["a", 2] == 20 and got["a", None] == 9
    seen = spark.createDataFrame([(None, 1, 100), ("x", 1, 100), ("x", None, 100)], "install_id string, arrival bigint, observed_ms bigint")
    assert ent.trial_clock(seen).count() == 3


@pytest.mark.parametrize("segment_rows", [2, 1000])
def test_chains_refuse_orders_they_cannot_follow(spark, segment_rows):
    base = "case_id string, id bigint, ts bigint, operator string, action string, path string, sha256 string"
    row = ("c", 1, 1, "o", "a", "p", "s")
    for bad in [("c", None, *row[2:]), (None, 2, *row[2:])]:
        for build in (chains.build_pipe, chains.chain_fold):
            with pytest.raises(Exception, match="a chain row has no"):
                build(spark.createDataFrame([row, bad, ("c", 3, *row[2:]), ("c", 4, *row[2:])], base), segment_rows=segment_rows).collect()
    text = spark.createDataFrame([row], base).withColumn("id", F.col("id").cast("string"))
    with pytest.raises(TypeError, match="integer order"):
        chains.build_pipe(text, segment_rows=segment_rows)


def test_twins_of_one_batch_are_refused(spark, tmp_path):
    path = str(tmp_path / "m")
    schema = "case_id string, relative_path string, size bigint"
    spark.createDataFrame([("c", "old", 1)], schema).write.parquet(path)
    offered = spark.createDataFrame([("c", "old", 2), ("c", "new", 9), ("c", "new", 3), (None, "new", 4)], schema)
    refused = manifests.append_new(offered, path, ["case_id", "relative_path"])
    assert sorted(r.size for r in refused.collect()) == [2, 9]
    assert sorted(r.size for r in spark.read.parquet(path).collect()) == [1, 3, 4]
    again = manifests.append_new(offered, path, ["case_id", "relative_path"])
    assert again.count() == 4 and spark.read.parquet(path).count() == 3


def dump(spark, kind, rows):
    return spark.createDataFrame(rows, API_DUMPS[kind])


def test_parents_without_children_stay(spark):
    pull = lambda n: {"number": n, "title": f"t{n}", "head": {"ref": "b", "sha": f"s{n}"}, "base": {"ref": "main"},
                      "labels": [{"name": "l"}], "mergeable": True, "html_url": "u"}
    pulls = dump(spark, "pulls", [pull(1), pull(2), pull(3), pull(4)])
    reviews = dump(spark, "reviews", [{"number": 1, "state": "APPROVED"}, {"number": 3, "state": "COMMENTED"}])
    checks = dump(spark, "checks", [{"head_sha": "s2", "name": "c", "status": "queued"}, {"head_sha": "s3", "name": "c", "conclusion": "x"}])
    got = sorted((r.number, r.item or "-", r.item_state or "-", r.base, r.url) for r in api.pr_detail(pulls, reviews, checks).collect())
    assert got == [(1, "review", "APPROVED", "main", "u"), (2, "check", "queued", "main", "u"), (3, "check", "x", "main", "u"),
                   (3, "review", "COMMENTED", "main", "u"), (4, "-", "-", "main", "u")]
    runs = dump(spark, "runs", [{"id": 1, "head_sha": "abc"}, {"id": 2, "head_sha": "def"}])
    jobs = dump(spark, "jobs", [{"run_id": 1, "name": "j", "steps": []}])
    assert sorted((r.id, r.job) for r in api.run_detail(runs, jobs).collect()) == [(1, "j"), (2, None)]
    repos = dump(spark, "repos", [{"full_name": "a", "description": "d", "forks_count": 3}, {"full_name": "b"}])
    languages = dump(spark, "languages", [{"full_name": "a", "languages": {"Rust": 7}}])
    rows = api.repo_languages(repos, languages).collect()
    assert sorted((r.full_name, r.language, r.forks) for r in rows) == [("a", "Rust", 3), ("b", None, None)]


@pytest.mark.parametrize("mode", ["gutter_first", "widest"])
def test_pages_cut_over_the_cluster_read_the_same(spark, mode):
    rng = np.random.default_rng(5)
    rows = {("big", *(int(v) for v in (rng.integers(0, 3000), rng.integers(0, 3000)))): (int(rng.integers(1, 40)), int(rng.integers(1, 12)))
            for _ in range(400)}
    rows |= {("small", int(x), int(y)): (5, 5) for x, y in rng.integers(0, 60, (40, 2))}
    blocks = spark.createDataFrame([(p, x, y, *size) for (p, x, y), size in rows.items()], "page_id string, x int, y int, w int, h int")
    whole = {(r.page_id, r.x, r.y): r.order for r in pg.reading_order(blocks, mode, 5).collect()}
    cut = {(r.page_id, r.x, r.y): r.order for r in pg.reading_order(blocks, mode, 5, group_rows=60, levels=6).collect()}
    assert cut == whole and len(cut) == len(rows)
    # a stretch of a page is no unit of its own
    by_page = {(r.page_id, r.x, r.y): r.order for r in pg.naive_order(blocks).collect()}
    for page in ("big", "small"):
        mine = [k for k in rows if k[0] == page]
        assert [by_page[k] for k in sorted(mine, key=lambda k: (k[2], k[1]))] == list(range(len(mine)))


def test_clusters_must_name_a_shared_folder(spark):
    def asked(master, configured=None):
        return session.shared_root(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: configured),
                                                         sparkContext=types.SimpleNamespace(master=master)))

    assert asked("spark://host:7077", "s3a://b/x/") == "s3a://b/x"
    assert asked("local[4]") == asked("local")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            asked(master)


@pytest.mark.parametrize("group_rows", [3, 1000])
def test_null_pages_and_large_page_numbers_are_pages_like_others(spark, group_rows):
    boxes = [(0, 0, 10, 10), (0, 20, 10, 10), (0, 40, 10, 10), (20, 0, 10, 10), (20, 20, 10, 10)]
    pages = [None, 2 ** 53 + 1, 2 ** 53 + 2, 7]
    blocks = spark.createDataFrame([(p, *b) for p in pages for b in boxes], "page_id bigint, x int, y int, w int, h int")
    for mode in ("gutter_first", "widest"):
        got = {}
        for r in pg.reading_order(blocks, mode, 5, group_rows=group_rows).collect():
            got.setdefault(r.page_id, []).append((r.order, r.x, r.y))
        assert set(got) == set(pages)
        assert all(sorted(v) == sorted(got[7]) and [o for o, *_ in sorted(v)] == list(range(5)) for v in got.values())
    spans = blocks.select("page_id", "y", F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
    found = {}
    for r in pg.regions(spans, band_rows=16).collect():
        found.setdefault(r.page_id, []).append((r.x, r.y, r.w, r.h, r.area))
    assert set(found) == set(pages) and all(sorted(v) == sorted(found[7]) and len(v) == 5 for v in found.values())
    dots = blocks.select("page_id", "x", "y")
    assert {(r.page_id, r.ink) for r in pg.block_density(blocks, dots, 8).collect()} == {(p, 1) for p in pages}
