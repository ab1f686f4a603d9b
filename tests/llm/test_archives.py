"""Web archives: round trip, revisits, index lookups."""

import base64
import gzip
import hashlib
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from sealwright.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, key string"
ROWS = [(1, None, None), (2, "http://A.b:80/x?y#z", "é"), (None, "u", "é"), (3, "u\tv\n\\n", "é"), (3, "u\tv\n\\n", "é"),
        (None, None, None), (4, "http://e/", "q" * 300_000), (5, "http://e/", "one"), (5, "http://e/", "two")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_table_round_trip(spark):
    got = queries.op6_warc_index(spark, "/root/testdata/sf0.01").toPandas().sort_values("page_id", ignore_index=True)
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").sort_values("page_id", ignore_index=True)
    assert got["page_id"].tolist() == pages["page_id"].tolist()
    assert got["payload_digest"].tolist() == [digest(h) for h in pages["html"]]
    assert got["payload_bytes"].tolist() == [len((h or "").encode()) for h in pages["html"]]
    first = pages.groupby(got["payload_digest"])["page_id"].transform("min")
    assert (got["record_type"] == (pages["page_id"] == first).map({True: "response", False: "revisit"})).all()
    assert got["refers_to"].dropna().tolist() == first[pages["page_id"] != first].tolist()


def test_odd_rows_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "k") for r in ROWS], SCHEMA)
    got = warc.archive_pages(pages, str(tmp_path / "a"), with_payload=True).collect()
    seen = sorted(((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    want = sorted(((i or 0, digest(h), *(("response", None) if first[digest(h)] == i else ("revisit", first[digest(h)])))
                   for i, _, h in ROWS), key=str)
    assert seen == want
    assert sorted(bytes(r.payload).decode() for r in got if r.record_type == "response") == sorted(
        (h or "") for i, _, h in ROWS if first[digest(h)] == i)
    # any reader of the format finds the same number of records
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "a").glob("*.warc.gz"))
    assert len(re.findall(rb"^WARC/1.1\r\nWARC-Type: (?:response|revisit)\r", raw, re.M)) == len(ROWS)
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = warc.archive_pages(spark.createDataFrame([(*r, "k") for r in ROWS], SCHEMA), str(tmp_path), least=2).toPandas()
    assert got[got["payload_bytes"] < 2]["record_type"].eq("response").all()
    assert got[got["payload_bytes"] == 2]["record_type"].eq("revisit").sum() == 3


def test_keys(spark):
    rows = [("https://WWW.Example.org/a/B?q#f",), ("http://h.x:8080/p",), ("plain",), (None,), ("",)]
    got = spark.createDataFrame(rows, "url string").select(warc.url_key()).collect()
    assert [r[0] for r in got] == ["org,example,www)/a/B?q", "x,h):8080/p", "plain)", "", ")"]


def test_lookup_reads_few_blocks(spark, tmp_path):
    captures = spark.range(5_000).select(
        F.concat(F.lit("k"), F.lpad((F.col("id") % 700).cast("string"), 4, "0")).alias("key"), (F.col("id") % 900).alias("page_id"),
        F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(1).cast("bigint").alias("length"))
    upper = warc.build_index(captures, str(tmp_path), block_lines=16, shard_lines=900)
    assert upper == sorted(upper) and len(upper) > 1
    rows = captures.toPandas()
    index = warc.Index(str(tmp_path), upper)
    for key, page in [("k0000", 0), ("k0699", 699), ("k0350", 150), ("k0350", 151), ("a", 1), ("z", 1)]:
        want = rows[(rows["key"] == key) & (rows["page_id"] == page)]["offset"]
        before = index.blocks_read
        assert sorted(f[3] for f in index.find((key.encode(), page))) == sorted(want)
        assert index.blocks_read - before <= 3
    wanted = captures.select("key", "page_id").where("page_id % 7 = 0")
    assert warc.look_up(wanted, str(tmp_path), upper).count() == wanted.count()
    # one key that runs through several blocks and shards
    same = spark.range(200).select(F.lit("s").alias("key"), F.lit(1).cast("bigint").alias("page_id"), F.lit("f").alias("file"),
                                   F.col("id").alias("offset"), F.lit(1).cast("bigint").alias("length"))
    many = warc.Index(str(tmp_path / "s"), warc.build_index(same, str(tmp_path / "s"), 16, 50))
    assert len(many.find((b"s", 1))) == 200
