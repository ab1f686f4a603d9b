"""Inventory, names and content rules on small fixtures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sealwright.functions import files as fx
from sealwright.operators import inventory as inv
from sealwright.sources import evidence as src


def values(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_claimed_extension(spark):
    names = ["report.PDF", ".bashrc", "a.tar.gz", "foo.", "dir.d/plain", "x/.hidden", "..foo", "É.TXT"]
    got = values(spark, [(n,) for n in names], "n string", e=fx.claimed_extension(F.col("n")))
    assert [g[0] for g in got] == ["pdf", "", "gz", "", "", "", "foo", "txt"]


def test_magic_hint(spark):
    samples = [b"", b"hello world", b"%PDF-1.7 rest", b"#!/bin/sh\n", b"\x89PNG\r\n\x1a\n....", b"PK\x03\x04zz", b"\xff\xd8\xff\xe0",
               b"\x7fELF\x02", b"\x00\x01\x02\x03", b"tab\tand\x0bvt", b"\xff\xd8"]
    got = values(spark, [(bytearray(s),) for s in samples], "c binary", m=fx.magic_hint(F.col("c")))
    assert [g[0] for g in got] == ["text", "text", "pdf", "script", "png", "zip-family", "jpeg", "elf", "unknown", "text", "jpeg"]


def test_text_rule_is_integer_division(spark):
    def slow(data):
        data = data[:512]
        return not data or sum(0x21 <= b <= 0x7e or b in (32, 9, 10, 12, 13) for b in data) * 100 // len(data) >= 85
    rng = random.Random(5)
    samples = [bytes(rng.choice([65, 32, 10, 11, 0, 200] if rng.random() < 0.2 else [66, 32]) for _ in range(rng.randint(0, 700)))
               for _ in range(200)]
    got = values(spark, [(bytearray(s),) for s in samples], "c binary", t=fx.looks_like_text(F.col("c")))
    assert [g[0] for g in got] == [slow(s) for s in samples]


def test_formats_and_video(spark):
    samples = [b"BM" + b"\0" * 24, b"BM" + b"\0" * 23, b"RIFF....WEBP", b"RIFF....AVI ", b"....ftypheic", b"....ftypisom",
               b"\x1a\x45\xdf\xa3", b"\xff\xd8\xff", b"\xff\xd8\x00", b"II*\0", b"GIF89a"]
    got = values(spark, [(bytearray(s),) for s in samples], "c binary", page=fx.image_format(F.col("c"), "page"),
                 photo=fx.image_format(F.col("c"), "photo"), intake=fx.image_format(F.col("c"), "intake"),
                 video=fx.video_kind(F.col("c")), heif=fx.is_heif(F.col("c")))
    assert [g[0] for g in got] == ["bmp", None, "webp", None, None, None, None, "jpeg", None, "tiff", None]
    assert [g[1] for g in got] == ["bmp", "bmp", None, None, None, None, None, "jpeg", None, "tiff", None]
    assert [g[2] for g in got][7:9] == ["jpeg", "jpeg"]
    assert [g[3] for g in got] == [None, None, None, ".avi", None, ".mp4", ".webm", None, None, None, None]
    assert [g[4] for g in got].index(True) == 4 and sum(g[4] for g in got) == 1


def test_png_dimensions(spark):
    head = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"
    samples = [head + (70000).to_bytes(4, "big") + (3).to_bytes(4, "big"), head, b"\x89PNG\r\n\x1a\n" + b"x" * 30]
    got = values(spark, [(bytearray(s),) for s in samples], "c binary", d=fx.png_dimensions(F.col("c")))
    assert [g[0] and tuple(g[0]) for g in got] == [(70000, 3), None, None]


def test_paths(spark):
    paths = ["/r/a/b.txt", "/r/../x", "/r/a/../../x", "/r/a/../b", "/other/x", "/r/./a//b", "/rr/x"]
    got = values(spark, [(p, "/r") for p in paths], "p string, r string", e=fx.escapes_root(F.col("p"), F.col("r")))
    assert [g[0] for g in got] == [False, True, True, False, True, False, True]
    got = values(spark, [("/r/a\\b/c", "/r")], "p string, r string", e=fx.relative_path(F.col("p"), F.col("r")))
    assert got == [("a/b/c",)]


def test_safe_name(spark):
    names = ["/x/März page.png", "...", "_._", "a" * 90, "ok-1.2_b"]
    got = values(spark, [(n,) for n in names], "n string", s=fx.safe_name(F.col("n")))
    assert [g[0] for g in got] == ["M_rz_page.png", "evidence", "evidence", "a" * 80, "ok-1.2_b"]


def test_exhibit_names_differ(spark):
    df = spark.range(50).select(fx.exhibit_name(F.lit("ab" * 32)).alias("n"))
    names = [r.n for r in df.collect()]
    assert len(set(names)) > 45 and all(n.startswith("evidence-abababababababab-") and n.endswith(".arcr") for n in names)


def inventory(spark):
    rows = [("k", "/r", "/r/a.txt", "file", b"note"), ("k", "/r", "/r/b.txt", "file", b"note"),
            ("k", "/r", "/r/c.bin", "file", b"x" * 100), ("k", "/r", "/r/link", "symlink", b""), ("k", "/r", "/r/d", "dir", b""),
            ("k", "/r", "/r/fifo", "special", b""), ("k", "/r", "/r/err", "error", b""), ("k", "/r", "/o/x", "file", b"1"),
            ("k", "/r", "/r/edge", "file", b"y" * 99)]
    df = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows],
                               "case_id string, root string, path string, file_kind string, content binary")
    return df.withColumn("length", F.length("content").cast("bigint"))


def test_acquire_skips_and_duplicates(spark):
    inven = inventory(spark)
    got = {r.relative_path: r for r in inv.acquire(inven, 99).collect()}
    assert set(got) == {"a.txt", "b.txt", "edge"}
    digest = hashlib.sha256(b"note").hexdigest()
    assert got["a.txt"].vault_relpath == f"vault/{digest}.arcv" and got["a.txt"].size_bytes == 4
    skips = {r.reason: r.files for r in inv.skip_summary(inven, 99).collect()}
    assert skips == {"symlink": 1, "special": 1, "walk_error": 1, "outside_root": 1, "oversized": 1}
    dup = inv.duplicate_content(inv.acquire(inven, 99)).collect()
    assert [(r.sha256, r.exhibits) for r in dup] == [(digest, 2)]
    assert inv.over_cap(inven, max_files=5).count() == 0 and inv.over_cap(inven, max_files=4).count() == 1


@pytest.mark.parametrize("seed", range(6))
def test_output_names_are_free_and_smallest(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "b", "a-1", "a-2", "c", "c-1-1", "c-1", "d-01", "d", "e-0", "e"][: 4 + seed * 2]
    inputs = [(f"p{i:03d}", rng.choice(pool)) for i in range(60)]
    existing = {rng.choice(pool) + rng.choice(["", "-1", "-3", "-2", "-7"]) for _ in range(8)}
    df = inv.assign_names(spark.createDataFrame([(n, p) for p, n in inputs], "name string, path string"),
                          spark.createDataFrame([(e,) for e in existing], "name string"))
    given = {r.path: r.stem for r in df.collect()}
    assert len(set(given.values())) == len(inputs) and not set(given.values()) & existing
    for path, name in inputs:
        gone = existing | {given[other] for other, _ in inputs if other < path}
        # the bare name if it was free, else the smallest number that was
        choices = [name, *(f"{name}-{n}" for n in range(1, len(inputs) + len(existing) + 1))]
        assert given[path] == next(c for c in choices if c not in gone)


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.PNG").write_bytes(b"1")
    (tmp_path / "a.txt").write_bytes(b"22")
    (tmp_path / "sub" / "c.jpg").write_bytes(b"333")
    every = src.scan_evidence(spark, str(tmp_path))
    assert [r.name for r in src.in_name_order(every).collect()] == ["a.txt", "b.PNG", "c.jpg"]
    images = src.scan_evidence(spark, str(tmp_path), exts=["png", ".jpg"])
    assert {r.name for r in images.collect()} == {"b.PNG", "c.jpg"}
    assert src.scan_evidence(spark, str(tmp_path), recursive=False).count() == 2
    small = src.scan_evidence(spark, str(tmp_path), max_bytes=1).select("path")
    assert [r.path.rsplit("/", 1)[1] for r in small.collect()] == ["b.PNG"]
    plan = small._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "LessThanOrEqual(length,1)" in plan and "content" not in plan.split("ReadSchema")[1]
    listing = src.list_vaults(every, prefix=f"file:{tmp_path}", suffix=".jpg")
    assert src.vault_totals(listing).first().total_bytes == 3
