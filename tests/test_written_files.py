"""Files that queries write before they read them: one per row by tasks, text compressed and bounded."""

import os

import pytest
from pyspark.sql import functions as F

from sealwright.plans import evidence as pev, live, tables as t
from sealwright.sources import ledgers as src, walk
from sealwright.sources.ledger_store import LedgerStore
from sealwright.streaming import intake


def _found(root):
    return {os.path.relpath(os.path.join(at, n), root): open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(root) for n in names}


def test_one_file_per_row_dealt_over_tasks(spark, tmp_path):
    root = str(tmp_path / "files")
    rows = spark.range(0, 300, 1, 1).select(F.concat(F.lit("n="), F.col("id"), F.lit("/a.txt")).alias("path"), F.concat(F.lit("ü"), F.col("id")).alias("content"))
    for _ in range(2):  # writing them again changes nothing
        assert walk.write_files(rows, root) == 300
        assert _found(root) == {f"n={i}/a.txt": f"ü{i}".encode() for i in range(300)}
    assert os.listdir(f"{root}.partial") == []
    assert walk.write_files(rows.limit(0), str(tmp_path / "none")) == 0


def test_a_failed_task_leaves_no_part_of_a_file(spark, tmp_path):
    root = tmp_path / "files"
    (root / "taken").mkdir(parents=True)
    rows = spark.createDataFrame([("taken", b"x")], "path string, content binary")
    with pytest.raises(Exception):
        walk.write_files(rows, str(root))
    assert _found(root) == {}


def test_json_is_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "TEXT_FILE_ROWS", 100)
    path = str(tmp_path / "json")
    t.packed(spark.range(0, 1000, 1, 2).select("id", F.lit("same " * 50).alias("text"))).json(path)
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(names) == 10 and all(n.endswith(".json.gz") for n in names)
    assert sum(os.path.getsize(f"{path}/{n}") for n in names) < 50_000
    assert spark.read.schema("id bigint, text string").json(path).agg(F.sum("id")).first()[0] == 499500


def test_ledger_lines_are_compressed_and_keep_their_order(spark, tmp_path):
    events = spark.range(1, 31).select(F.lit("c").alias("case_id"), F.col("id").alias("n"), F.lit("note").alias("event"), F.lit("t").alias("ts"), F.lit("{}").alias("data"))
    path = str(tmp_path / "ledger")
    src.write_ledger_jsonl(src.append_jsonl(events, "n"), path, file_rows=7)
    names = [n for n in _found(path) if "part-" in n and not n.endswith(".crc")]
    assert len(names) == 5 and all(n.endswith(".txt.gz") for n in names)
    lines = src.with_line_numbers(src.read_ledger_jsonl(spark, path))
    assert [(r["line_no"], r["seq"]) for r in lines.select("line_no", "seq").orderBy("line_no").collect()] == [(i, i) for i in range(1, 31)]


def test_intake_batches_do_not_grow_in_number(spark, tmp_path, monkeypatch):
    seen = []
    kept = intake.watch_folder
    monkeypatch.setattr(intake, "watch_folder", lambda s, root, most: seen.append(most) or kept(s, root, most))
    monkeypatch.setattr(live, "INTAKE_BATCHES", 2)
    spark.range(500).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), F.col("id")).alias("s_name")).write.parquet(str(tmp_path / "supplier.parquet"))
    assert live.intake_folder(spark, str(tmp_path)).count() == 500
    assert seen == [250, 250]


def test_supplier_files_have_one_line_each(spark, tmp_path):
    pev._line_files(spark.createDataFrame([(1, 2, "x")], "a int, b int, c string"), str(tmp_path / "f"), "a", "b", line=F.col("c"))
    assert _found(tmp_path / "f") == {"a=1/b=2/line.txt": b"x\n"}


def test_path_patterns_are_tried_once_per_line(spark, tmp_path):
    """An unanchored pattern that begins with .* is tried again at every character of a path it does not fit."""
    events = spark.range(1, 5).select(F.lit("c").alias("case_id"), F.col("id").alias("n"), F.lit("note").alias("event"), F.lit("t").alias("ts"), F.lit("{}").alias("data"))
    base = str(tmp_path / "base")
    src.write_ledger_jsonl(src.append_jsonl(events, "n"), base)
    store = LedgerStore(spark, str(tmp_path / "store"), "jsonl", base)
    store.append(events.withColumn("n", F.col("n") + 4), 1, "n")
    rows = store.rows()
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "/batches/" in plan and "/case_id=" in plan and ", .*/" not in plan
    assert [r["seq"] for r in rows.orderBy("chunk", "line_pos").select("seq").collect()] == list(range(1, 9))
