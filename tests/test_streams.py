"""Streaming operators over several micro-batches."""

import json

from pyspark.sql import Row, functions as F

from sealwright.operators import entitlements as ent
from sealwright.sources.checkout import read_checkout_events
from sealwright.streaming import entitlements as sent, intake, ledgers as sled
from sealwright.streaming.runtime import drain
from test_chains import canonical, chain, edit, lines
from test_entitlements import DAY, S, T0, event, plans


def segments(spark, tmp_path, name, frames, schema):
    """One file per segment, read one per micro-batch in the order written."""
    path = str(tmp_path / name)
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


LEDGER = "case_id string, id bigint, ts bigint, operator string, action string, path string, sha256 string, prev_hash string, entry_hash string"


def test_live_verification_across_batches(spark, tmp_path):
    good = chain("good", 9)
    bad = [("bad", *r[1:]) for r in edit(good, 4)]
    frames = [good[:3] + bad[:3], good[3:6] + bad[3:6], good[6:] + bad[6:]]
    stream = segments(spark, tmp_path, "in", frames, LEDGER)
    out = spark.read.parquet(drain(sled.verify_stream(stream), "v", str(tmp_path / "out"), str(tmp_path / "cp"))).collect()
    assert len(out) == 6
    rows = sorted((r.case_id, r.seen, r.valid_prefix, r.chain_ok, r.broken_at, r.alert) for r in out)
    assert rows == [("bad", 3, 3, True, None, False), ("bad", 6, 4, False, 5, True), ("bad", 9, 4, False, 5, False),
                    ("good", 3, 3, True, None, False), ("good", 6, 6, True, None, False), ("good", 9, 9, True, None, False)]
    last = {r.case_id: r.tip for r in sled.latest_verdicts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert last["good"] == good[-1][8] and last["bad"] == good[3][8]


def test_live_append_equals_batch_build(spark, tmp_path):
    rows = chain("a", 8)
    bare = [r[:7] for r in rows]
    schema = LEDGER.split(", prev_hash")[0]
    stream = segments(spark, tmp_path, "in", [bare[:3], bare[3:5][::-1], bare[5:]], schema)
    out = spark.read.parquet(drain(sled.append_stream(stream), "a", str(tmp_path / "out"), str(tmp_path / "cp"))).orderBy("seq").collect()
    assert [(r.seq, r.prev_hash, r.entry_hash) for r in out] == [(r[1], r[7], r[8]) for r in rows]


def test_live_jsonl_lines(spark, tmp_path):
    want = lines(5, lambda i: {"i": i, "name": "é"})
    rows = [("c", e["seq"] * 10, "note", canonical(e["data"]), e["ts"]) for e in want]
    stream = segments(spark, tmp_path, "in", [rows[:2], rows[2:]], "case_id string, id bigint, event string, data string, ts string")
    out = spark.read.parquet(drain(sled.append_stream(stream, dialect="jsonl"), "j", str(tmp_path / "out"), str(tmp_path / "cp")))
    assert [r.line for r in out.orderBy("seq").collect()] == [canonical(e) for e in want]


def test_trial_clock_across_batches(spark, tmp_path):
    schema = "install_id string, arrival bigint, observed_ms bigint"
    frames = [[("a", 1, T0), ("b", 2, T0)], [("a", 3, T0 + 200 * DAY)], [("a", 4, T0 + 10 * DAY), ("b", 5, T0 + DAY)]]
    stream = segments(spark, tmp_path, "in", frames, schema)
    out = spark.read.parquet(drain(sent.trial_stream(stream), "t", str(tmp_path / "out"), str(tmp_path / "cp"))).collect()
    assert sorted((r.install_id, r.last_seen_ms, r.active) for r in out) == sorted([
        ("a", T0, True), ("b", T0, True), ("a", T0 + 200 * DAY, False), ("a", T0 + 200 * DAY, False), ("b", T0 + DAY, True)])


def test_retries_issue_one_licence(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for i, batch in enumerate([[event(S + "1"), event(S + "2", "unpaid")], [event(S + "1", at=3)], [event(S + "2", at=4), event(S + "1", at=9)]]):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
    stream = read_checkout_events(spark, str(folder), stream=True, max_files_per_trigger=1)
    path = drain(sent.issue_licenses(stream, plans(spark), "pw"), "l", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.order for r in spark.read.parquet(path).collect()) == [S + "1", S + "2"]


def test_late_sessions_get_their_licence(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for i, e in enumerate([event(S + "1", at=200), event(S + "2", at=199), event(S + "3", at=40), event(S + "3", at=10)]):
        (folder / f"{i}.json").write_text(json.dumps(e))
    stream = read_checkout_events(spark, str(folder), stream=True, max_files_per_trigger=1)
    path = drain(sent.issue_licenses(stream, plans(spark), "pw"), "l", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.order for r in spark.read.parquet(path).collect()) == [S + "1", S + "2", S + "3"]


def test_stale_events_are_dropped(spark, tmp_path):
    rows = [("2026-01-01T00:00:00Z", f"t={1767225600 + d},v1=a", "x") for d in (-301, -300, 0, 300, 301)]
    df = spark.createDataFrame(rows, "r string, signature_header string, type string").withColumn("recv_ts", F.col("r").cast("timestamp"))
    assert ent.drop_stale(df).count() == 3


def test_intake_sees_each_file_once(spark, tmp_path):
    root = tmp_path / "drop"
    root.mkdir()
    (root / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n12345678901234567890")
    (root / "b.gif").write_bytes(b"GIF89a")
    ok, no, cp = (str(tmp_path / n) for n in ("ok", "no", "cp"))
    intake.intake_stream(intake.watch_folder(spark, str(root)), ok, no, cp).awaitTermination()
    assert spark.read.parquet(ok).count() == 1 and "Unsupported" in spark.read.parquet(no).first().reason
    (root / "c.bmp").write_bytes(b"BM" + b"0" * 30)
    intake.intake_stream(intake.watch_folder(spark, str(root)), ok, no, cp).awaitTermination()
    assert sorted(r.path[-5:] for r in spark.read.parquet(ok).collect()) == ["a.png", "c.bmp"] and spark.read.parquet(no).count() == 1


def test_state_goes_over_stretches_without_frames():
    """A data frame for every case and micro-batch cost more than the work on its few stretches."""
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    watch = sled.ChainWatch()
    watch.state = Held()
    row = lambda at, prev, last, bad=None, before=None: Row(
        case_id="a", ord=at, n=3, first_prev=prev, first_seq=-1, last_hash=last, bad_pos=bad, bad_before=before)
    first, = watch.handleInputRows(("a",), iter([row(10, "h3", "h6"), row(0, sled.GENESIS, "h3")]), None)
    assert first == Row(case_id="a", seen=6, valid_prefix=6, chain_ok=True, broken_at=None, tip="h6", alert=False)
    second, = watch.handleInputRows(("a",), iter([row(20, "h6", "h9", 2, "h7"), row(30, "h9", "h12")]), None)
    assert second == Row(case_id="a", seen=12, valid_prefix=7, chain_ok=False, broken_at=8, tip="h7", alert=True)
    third, = watch.handleInputRows(("a",), iter([row(40, "x", "h15")]), None)
    assert third == Row(case_id="a", seen=15, valid_prefix=7, chain_ok=False, broken_at=8, tip="h7", alert=False)
