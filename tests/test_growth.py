"""Ledgers that grow, live verification by stretches, licences issued once, and evidence walked with links."""

import datetime
import hashlib
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sealwright.functions.hashing import GENESIS
from sealwright.operators import chains, inventory as inv, pages as pg, vaults
from sealwright.schemas import LEDGER_PIPE
from sealwright.session import child_names, remove_path
from sealwright.sources import ledgers as src, walk
from sealwright.sources.checkout import read_checkout_events
from sealwright.sources.ledger_store import LedgerStore
from sealwright.streaming import entitlements as sent, ledgers as sled
from sealwright.streaming.runtime import drain
from test_chains import canonical, chain, edit, lines
from test_entitlements import S, event, plans
from test_plans import plan
from test_streams import LEDGER, segments

BARE = LEDGER.split(", prev_hash")[0]


# ---- append ---------------------------------------------------------------------------------

@pytest.mark.parametrize("segment_rows", [2, 100])
def test_a_chain_goes_on_from_its_tip(spark, segment_rows):
    a, b = chain("a", 9), chain("b", 4)
    tips = chains.tips_of(spark.createDataFrame(a[:5], LEDGER_PIPE))
    late = spark.createDataFrame([r[:7] for r in a[5:] + b], BARE)
    out = chains.build_pipe(late, segment_rows=segment_rows, tips=tips).orderBy("case_id", "id").collect()
    assert [(r.id, r.prev_hash, r.entry_hash) for r in out] == [(r[1], r[7], r[8]) for r in a[5:] + b]
    unused = tips.unionByName(spark.createDataFrame([("z", 3, "00")], "case_id string, seq bigint, hash string"))
    assert chains.build_pipe(late, segment_rows=segment_rows, tips=unused).count() == 8


def test_large_ids_keep_their_digits(spark):
    rows = [("a", 2 ** 53 + 1, *chain("a", 1)[0][2:7]), ("a", 2 ** 53 + 3, *chain("a", 1)[0][2:7])]
    tips = spark.createDataFrame([("a", 1, "ab" * 32)], "case_id string, seq bigint, hash string")
    assert [r.id for r in chains.build_pipe(spark.createDataFrame(rows, BARE), tips=tips).orderBy("id").collect()] == [r[1] for r in rows]


def test_store_adds_a_batch_once_and_removes_what_a_failed_try_left(spark, tmp_path):
    rows = {"a": chain("a", 9), "b": chain("b", 6)}
    store = LedgerStore(spark, str(tmp_path / "s"))
    part = lambda low, high: spark.createDataFrame([r[:7] for c in rows.values() for r in c if low <= r[1] < high], BARE)
    assert store.append(part(1, 3), 0, "id") and store.append(part(3, 5), 1, "id")
    assert not store.append(part(3, 5), 1, "id")
    # a try that wrote entries, but no tips
    part(5, 100).write.parquet(str(tmp_path / "s" / "batches" / "000000000002" / "rows"))
    assert store.committed() == ["000000000000", "000000000001"] and store.rows().count() == 8
    assert store.append(part(5, 100), 2, "id") and store.append(part(50, 60), 3, "id")
    out = store.rows().orderBy("case_id", "id").collect()
    assert [(r.case_id, r.entry_hash) for r in out] == [(r[0], r[8]) for c in rows.values() for r in c]
    assert {(r.case_id, r.seq, r.hash) for r in store.tips().collect()} == {(c, len(v), v[-1][8]) for c, v in rows.items()}
    with pytest.raises(ValueError):
        store.append(part(1, 2), "../x", "id")


def test_jsonl_store_continues_files_written_elsewhere(spark, tmp_path):
    schema = "case_id string, id bigint, event string, data string, ts string"
    names = ["plain", "a b+c%d:e=f/é{x}"]
    want = lines(7, lambda i: {"i": i})
    rows = [(n, e["seq"], "note", canonical(e["data"]), e["ts"]) for n in names for e in want]
    cut = lambda low, high: spark.createDataFrame([r for r in rows if low <= r[1] < high], schema)
    base = str(tmp_path / "base")
    src.write_ledger_jsonl(src.append_jsonl(cut(1, 4), "id"), base, file_rows=1)
    store = LedgerStore(spark, str(tmp_path / "s"), "jsonl", base)
    assert store.append(cut(4, 5), 1, "id") and store.append(cut(40, 50), 2, "id") and store.append(cut(5, 9), 3, "id")
    assert not store.append(cut(5, 9), 3, "id")
    found = store.rows()
    assert {r.line for r in found.where("case_id = 'plain'").collect()} == {canonical(e) for e in want}
    verdict = {r.case_id: (r.entries, r.chain_ok, r.head) for r in chains.verify_chain(found, "jsonl").collect()}
    assert verdict == {n: (7, True, want[-1]["hash"]) for n in names}
    newest = chains.recent_entries(found, 2, "jsonl").where("case_id = 'plain'").orderBy("recency").collect()
    assert [r.seq for r in newest] == [7, 6]
    assert [r.seq for r in chains.events_in_order(found, "jsonl").where("case_id = 'plain'").collect()] == list(range(1, 8))


def test_expected_head_is_part_of_the_verdict(spark, tmp_path):
    want = lines(5, lambda i: {"i": i})
    path = tmp_path / "case_id=c"
    path.mkdir()
    (path / "l.jsonl").write_text("\n".join(canonical(e) for e in want[:4]) + "\n")
    cut = src.read_ledger_jsonl(spark, str(tmp_path))
    pinned = lambda *rows: spark.createDataFrame(rows, "case_id string, head string")
    got = {r.case_id: (r.chain_ok, r.head_ok, r.ok) for r in chains.verify_with_heads(
        cut, pinned(("c", want[4]["hash"]), ("none", GENESIS)), "jsonl").collect()}
    assert got == {"c": (True, False, False), "none": (False, True, False)}
    assert chains.verify_with_heads(cut, pinned(("c", want[3]["hash"])), "jsonl").first().ok


def test_live_append_from_tips(spark, tmp_path):
    rows = chain("a", 8) + chain("b", 3)
    tips = chains.tips_of(spark.createDataFrame(rows[:4], LEDGER_PIPE))
    bare = [r[:7] for r in rows]
    stream = segments(spark, tmp_path, "in", [bare[4:6] + bare[8:9], bare[6:8] + bare[9:]], BARE)
    out = spark.read.parquet(drain(sled.append_stream(stream, tips=tips), "a", str(tmp_path / "out"), str(tmp_path / "cp")))
    assert [(r.case_id, r.seq, r.entry_hash) for r in out.orderBy("case_id", "seq").collect()] == [(r[0], r[1], r[8]) for r in rows[4:]]


# ---- live verification ------------------------------------------------------------------------

def test_handlers_see_stretches_not_rows(spark):
    rows = chain("hot", 500) + [r for k in range(40) for r in chain(f"c{k}", 3)]
    out = sled.stretches(spark.createDataFrame(rows, LEDGER_PIPE).repartition(7), bucket_rows=50).collect()
    hot = [r for r in out if r.case_id == "hot"]
    assert len(hot) == 11 and sum(r.n for r in hot) == 500 and max(r.n for r in hot) == 50
    assert all(r.bad_pos is None for r in out)


@pytest.mark.parametrize("seed", range(4))
def test_stretches_give_the_verdict_of_a_walk(spark, tmp_path, seed):
    rng = random.Random(seed)
    frames, truth = [[], [], []], {}
    for k in range(8):
        rows = [(f"c{k}", *r[1:]) for r in chain("x", 30)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(30)
            rows[at] = rng.choice([edit(rows, at)[at], (*rows[at][:7], "00" * 32, rows[at][8]), (*rows[at][:8], "11" * 32)])
        if rng.random() < 0.3:
            rows.pop(rng.randrange(30))
        good, tip = 0, GENESIS
        for r in rows:
            if r[7] != tip or r[8] != hashlib.sha256("|".join(map(str, r[2:8])).encode()).hexdigest():
                break
            good, tip = good + 1, r[8]
        truth[f"c{k}"] = (len(rows), good, good == len(rows), tip)
        for i, r in enumerate(rows):
            frames[i * 3 // len(rows)].append(r)
    for f in frames:
        rng.shuffle(f)
    stream = segments(spark, tmp_path, "in", frames, LEDGER)
    path = drain(sled.verify_stream(stream, bucket_rows=7), "v", str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.case_id: (r.seen, r.valid_prefix, r.chain_ok, r.tip) for r in sled.latest_verdicts(spark.read.parquet(path)).collect()}
    assert got == truth


def test_jsonl_stretches_count_sequence_numbers(spark, tmp_path):
    want = lines(12, lambda i: {"i": i})
    rows = [("c", i + 1, canonical(e), e["seq"], e["prev"], e["hash"]) for i, e in enumerate(want)]
    schema = "case_id string, line_no bigint, line string, seq bigint, prev string, hash string"
    stream = segments(spark, tmp_path, "in", [rows[:5], rows[5:]], schema)
    out = spark.read.parquet(drain(sled.verify_stream(stream, "jsonl", 4), "v", str(tmp_path / "out"), str(tmp_path / "cp")))
    assert sled.latest_verdicts(out).select("seen", "valid_prefix", "chain_ok").first() == (12, 12, True)


# ---- licences ---------------------------------------------------------------------------------

def _batch(spark, tmp_path, name, *events):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "e.json").write_text("\n".join(map(json.dumps, events)))
    return read_checkout_events(spark, str(folder))


def _orders(spark, path):
    return sorted(r.order for r in sent.issued_licences(spark, path).collect())


def test_a_repeated_batch_issues_what_it_issued(spark, tmp_path):
    path = str(tmp_path / "out")
    issue = sent.IssueOnce(plans(spark), "pw", path)
    first = _batch(spark, tmp_path, "a", event(S + "1"), event(S + "1", at=2), event(S + "2", "unpaid"))
    issue(first, 0)
    issue(first, 0)
    second = _batch(spark, tmp_path, "b", event(S + "1", at=3), event(S + "2", at=4), event(S + "3", at=4))
    issue(second, 1)
    before = _orders(spark, path)
    issue(second, 1)
    assert before == _orders(spark, path) == [S + "1", S + "2", S + "3"]


def test_sessions_are_remembered_for_ninety_days(spark, tmp_path):
    path, day = str(tmp_path / "out"), 86400
    issue = sent.IssueOnce(plans(spark), "pw", path)
    start = event(S + "1")["recv_ts"]

    def at(session, days):
        moved = datetime.datetime.fromisoformat(start.replace("Z", "+00:00")) + datetime.timedelta(days)
        return {**event(session), "recv_ts": moved.strftime("%Y-%m-%dT%H:%M:%SZ")}
    for number, (session, days) in enumerate([("1", 0), ("2", 1), ("2", 89), ("1", 90), ("3", 60), ("4", 150), ("1", 155), ("5", 260), ("4", 261)]):
        issue(_batch(spark, tmp_path, f"b{number}", at(S + session, days)), number)
    # session 1 comes again after 155 days, 4 after 111
    assert _orders(spark, path) == [S + "1", S + "1", S + "2", S + "3", S + "4", S + "4", S + "5"]
    days = child_names(spark, f"{path}/issued")
    kept = [datetime.date.fromisoformat(d.removeprefix("day=")) for d in days]
    assert max(kept) - min(kept) <= datetime.timedelta(91) and len(days) < 5 and day


def test_days_that_are_over_are_one_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    issue = sent.IssueOnce(plans(spark), "pw", path)
    for number in range(3):
        issue(_batch(spark, tmp_path, f"b{number}", event(S + str(number), at=number)), number)
    day = child_names(spark, f"{path}/issued")[0]
    assert len(child_names(spark, f"{path}/issued/{day}")) == 3
    later = {**event(S + "9"), "recv_ts": "2027-01-01T00:00:00Z"}
    first = child_names(spark, f"{path}/issued")[0]
    issue(_batch(spark, tmp_path, "next", {**later, "recv_ts": _next_day(first)}), 3)
    issue(_batch(spark, tmp_path, "again", {**event(S + "0"), "recv_ts": _next_day(first)}), 4)
    assert child_names(spark, f"{path}/issued/{day}") == ["all"]
    assert _orders(spark, path) == [S + "0", S + "1", S + "2", S + "9"]


def _next_day(folder):
    return (datetime.date.fromisoformat(folder.removeprefix("day=")) + datetime.timedelta(1)).isoformat() + "T01:00:00Z"


def test_issue_once_runs_as_a_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for i, batch in enumerate([[event(S + "1")], [event(S + "1", at=3)], [event(S + "2", at=4), event(S + "1", at=9)]]):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
    for _ in range(2):
        stream = read_checkout_events(spark, str(folder), stream=True, max_files_per_trigger=1)
        sent.issue_once(stream, plans(spark), "pw", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert _orders(spark, str(tmp_path / "out")) == [S + "1", S + "2"]


# ---- evidence walk ------------------------------------------------------------------------------

@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "deep" / "er").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "a.txt").write_bytes(b"note")
    (root / ".hidden").write_bytes(b"h")
    (root / "big.bin").write_bytes(b"x" * 50)
    (root / "deep" / "b.pdf").write_bytes(b"%PDF-1")
    (root / "deep" / "er" / "c d.txt").write_bytes(b"")
    (root / "link").symlink_to(root / "a.txt")
    (root / "deep" / "loop").symlink_to(root)
    os.mkfifo(root / "pipe")
    with open(os.fsencode(root) + b"/bad\xff", "wb") as out:
        out.write(b"?")
    return root


@pytest.mark.parametrize("budget", [1, 3, 1000])
@pytest.mark.parametrize("scheme", ["", "file:"])
def test_walk_reports_every_entry(spark, tree, budget, scheme):
    roots = spark.createDataFrame([("k", f"{scheme}{tree}/"), ("none", f"{scheme}{tree}/missing")], "case_id string, root string")
    rows = walk.list_evidence(roots, budget).collect()
    found = {(r.case_id, r.path.removeprefix(f"{scheme}{tree}")): (r.file_kind, r.length) for r in rows}
    assert len(rows) == len(found)
    assert found == {("k", "/" + n): v for n, v in {
        "deep": ("dir", None), "deep/er": ("dir", None), "empty": ("dir", None), "a.txt": ("file", 4), ".hidden": ("file", 1),
        "big.bin": ("file", 50), "deep/b.pdf": ("file", 6), "deep/er/c d.txt": ("file", 0), "link": ("symlink", None),
        "deep/loop": ("symlink", None), "pipe": ("special", None), "bad?": ("error", None)}.items()} | {("none", "/missing"): ("error", None)}
    assert walk.list_evidence(roots.where("case_id = 'k'"), budget, hidden=False).count() == 11


def test_acquisition_from_a_walk(spark, tree):
    cases = spark.createDataFrame([("k", "op", str(tree), 7), ("void", "op", f"{tree}/empty", 8)],
                                  "case_id string, operator string, source_root string, created_unix bigint")
    listed = walk.with_content(walk.list_evidence(cases.select("case_id", F.col("source_root").alias("root"))), 49)
    skips = {r.reason: r.files for r in inv.skip_summary(listed, 49).collect()}
    assert skips == {"symlink": 2, "special": 1, "walk_error": 1, "oversized": 1}
    manifest = inv.acquire(listed, 49)
    assert {(r.relative_path, r.magic_hint, r.sha256) for r in manifest.collect()} == {
        (n, h, hashlib.sha256(b).hexdigest()) for n, h, b in ((".hidden", "text", b"h"), ("a.txt", "text", b"note"),
                                                             ("deep/b.pdf", "pdf", b"%PDF-1"), ("deep/er/c d.txt", "text", b""))}
    digests = spark.createDataFrame([("k", "ab"), ("void", "cd")], "case_id string, sha256 string")
    ledger = chains.build_pipe(inv.acquisition_events(manifest, cases, digests))
    rows = ledger.where("case_id = 'k'").orderBy("id").collect()
    assert [(r.id, r.action, r.path) for r in rows] == [(1, "case-open", str(tree)), *[(i + 2, "ingest-seal", p) for i, p in enumerate(
        (".hidden", "a.txt", "deep/b.pdf", "deep/er/c d.txt"))], (6, "manifest-write", "manifest.json")]
    assert all(r.profile_ok for r in chains.event_profile(ledger).collect()) and ledger.count() == 8
    assert all(r.chain_ok for r in chains.verify_chain(ledger).collect())


def test_files_that_vanish_or_grow_after_the_listing(spark, tree):
    roots = spark.createDataFrame([("k", str(tree))], "case_id string, root string")
    listed = walk.list_evidence(roots)
    (tree / "a.txt").unlink()
    (tree / "a.txt").symlink_to(tree / "big.bin")
    (tree / "deep" / "b.pdf").write_bytes(b"y" * 60)
    kinds = {r.path.rsplit("/", 1)[1]: (r.file_kind, r.length, r.content) for r in walk.with_content(listed, 49).collect()}
    assert kinds["a.txt"][0] == "error" and kinds["b.pdf"] == ("file", 50, None)


# ---- plans ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("known", [3, None])
def test_contents_never_travel_by_salt(spark, tmp_path, known):
    rows = spark.createDataFrame([(f"p{i}", bytearray(b"s" * 16 if i % 3 else b"t" * 16), "r", bytearray(b"x" * i)) for i in range(9)],
                                 "vault_relpath string, salt binary, passphrase_ref string, content binary")
    refs = spark.createDataFrame([("r", "long enough to use")], "passphrase_ref string, passphrase string")
    keys = vaults.derive_keys(rows, refs, b"d", rounds=10)
    assert vaults.key_rows(rows) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sealed = vaults.seal_stretched(rows, keys, known)
        text = sealed._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        blobs = sealed.drop("content", "salt")
        opened = vaults.open_stretched(blobs, keys, known)
        for line in text.splitlines():
            if "Exchange hashpartitioning(salt" in line:
                below = text.splitlines()[text.splitlines().index(line) + 1]
                assert "content" not in below
        assert [bytes(r.plain) for r in opened.orderBy("vault_relpath").collect()] == [b"x" * i for i in range(9)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_composite_deals_samples_out_once(spark):
    samples = spark.range(20).select(F.concat(F.lit("p"), "id").alias("page_id"), F.col("id").alias("frame"), (F.col("id") % 3).alias("y"),
                                     (F.col("id") % 5).alias("x"), (F.col("id") % 2).alias("channel"), F.col("id").alias("v"), (F.col("id") > 3).alias("valid"))
    ref = samples.groupBy("page_id").agg(F.min("frame").alias("reference"))
    text = plan(spark, pg.composite(samples, ref))
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning(page_id" in line and "y#" in line]
    # besides: the page's reference, and its frames counted once and by page
    assert len(wide) == 1 and text.count(" Exchange ") + text.count("- Exchange ") <= 6 and "SortMergeJoin" not in text


def test_tall_pages_have_bounded_groups(spark):
    dots = spark.range(3000).select(F.lit("p").alias("page_id"), (F.col("id") * 7 % 1000).alias("y"), (F.col("id") * 13 % 400).alias("x"))
    blocks = spark.createDataFrame([("p", 0, 0, 400, 1000), ("p", 17, 333, 50, 400), ("p", 399, 999, 1, 1), ("q", 0, 0, 5, 5)],
                                   "page_id string, x int, y int, w int, h int")
    ink = [(i * 7 % 1000, i * 13 % 400) for i in range(3000)]
    got = {(r.page_id, r.x): r.ink for r in pg.block_density(blocks, dots, 8).collect()}
    assert got == {("p", x): sum(x <= b < x + w and y <= a < y + h for a, b in ink) for x, y, w, h in ((0, 0, 400, 1000), (17, 333, 50, 400), (399, 999, 1, 1))} | {("q", 0): 0}


def test_regions_of_groups_stay_apart():
    import numpy as np
    y = np.array([0, 1, 1, 0, 5, 6])
    x0, x1 = np.array([0, 3, 9, 0, 0, 8]), np.array([2, 4, 9, 9, 7, 9])
    assert pg._touching_roots(y, x0, x1, np.array([0, 0, 0, 1, 1, 1])).tolist() == [0, 0, 2, 3, 4, 4]


def test_sketches_merge_over_runs(spark):
    rows = [(b, ms) for b in ("a", "b") for ms in range(1, 101)]
    df = spark.createDataFrame(rows, "batch string, ms bigint")
    runs = pg.batch_sketches(df.where("ms <= 30"), "batch").unionByName(pg.batch_sketches(df.where("ms > 30"), "batch"))
    got = {r.batch: (r.n, r.p50, r.p99) for r in pg.batch_quantiles(runs, "batch", shares=(0.5, 0.99)).collect()}
    assert got == {"a": (100, 50, 99), "b": (100, 50, 99)}
    far = pg.batch_quantiles(pg.batch_sketches(spark.range(200_000).select(F.col("id").alias("ms"))), shares=(0.5,)).first()
    assert far.n == 200_000 and abs(far.p50 - 100_000) < 4000


@pytest.mark.parametrize("segment_rows", [2, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_contested_names_are_settled_in_order(spark, seed, segment_rows):
    rng = random.Random(seed)
    pool = ["a"] * 12 + [f"a-{i}" for i in range(1, 14)] + ["a-1-1", "a-1-2", "a-2-1", "a-1-1-1", "a-03", "b-2", "b"]
    inputs = [(rng.choice(pool), f"p{i:03d}") for i in range(70)]
    existing = {rng.choice(pool) + rng.choice(["", "-1", "-4"]) for _ in range(4)}
    given = {r.path: r.stem for r in inv.assign_names(
        spark.createDataFrame(inputs, "name string, path string"), spark.createDataFrame([(e,) for e in existing], "name string"), segment_rows).collect()}
    gone = set(existing)
    for name, path in inputs:
        stem = next(x for x in (name if n == 0 else f"{name}-{n}" for n in range(999)) if x not in gone)
        gone.add(stem)
        assert given[path] == stem, path
    assert len(given) == len(inputs)


def test_a_task_that_sums_up_entries_sends_bounded_batches():
    """A task once sent all its rows at once; the same rows, with nulls and breaks."""
    n = 25_000
    names = [f"h{i}" for i in range(n + 1)]
    case = ["a"] * (n - 3) + ["b", None, None]
    prev = [*names[:n - 3], None, "x", "h"]
    digest = [*names[1:n - 2], "x", "h", None]
    ok = [i != 7 for i in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(case), pa.array(list(range(n))), pa.array([i // 2 if i < n - 3 else 0 for i in range(n)]), pa.array(prev),
         pa.array(digest), pa.array(ok), pa.array([-1] * n)], names=["case_id", "ord", "bucket", "prev", "hash", "hash_ok", "seq"])
    out = list(sled._stretches(iter([batch.slice(n // 2), batch.slice(0, n // 2)])))
    assert max(b.num_rows for b in out) <= sled.SENT_ROWS < sum(b.num_rows for b in out)
    rows = {(r["case_id"], r["ord"]): r for b in out for r in b.to_pylist()}
    assert len(rows) == (n - 3 + 1) // 2 + 2
    assert rows["a", 6] == {"case_id": "a", "ord": 6, "n": 2, "first_prev": "h6", "first_seq": -1, "last_hash": "h8", "bad_pos": 2,
                            "bad_before": "h7"}
    assert rows["a", 8]["bad_pos"] is None and rows["b", n - 3]["first_prev"] is None
    assert (rows[None, n - 2]["n"], rows[None, n - 2]["last_hash"], rows[None, n - 2]["bad_pos"]) == (2, None, None)
