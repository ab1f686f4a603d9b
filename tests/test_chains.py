"""Ledger behaviour on small hand-made chains."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sealwright.functions.hashing import GENESIS
from sealwright.operators import chains, reconcile
from sealwright.schemas import LEDGER_PIPE
from sealwright.sources import ledgers as src


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chain(case, n, start=1):
    rows, prev = [], GENESIS
    for i in range(start, start + n):
        body = (1_700_000_000 + i, "op", "case-open" if i == 1 else "manifest-write" if i == n else "ingest-seal",
                f"f{i}.txt", sha(f"content {i}"))
        digest = sha("|".join(map(str, body)) + "|" + prev)
        rows.append((case, i, *body, prev, digest))
        prev = digest
    return rows


def rehash(rows, at):
    out, prev = list(rows[:at]), rows[at - 1][8] if at else GENESIS
    for r in rows[at:]:
        digest = sha("|".join(map(str, r[2:7])) + "|" + prev)
        out.append((*r[:7], prev, digest))
        prev = digest
    return out


def edit(rows, at, path="changed"):
    out = list(rows)
    r = out[at]
    out[at] = (*r[:5], path, *r[6:])
    return out


def verdict(spark, rows, bucket_rows=100_000, **kw):
    df = spark.createDataFrame(rows, LEDGER_PIPE)
    out = chains.verify_chain(df, bucket_rows=bucket_rows, **kw).collect()
    return {r["case_id"]: r for r in out}


@pytest.mark.parametrize("bucket_rows", [1, 2, 3, 100])
def test_intact_edited_rehashed(spark, bucket_rows):
    good = chain("a", 7)
    both = good + [("b", *r[1:]) for r in edit(good, 3)] + [("c", *r[1:]) for r in rehash(edit(good, 3), 3)]
    got = verdict(spark, both, bucket_rows)
    assert (got["a"].chain_ok, got["a"].valid_prefix, got["a"].head) == (True, 7, good[-1][8])
    assert (got["b"].chain_ok, got["b"].valid_prefix, got["b"].first_bad_id) == (False, 3, 4)
    assert got["b"].trusted_head == good[2][8]
    assert (got["c"].chain_ok, got["c"].valid_prefix) == (True, 7)


@pytest.mark.parametrize("bucket_rows", [1, 2, 100])
def test_removed_swapped_and_first_row(spark, bucket_rows):
    good = chain("a", 6)
    removed = [("r", *r[1:]) for r in good if r[1] != 3]
    swapped = [("s", *r[1:]) for r in good]
    swapped[1], swapped[2] = ("s", 2, *swapped[2][2:]), ("s", 3, *swapped[1][2:])
    headless = [("h", *r[1:]) for r in good[1:]]
    got = verdict(spark, removed + swapped + headless, bucket_rows)
    assert (got["r"].valid_prefix, got["r"].first_bad_position, got["r"].first_bad_id) == (2, 3, 4)
    assert (got["s"].valid_prefix, got["s"].chain_ok) == (1, False)
    assert (got["h"].valid_prefix, got["h"].trusted_head) == (0, GENESIS)


def test_tail_cut_needs_a_pinned_head(spark):
    good = chain("a", 5)
    cut = spark.createDataFrame(good[:3], LEDGER_PIPE)
    assert chains.verify_chain(cut).first().chain_ok
    pinned = chains.heads(spark.createDataFrame(good, LEDGER_PIPE))
    assert not chains.check_heads(chains.heads(cut), pinned).first().head_ok
    assert chains.check_heads(pinned, pinned).first().head_ok


def test_missing_ledger_is_not_ok(spark):
    cases = spark.createDataFrame([("a",), ("none",)], "case_id string")
    got = verdict(spark, chain("a", 2), cases=cases)
    assert got["a"].chain_ok and not got["none"].chain_ok and got["none"].entries == 0


@pytest.mark.parametrize("segment_rows", [1, 2, 3, 50])
def test_building_in_rounds(spark, segment_rows):
    rows = chain("a", 7) + [("b", *r[1:]) for r in chain("b", 2)]
    bare = spark.createDataFrame(rows, LEDGER_PIPE).drop("prev_hash", "entry_hash")
    built = {(r.case_id, r.id): (r.prev_hash, r.entry_hash) for r in chains.build_pipe(bare, segment_rows=segment_rows).collect()}
    assert built == {(r[0], r[1]): (r[7], r[8]) for r in rows}
    tips = {r.case_id: (r.entries, r.head) for r in chains.chain_fold(bare, segment_rows=segment_rows).collect()}
    assert tips == {"a": (7, rows[6][8]), "b": (2, rows[8][8])}


def test_event_profile(spark):
    df = spark.createDataFrame(chain("a", 7), LEDGER_PIPE)
    row = chains.event_profile(df).first()
    assert (row.opens, row.ingests, row.manifest_writes, row.total, row.profile_ok) == (1, 5, 1, 7, True)


def test_rehashed_tail_shows_in_the_manifest(spark):
    good = chain("a", 7)
    ledger = spark.createDataFrame(rehash(edit(good, 3), 3), LEDGER_PIPE)
    manifest = spark.createDataFrame([(r[0], r[5], r[6]) for r in good if r[4] == "ingest-seal"],
                                     "case_id string, relative_path string, sha256 string")
    assert chains.verify_chain(ledger).first().chain_ok
    out = {(r.path, r.status) for r in reconcile.reconcile(manifest, ledger).where("status <> 'matched'").collect()}
    assert out == {("f4.txt", "manifest_only"), ("changed", "ledger_only")}


def test_ambiguous_material(spark):
    rows = edit(chain("a", 2), 1, "x|y")
    got = chains.hash_ok(spark.createDataFrame(rows, LEDGER_PIPE)).orderBy("id").collect()
    assert [r.ambiguous_material for r in got] == [False, True]


# ---- JSONL ------------------------------------------------------------------------------

def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def lines(n, data=None):
    out, prev = [], GENESIS
    for i in range(1, n + 1):
        body = {"seq": i, "ts": "2026-01-01T00:00:00+00:00", "event": "note", "prev": prev,
                "data": data(i) if data else {"i": i}}
        digest = sha(canonical(body))
        out.append({**body, "hash": digest})
        prev = digest
    return out


def read(spark, tmp_path, files, chunk=None):
    for case, rows in files.items():
        (tmp_path / f"{case}.jsonl").write_text("".join(r + "\n" for r in rows))
    if chunk:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(chunk))
    try:
        df = src.read_ledger_jsonl(spark, str(tmp_path), case_from="file")
        df = df.withColumn("case_id", F.regexp_extract("case_id", r"([^/]+)\.jsonl$", 1))
        return {r.case_id: r for r in chains.verify_chain(df, "jsonl").collect()}, src.with_line_numbers(df).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("chunk", [None, 300, 1000])
def test_jsonl_variants(spark, tmp_path, chunk):
    good = lines(9, lambda i: {"list": [1, 2.5, 1e-07, True, None], "nested": {"a": "é中😀", "c": "\u0007\u007f"}, "i": i})
    text = [canonical(e) for e in good]
    edited = list(text)
    edited[2] = canonical({**good[2], "data": {"i": 99}})
    reordered = list(text)
    reordered[1], reordered[2] = reordered[2], reordered[1]
    spaced = [json.dumps({k: e[k] for k in ("ts", "seq", "prev", "hash", "event", "data")}) for e in good]
    got, numbered = read(spark, tmp_path, {
        "ok": text, "edited": edited, "reordered": reordered, "spaced": spaced, "cut": text[:4],
        "gone": text[:3] + text[4:], "broken": text[:2] + ["{not json"] + text[2:]}, chunk)
    assert (got["ok"].chain_ok, got["ok"].entries, got["ok"].head) == (True, 9, good[-1]["hash"])
    assert (got["edited"].chain_ok, got["edited"].valid_prefix) == (False, 2)
    assert (got["reordered"].first_bad_position, got["reordered"].chain_ok) == (2, False)
    assert (got["spaced"].chain_ok, got["spaced"].entries) == (True, 9)
    assert (got["cut"].chain_ok, got["cut"].entries) == (True, 4)
    assert (got["gone"].valid_prefix, got["broken"].valid_prefix) == (3, 2)
    by_line = {(r.case_id, r.line_no): r.line for r in numbered}
    assert [by_line["ok", i + 1] for i in range(9)] == text


def test_golden_ledger(spark, tmp_path):
    """Three lines with escapes, a control character and small floats, and their head."""
    stored = [
        r'{"data":{"masked_fraction":0.012345,"source_name":"Übersicht – März.png","status":"repaired"},"event":"evidence_sealed","hash":"583d50edf1a05515db58871221054f581de1b88c56ae86a40d2964dc93cbe048","prev":"0000000000000000000000000000000000000000000000000000000000000000","seq":1,"ts":"2026-09-30T18:41:33+00:00"}',
        r'{"data":{"reason":"tiny 5e-05 \"quoted\"","source_name":"x\u0007y.jpg","source_sha256":null},"event":"rejected","hash":"61095f17b4cb5228c50b47caf1eb5d6e05c6df2e6e31c8d065e5373b2161016a","prev":"583d50edf1a05515db58871221054f581de1b88c56ae86a40d2964dc93cbe048","seq":2,"ts":"2026-09-30T18:41:33+00:00"}',
        r'{"data":{"list":[1,2.5,1e-07,true,null],"nested":{"a":"é中😀","b":1}},"event":"note","hash":"85508a44387130ea80ec193e3c388d2fe82313858ee5964f8135eb05b0aafab3","prev":"61095f17b4cb5228c50b47caf1eb5d6e05c6df2e6e31c8d065e5373b2161016a","seq":3,"ts":"2026-09-30T18:41:33+00:00"}']
    got, _ = read(spark, tmp_path, {"golden": stored})
    row = got["golden"]
    assert (row.chain_ok, row.entries) == (True, 3)
    assert row.head == "85508a44387130ea80ec193e3c388d2fe82313858ee5964f8135eb05b0aafab3"


def test_written_lines_are_canonical(spark, tmp_path):
    events = spark.createDataFrame(
        [("c", i, f"ev é {i}" if i % 2 else "plain", canonical({"i": i}), "2026-01-01T00:00:00+00:00") for i in range(1, 40)],
        "case_id string, n bigint, event string, data string, ts string")
    path = str(tmp_path / "out")
    src.write_ledger_jsonl(src.append_jsonl(events, "n", segment_rows=7), path, file_rows=4)
    got = chains.verify_chain(src.read_ledger_jsonl(spark, path), "jsonl").collect()
    assert [(r.case_id, r.entries, r.chain_ok) for r in got] == [("c", 39, True)]
    for r in src.read_ledger_jsonl(spark, path).collect():
        assert r.line == canonical(json.loads(r.line))
    with pytest.raises(Exception):
        src.write_ledger_jsonl(src.append_jsonl(events, "n"), path)


def test_json_strings_like_python(spark):
    from sealwright.functions.canonical import canonical_json, json_string
    texts = ["plain", 'quo"te', "back\\slash", "tab\tnew\nline\r\f\b", "\u0000\u001f\u007f", "é中😀", "", "~ !#[]", "a/b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r.i: r.j for r in df.select("i", json_string(F.col("s")).alias("j")).collect()}
    assert [got[i] for i in range(len(texts))] == [json.dumps(s) for s in texts]
    raw = '{"b": 1e-7, "a": {"z": 1.0, "y": "\u00e9"}, "c": [1, 2.5, null, true]}'
    out = spark.createDataFrame([(raw,)], "s string").select(canonical_json(F.col("s")).alias("j")).first().j
    assert out == canonical(json.loads(raw))


def raw_lines(texts):
    """Chained lines hashed over their raw text, canonical or not."""
    out, prev = [], GENESIS
    for i, data in enumerate(texts, 1):
        head, tail = '{"data":' + data + ',"event":"e"', f',"prev":"{prev}","seq":{i},"ts":"t"}}'
        prev = sha(head + tail)
        out.append(f'{head},"hash":"{prev}"{tail}')
    return out


FLAT = ['{}', '{"a":1}', '{"a":-12,"b":"x y","c":null}', '{"a":0.5}', '{"a":0.0001}', '{"a":0.012345}', '{"a":12.25,"b":true}',
        '{"a":0.0}', '{"B":1,"a":2}', '{"a":"1:2,3","b":"{"}', '{"a":[1]}', '{"a":1e-07}', '{"a":1234567.0}', '{"a":-0.25}', '{"":0}']
LOOSE = ['{"a": 1}', '{"b":1,"a":2}', '{"a":1,"a":2}', '{"a":1.50}', '{"a":0.00001}', '{"a":"é"}', '{"a":-0}', '{"a":1.0e2}', '{"a":"\\u0041"}',
         '{"a":{"c":1,"b":2}}', '{"a":0.0000}', '{"a":0.00010}']


def test_only_canonical_text_verifies(spark, tmp_path):
    files = {f"flat{i}": raw_lines(['{}', d]) for i, d in enumerate(FLAT)}
    files |= {f"loose{i}": raw_lines(['{}', d]) for i, d in enumerate(LOOSE)}
    got, _ = read(spark, tmp_path, files)

    def expected(data):
        return canonical(json.loads(data)) == data
    assert all(expected(d) for d in FLAT) and not any(expected(d) for d in LOOSE)
    assert {k: r.chain_ok for k, r in got.items()} == {k: k.startswith("flat") for k in files}


def test_fast_check_agrees_with_python(spark):
    import random
    from sealwright.functions.canonical import surely_canonical
    rng = random.Random(11)

    def number():
        text = rng.choice(["", "-"]) + str(rng.choice([0, 7, 10, 123456, 12345678])) + rng.choice(["", "."])
        return text + "".join(rng.choice("0001259") for _ in range(rng.randint(0, 12))) if text.endswith(".") else text
    rows = []
    for i in range(3000):
        keys = [rng.choice(["a", "b", "B", "ab", "a b", ""]) for _ in range(rng.randint(0, 3))]
        vals = [rng.choice([number(), "true", "null", '"x"', '" : "', '"a,b"', "[1]", '"\\""']) for _ in keys]
        data = "{" + ",".join(f'"{k}":{v}' for k, v in zip(keys, vals)) + "}"
        rows.append((i, data, f'{{"data":{data},"event":"e","hash":"{"0" * 64}","prev":"{"1" * 64}","seq":3,"ts":"t"}}'))
    df = spark.createDataFrame(rows, "i int, data string, line string")
    sure = {r.i for r in df.where(surely_canonical(F.col("line"))).collect()}
    assert len(sure) > 300
    for i, data, _ in rows:
        if i in sure:
            assert canonical(json.loads(data)) == data, data
