"""Licences, checkout events and trial clocks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sealwright.functions import licences as fx
from sealwright.operators import entitlements as ent
from sealwright.sources.checkout import read_checkout_events

DAY = 86_400_000
T0 = 1_790_000_000_000


def test_month_overflow(spark):
    rows = [("2025-01-31", 1, "2025-03-03"), ("2024-02-29", 12, "2025-03-01"), ("2025-03-15", 1, "2025-04-15"), ("2025-08-31", 6, "2026-03-03")]
    df = spark.createDataFrame(rows, "d string, n int, want string")
    got = df.select(fx.add_months_overflow(F.to_date("d"), F.col("n")).cast("string").alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_trial_rules(spark):
    obs = [("a", 1, T0), ("a", 2, T0 + 179 * DAY + 1), ("a", 3, T0 + 180 * DAY), ("b", 1, T0), ("b", 2, T0 + 200 * DAY), ("b", 3, T0 + 10 * DAY)]
    df = spark.createDataFrame(obs, "install_id string, arrival bigint, observed_ms bigint")
    clock = {(r.install_id, r.arrival): r for r in ent.trial_clock(df).collect()}
    assert [clock["a", i].days_left for i in (1, 2, 3)] == [180, 1, 0]
    assert [clock["a", i].active for i in (1, 2, 3)] == [True, True, False]
    assert not clock["b", 3].active and clock["b", 3].last_seen_ms == T0 + 200 * DAY
    owned = spark.createDataFrame([("b", "pro", "play", "", None), ("c", "free", "none", "", None)],
                                  "install_id string, plan string, source string, licensee string, expires string")
    state = ent.trial_state(df.where("arrival < 3"))
    got = {r.install_id: (r.plan, r.source, r.seal) for r in ent.entitlements(owned, state).collect()}
    assert got == {"a": ("pro", "trial", True), "b": ("pro", "play", True), "c": ("free", "none", False)}


def test_clock_over_buckets_like_a_loop(spark):
    rng = random.Random(3)
    obs = [("x", i * 40_000, T0 + rng.randint(0, 10**9)) for i in range(30)]
    df = spark.createDataFrame(obs, "install_id string, arrival bigint, observed_ms bigint")
    got = {r.arrival: (r.started_ms, r.last_seen_ms) for r in ent.trial_clock(df).collect()}
    latest = 0
    for _, arrival, ms in obs:
        latest = max(latest, ms)
        assert got[arrival] == (obs[0][2], latest)


KEY = {"v": 1, "product": "pw", "name": "Ann", "expires": None}


def test_keys(spark):
    def coded(payload):
        import base64
        enc = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
        raw = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
        return "ARC1." + enc(raw) + "." + enc(b"s" * 64)
    cases = [(coded(KEY), "valid"), (coded({**KEY, "expires": "2030-01-01"}), "valid"), (coded({**KEY, "expires": "2026-09-30"}), "valid"),
             (coded({**KEY, "expires": "2026-09-29"}), "expired"), (coded({**KEY, "expires": "soon"}), "bad_expiry"),
             (coded({**KEY, "expires": ""}), "valid"), (coded({**KEY, "product": "other"}), "wrong_product"), (coded({**KEY, "v": 2}), "wrong_product"),
             (coded(b"[1]"), "wrong_product"), (coded(b"{nope"), "damaged"), ("", "malformed"), (None, "malformed"), ("ARC2.a.b", "malformed"),
             ("ARC1.a", "malformed"), ("ARC1." + "a" * 4096 + ".b", "malformed"), ("ARC1.!!!!.aaaa", "damaged"),
             (coded(KEY)[:20] + "\n  " + coded(KEY)[20:], "valid")]
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, key string")
    got = {r.i: r.verdict for r in ent.license_verdicts(df, "pw", F.lit("2026-09-30").cast("date")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    again = spark.createDataFrame([(json.dumps(KEY),)], "p string").select(fx.encode_key(F.col("p"), F.lit(b"s" * 64)).alias("key"))
    assert again.first().key == coded(KEY)


def event(session, status="paid", kind="checkout.session.completed", at=0, **kw):
    obj = {"id": session, "payment_status": status, "payment_link": "plink_a", "mode": "payment", "quantity": 1,
           "customer_details": {"email": "a@example.com", "name": "A"}, **kw}
    return {"recv_ts": (dt.datetime(2026, 1, 31) + dt.timedelta(minutes=at)).strftime("%Y-%m-%dT%H:%M:%S.000Z"), "signature_header": "t=1,v1=a",
            "type": kind, "data": {"object": obj}}


def feed(spark, tmp_path, events, name="f"):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "e.json").write_text("\n".join(json.dumps(e) for e in events))
    return str(folder)


def plans(spark):
    return spark.createDataFrame([("plink_a", "pro", 2, None)], "payment_link string, plan string, seats int, months int")


S = "cs_live_" + "x" * 12


def test_issue_once_per_paid_session(spark, tmp_path):
    events = [event(S + "1"), event(S + "1", at=5), event(S + "2", "unpaid"),
              event(S + "2", kind="checkout.session.async_payment_succeeded", at=9), event(S + "3", "unpaid"),
              event(S + "4", payment_link="plink_zzz"), event("bad id"), event(S + "5", kind="invoice.paid"),
              event(S + "6", payment_link=None, mode="subscription", quantity=3, metadata={"pw_plan": "pro", "pw_seats": "4"}),
              event(S + "7", payment_link=None, metadata={"pw_plan": "pro", "pw_months": "1"})]
    got = {r.order: r for r in ent.build_licenses(read_checkout_events(spark, feed(spark, tmp_path, events)), plans(spark), "pw").collect()}
    assert set(got) == {S + k for k in "1267"}
    assert got[S + "1"].seats == 2 and got[S + "1"].expires is None and got[S + "6"].seats == 12
    assert 378 <= (got[S + "6"].expires - got[S + "6"].issued).days <= 381
    assert got[S + "7"].expires == dt.date(2026, 3, 17)
    asked = spark.createDataFrame([(S + "1",), (S + "3",), ("nope",)], "session_id string")
    issued = spark.createDataFrame([(S + "1", "lic_1")], "order string, id string")
    assert {r.session_id: r.answer for r in ent.lookup_license(asked, issued).collect()} == {
        S + "1": "found", S + "3": "not ready", "nope": "bad session id"}


@pytest.mark.parametrize("header,fresh,n", [
    ("t=1000,v1=a", True, 1), ("t=1000,v1=a,v1=b,v0=c", True, 2), ("t=700,v1=a", True, 1), ("t=699,v1=a", False, 1),
    ("t=1301,v1=a", False, 1), ("v1=a", False, 1), ("t=1000", False, 0), ("t=x,v1=a", False, 1), ("t=1,t=1000,v1=", False, 0), ("", False, 0)])
def test_webhook_stamp(spark, header, fresh, n):
    df = spark.createDataFrame([(header,)], "h string").select(fx.webhook_stamp(F.col("h"), F.lit(1000)).alias("s"))
    row = df.first().s
    assert (row.fresh, len(row.signatures)) == (fresh, n)
