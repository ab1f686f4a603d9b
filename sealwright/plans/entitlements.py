"""Registered queries over checkout events, licence keys and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import licences as fx
from ..operators import entitlements as ent
from ..sources import checkout as csrc
from . import tables as t

PRODUCT = "pageworks"
TODAY = "1999-06-15"

_files: dict = {}


def plans(spark):
    """Configuration, not data: which payment link sells what."""
    return spark.createDataFrame([("plink_pro", "pro", 1, None), ("plink_team", "pro", 5, 18)],
                                 "payment_link string, plan string, seats int, months int")


def raw_events(spark, sf_dir):
    """Checkout events from orders, each repeated as the sender retries."""
    o, cust = t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "customer")
    joined = o.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    k, c, prio = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    retry = F.explode(F.sequence(F.lit(0), (c % 3).cast("int"))).alias("retry")
    rows = joined.select("*", retry)
    stamp = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("retry") * 3600
    return rows.select(
        F.timestamp_seconds(stamp).alias("recv_ts"),
        F.concat(F.lit("t="), (stamp + k % 700 - 350).cast("string"), F.lit(",v1=aa,v0=zz"),
                 F.when(k % 11 == 0, F.lit("")).otherwise(F.lit(",v1=bb"))).alias("signature_header"),
        F.when(c % 5 == 0, "checkout.session.async_payment_succeeded").when(c % 5 == 1, "payment_intent.created")
        .otherwise("checkout.session.completed").alias("type"),
        F.struct(F.struct(
            F.concat(F.when(prio == "4-NOT SPECIFIED", F.lit("bad_")).otherwise(F.lit("cs_live_")),
                     F.lpad(k.cast("string"), 12, "0")).alias("id"),
            F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "unpaid")
            .otherwise("no_payment_required").alias("payment_status"),
            F.when(prio == "1-URGENT", "plink_pro").when(prio == "2-HIGH", "plink_team").when(prio == "5-LOW", "plink_other")
            .alias("payment_link"),
            F.when(k % 2 == 0, "subscription").otherwise("payment").alias("mode"), (c % 4).cast("int").alias("quantity"),
            mail.alias("customer_email"),
            F.when(c % 7 != 0, F.struct(F.when(c % 2 == 0, F.concat(F.lit("x"), mail)).alias("email"), F.col("c_name").alias("name")))
            .alias("customer_details"),
            F.when((prio == "3-MEDIUM") & (k % 3 != 0), F.create_map(
                F.lit(f"{PRODUCT}_plan"), F.lit("pro"), F.lit(f"{PRODUCT}_seats"), (c % 3).cast("string"),
                F.lit(f"{PRODUCT}_months"), F.when(k % 5 == 0, "1").otherwise(""))).alias("metadata")).alias("object")).alias("data"))


def event_files(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        path = t.scratch(spark, "checkout-events")
        t.packed(raw_events(spark, sf_dir)).json(path)
        _files[key] = path
    return _files[key]


def events(spark, sf_dir):
    return csrc.read_checkout_events(spark, event_files(spark, sf_dir))


EVENTS_SQL = f"""
WITH ev AS (
  SELECT epoch_us(o_orderdate) // 1000000 + r * 3600 AS recv, o_orderkey AS k, o_custkey AS c, r,
         CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'bad_' ELSE 'cs_live_' END || lpad(o_orderkey::VARCHAR, 12, '0') AS session_id,
         CASE o_custkey % 5 WHEN 0 THEN 'checkout.session.async_payment_succeeded' WHEN 1 THEN 'payment_intent.created'
              ELSE 'checkout.session.completed' END AS type,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'unpaid' ELSE 'no_payment_required' END AS payment_status,
         o_orderpriority AS prio, CASE o_orderkey % 2 WHEN 0 THEN 'subscription' ELSE 'payment' END AS mode,
         o_custkey % 4 AS quantity, lower(replace(c_name, '#', '.')) || '@example.com' AS mail, c_name, o_orderdate::DATE AS issued
  FROM orders JOIN customer ON o_custkey = c_custkey, LATERAL (SELECT unnest(range(o_custkey % 3 + 1)) AS r)),
paid AS (
  SELECT * FROM ev WHERE type <> 'payment_intent.created' AND session_id LIKE 'cs_live_%' AND payment_status <> 'unpaid'),
planned AS (
  SELECT *, CASE prio WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 5 ELSE c % 3 END AS plan_seats,
         CASE prio WHEN '2-HIGH' THEN 18 WHEN '3-MEDIUM' THEN CASE WHEN k % 5 = 0 THEN 1 END END AS months
  FROM paid WHERE prio IN ('1-URGENT', '2-HIGH') OR (prio = '3-MEDIUM' AND k % 3 <> 0)),
firsts AS (SELECT * FROM planned WHERE r = 0),
terms AS (SELECT *, coalesce(months, CASE mode WHEN 'subscription' THEN 12 END) AS term FROM firsts),
licences AS (
  SELECT 1 AS v, '{PRODUCT}' AS product, 'lic_' || substr(sha256(session_id), 1, 16) AS id, 'pro' AS plan,
         CASE WHEN c % 7 <> 0 AND c % 2 = 0 THEN 'x' || mail ELSE mail END AS email, CASE WHEN c % 7 <> 0 THEN c_name ELSE '' END AS name,
         greatest(plan_seats, 1) * greatest(quantity, 1) AS seats, strftime(issued, '%Y-%m-%d') AS issued,
         coalesce(strftime((date_trunc('month', issued) + to_months(term))::DATE + (day(issued)::INTEGER - 1 + 14), '%Y-%m-%d'), 'never') AS expires,
         session_id AS "order"
  FROM terms)
"""


def _dated(licences):
    return licences.withColumns({"issued": F.date_format("issued", "yyyy-MM-dd"),
                                 "expires": F.coalesce(F.date_format("expires", "yyyy-MM-dd"), F.lit("never"))})


def licence_keys(spark, sf_dir):
    """A key per customer: most are good, market segments and nations plant the faults."""
    cust = t.table(spark, sf_dir, "customer")
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    expires = (F.when(seg == "BUILDING", F.lit('"2001-01-31"')).when(seg == "MACHINERY", F.lit('"1999-06-14"'))
               .when(seg == "HOUSEHOLD", F.lit(f'"{TODAY}"')).when(nation == 7, F.lit('"soon"')).otherwise(F.lit("null")))
    payload = F.concat(F.lit('{"expires":'), expires, F.lit(',"name":"'), F.col("c_name"), F.lit('","product":"'),
                       F.when(nation == 3, "other").otherwise(PRODUCT), F.lit('","seats":1,"v":'),
                       F.when(nation == 4, "2").otherwise("1"), F.lit("}"))
    key = fx.encode_key(payload, F.sha2("c_name", 256).cast("binary"))
    key = (F.when(nation == 10, F.replace(key, F.lit("ARC1."), F.lit("ARC2."))).when(nation == 11, F.concat(key, F.lit(".x")))
           .when(nation == 12, F.concat(F.substring(key, 1, 30), F.lit(".ab"))).when(nation == 13, "")
           .when(nation == 14, F.concat_ws("\n ", F.substring(key, 1, 40), F.substring(key, 41, 5000))).otherwise(key))
    return cust.select("c_custkey", key.alias("key"))


KEYS_SQL = f"""
SELECT c_custkey, CASE
  WHEN c_nationkey IN (10, 11, 13) THEN 'malformed' WHEN c_nationkey = 12 THEN 'damaged'
  WHEN c_nationkey IN (3, 4) THEN 'wrong_product'
  WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'valid' WHEN c_mktsegment = 'MACHINERY' THEN 'expired'
  WHEN c_nationkey = 7 THEN 'bad_expiry' ELSE 'valid' END AS verdict,
  CASE WHEN c_nationkey IN (10, 11, 12, 13) THEN 'none' ELSE c_name END AS name
FROM customer"""


def observations(spark, sf_dir):
    """One trial observation per event; errors report a clock ten days slow, purchases one far ahead."""
    e = t.table(spark, sf_dir, "events")
    drift = (F.when(F.col("event_type") == "error", -864_000_000)
             .when((F.col("event_type") == "purchase") & (F.col("value") > 150), 13_824_000_000).otherwise(0))
    return e.select(F.col("user_id").alias("install_id"), F.col("event_id").alias("arrival"),
                    (F.unix_millis(F.col("ts").cast("timestamp")) + drift).alias("observed_ms"))


OBSERVED_SQL = """
WITH obs AS (
  SELECT user_id AS install_id, event_id AS arrival, epoch_us(ts) // 1000
    + CASE WHEN event_type = 'error' THEN -864000000 WHEN event_type = 'purchase' AND value > 150 THEN 13824000000 ELSE 0 END AS observed_ms
  FROM events),
clock AS (
  SELECT *, first_value(observed_ms) OVER w AS started_ms, max(observed_ms) OVER w AS last_seen_ms FROM obs
  WINDOW w AS (PARTITION BY install_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
trial AS (
  SELECT *, last_seen_ms < started_ms + 15552000000 AS active,
         CASE WHEN last_seen_ms < started_ms + 15552000000 THEN (started_ms + 15552000000 - last_seen_ms + 86399999) // 86400000 ELSE 0 END AS days_left,
         strftime(make_timestamp((started_ms + 15552000000) * 1000), '%Y-%m-%d') AS ends FROM clock),
state AS (SELECT * FROM trial QUALIFY row_number() OVER (PARTITION BY install_id ORDER BY arrival DESC) = 1)
"""


def owned(spark, sf_dir):
    cust = t.table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    return cust.select(
        F.col("c_custkey").alias("install_id"), F.when(seg == "BUILDING", "pro").otherwise("free").alias("plan"),
        F.when(seg == "BUILDING", "key").otherwise("none").alias("source"), F.col("c_name").alias("licensee"),
        F.when(seg == "BUILDING", "2001-01-31").alias("expires"))


QUERIES = {
    "checkout_events": lambda s, d: events(s, d).select(
        F.unix_seconds("recv_ts").alias("recv"), "session_id", "type", "payment_status", "mode", "quantity"),
    "checkout_paid_sessions": lambda s, d: ent.paid_sessions(events(s, d)).select(
        "session_id", F.unix_seconds("recv_ts").alias("recv")),
    "checkout_fresh": lambda s, d: ent.drop_stale(events(s, d)).select(
        "session_id", F.unix_seconds("recv_ts").alias("recv")),
    "checkout_signatures": lambda s, d: events(s, d).select("session_id", F.unix_seconds("recv_ts").alias("recv"), F.size(
        fx.webhook_stamp(F.col("signature_header"), F.unix_seconds("recv_ts"))["signatures"]).alias("signatures")),
    "checkout_plans": lambda s, d: ent.with_plan(ent.paid_sessions(events(s, d)), plans(s), PRODUCT).select(
        "session_id", F.unix_seconds("recv_ts").alias("recv"), "plan", "seats", F.coalesce("months", F.lit(0)).alias("months")),
    "licence_issue": lambda s, d: _dated(ent.build_licenses(events(s, d), plans(s), PRODUCT)),
    "licence_lookup": lambda s, d: ent.lookup_license(
        events(s, d).select("session_id"), ent.build_licenses(events(s, d), plans(s), PRODUCT)
    ).groupBy("session_id", "answer").agg(F.count(F.lit(1)).alias("requests")),
    "licence_expiry": lambda s, d: t.table(s, d, "orders").select("o_orderkey", F.date_format(fx.licence_expiry(
        F.to_date("o_orderdate"), (F.col("o_custkey") % 14).cast("int"), F.lit("subscription")), "yyyy-MM-dd").alias("expires")),
    "licence_verdict": lambda s, d: ent.license_verdicts(licence_keys(s, d), PRODUCT, F.lit(TODAY).cast("date")).select(
        "c_custkey", "verdict", F.coalesce("payload.name", F.lit("none")).alias("name")),
    "trial_clock": lambda s, d: ent.trial_clock(observations(s, d)),
    "trial_state": lambda s, d: ent.trial_state(observations(s, d)),
    "trial_entitlements": lambda s, d: ent.entitlements(owned(s, d), ent.trial_state(observations(s, d))).select(
        "install_id", "plan", "source", "licensee", F.coalesce("expires", F.lit("never")).alias("expires"), "seal"),
}

ORACLE = {
    "checkout_events": EVENTS_SQL + "SELECT recv, session_id, type, payment_status, mode, quantity FROM ev",
    "checkout_paid_sessions": EVENTS_SQL + "SELECT session_id, recv FROM paid",
    "checkout_fresh": EVENTS_SQL + "SELECT session_id, recv FROM ev WHERE abs(k % 700 - 350) <= 300",
    "checkout_signatures": EVENTS_SQL + "SELECT session_id, recv, CASE WHEN k % 11 = 0 THEN 1 ELSE 2 END AS signatures FROM ev",
    "checkout_plans": EVENTS_SQL + "SELECT session_id, recv, 'pro' AS plan, plan_seats AS seats, coalesce(months, 0) AS months FROM planned",
    "licence_issue": EVENTS_SQL + "SELECT * FROM licences",
    "licence_lookup": EVENTS_SQL + """
SELECT session_id, CASE WHEN session_id NOT LIKE 'cs_live_%' THEN 'bad session id'
       WHEN session_id IN (SELECT "order" FROM licences) THEN 'found' ELSE 'not ready' END AS answer, count(*) AS requests
FROM ev GROUP BY ALL""",
    "licence_expiry": """
SELECT o_orderkey, strftime((date_trunc('month', o_orderdate) + to_months(CASE o_custkey % 14 WHEN 0 THEN 12 ELSE o_custkey % 14 END::INTEGER))::DATE
       + (day(o_orderdate)::INTEGER - 1 + 14), '%Y-%m-%d') AS expires FROM orders""",
    "licence_verdict": KEYS_SQL,
    "trial_clock": OBSERVED_SQL + "SELECT * FROM trial",
    "trial_state": OBSERVED_SQL + "SELECT install_id, started_ms, last_seen_ms, active, days_left, ends FROM state",
    "trial_entitlements": OBSERVED_SQL + """
SELECT install_id, CASE WHEN c_mktsegment = 'BUILDING' OR coalesce(active, false) THEN 'pro' ELSE 'free' END AS plan,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'key' WHEN coalesce(active, false) THEN 'trial' ELSE 'none' END AS source,
       CASE WHEN c_mktsegment IS DISTINCT FROM 'BUILDING' AND coalesce(active, false) THEN '' ELSE coalesce(c_name, '') END AS licensee,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '2001-01-31' WHEN coalesce(active, false) THEN ends ELSE 'never' END AS expires,
       coalesce(c_mktsegment = 'BUILDING', false) OR coalesce(active, false) AS seal
FROM state s FULL JOIN (SELECT c_custkey AS install_id, c_mktsegment, c_name FROM customer) c USING (install_id)""",
}
