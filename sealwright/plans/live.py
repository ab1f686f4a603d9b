"""Registered queries that replay tables through the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains
from ..operators.entitlements import drop_stale
from ..sources.checkout import read_checkout_events
from ..streaming import entitlements as sent, intake, ledgers as sled
from ..streaming.runtime import drain
from . import custody, entitlements as pe, evidence as pev, tables as t

_done: dict = {}


SEGMENTS = 2
FILES = 8
INTAKE_BATCHES = 8


def _replay(spark, sf_dir, name, batch, order, segments=SEGMENTS):
    """A derived table as a log: segments written one after the other in ``order``, one per
    micro-batch, the way a growing ledger arrives."""
    key = (spark.sparkContext.applicationId, sf_dir, f"replay-{name}")
    if key not in _done:
        path = t.scratch(spark, f"replay-{name}")
        low, high = batch.agg(F.min(order), F.max(order)).first()
        step = (high - low) // segments + 1
        for k in range(segments):
            part = batch.where((F.col(order) >= low + k * step) & (F.col(order) < low + (k + 1) * step))
            part.repartitionByRange(FILES, order).write.mode("append").parquet(path)
        _done[key] = path
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", FILES).parquet(_done[key])


def _drained(spark, sf_dir, name, stream):
    """Output of a stream run to its end, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _done:
        _done[key] = drain(stream(), name)
    return spark.read.parquet(_done[key])


def verify(spark, sf_dir):
    out = _drained(spark, sf_dir, "stream-verify", lambda: sled.verify_stream(
        _replay(spark, sf_dir, "edited", t.ledger_edited(spark, sf_dir), "id")))
    return sled.latest_verdicts(out).select("case_id", F.col("seen").alias("entries"), "valid_prefix", "chain_ok")


def verify_hot(spark, sf_dir):
    """As ``verify``, with one case that owns two of the five event types, summed up by small buckets."""
    out = _drained(spark, sf_dir, "stream-verify-hot", lambda: sled.verify_stream(
        _replay(spark, sf_dir, "hot", t.hot_ledger_edited(spark, sf_dir), "id"), bucket_rows=256))
    return sled.latest_verdicts(out).select("case_id", F.col("seen").alias("entries"), "valid_prefix", "chain_ok")


def append(spark, sf_dir):
    """The second half of the events, chained live to a ledger built from the first half."""
    def stream():
        events = t.custody_events(spark, sf_dir)
        half = custody.half_of(events, "id")
        tips = chains.tips_of(t.once(spark, sf_dir, "half-ledger", lambda: chains.build_pipe(events.where(F.col("id") <= half))))
        return sled.append_stream(_replay(spark, sf_dir, "late-events", events.where(F.col("id") > half), "id"), tips=tips)
    out = _drained(spark, sf_dir, "stream-append", stream)
    return out.select("case_id", F.col("order_no").alias("id"), "seq", "prev_hash", "entry_hash")


def trials(spark, sf_dir):
    out = _drained(spark, sf_dir, "stream-trials", lambda: sent.trial_stream(
        _replay(spark, sf_dir, "observations", pe.observations(spark, sf_dir), "arrival")))
    return out.groupBy("install_id").agg(F.max_by(F.struct("started_ms", "last_seen_ms", "active", "days_left"),
                                                  "last_seen_ms").alias("s")).select("install_id", "s.*")


def licences(spark, sf_dir):
    """Checkout events as they arrive, every fifth customer's a month late, over four micro-batches."""
    key = (spark.sparkContext.applicationId, sf_dir, "stream-licences")
    if key not in _done:
        seconds = F.unix_seconds("recv_ts")
        late = F.when(F.pmod(F.hash("session_id", "recv_ts"), F.lit(5)) == 0, 30 * 86400).otherwise(0)
        arriving = pe.events(spark, sf_dir).withColumn("arrival", seconds + late)
        path = t.scratch(spark, "stream-licences")
        sent.issue_once(_replay(spark, sf_dir, "checkout", arriving, "arrival", 4), pe.plans(spark), pe.PRODUCT, path,
                        t.scratch(spark, "stream-licences-checkpoint")).awaitTermination()
        _done[key] = path
    return pe._dated(sent.issued_licences(spark, _done[key])).select("id", "order", "seats", "issued", "expires")


def fresh(spark, sf_dir):
    out = _drained(spark, sf_dir, "stream-fresh", lambda: drop_stale(
        read_checkout_events(spark, pe.event_files(spark, sf_dir), stream=True)).select("session_id", "recv_ts"))
    return out.select("session_id", F.unix_seconds("recv_ts").alias("recv"))


def intake_judged(spark, sf_dir):
    files = pev.containers(spark, sf_dir).select("p_partkey", F.col("p_partkey").cast("string").alias("path"), "length", "content")
    out = _drained(spark, sf_dir, "stream-intake", lambda: intake.judged(
        _replay(spark, sf_dir, "containers", files, "p_partkey")))
    return out.select("path", F.coalesce("reason", F.lit("accepted")).alias("verdict"))


def intake_folder(spark, sf_dir):
    """A watched folder with one small file per supplier, through both sinks of the intake; a second start adds nothing."""
    key = (spark.sparkContext.applicationId, sf_dir, "stream-intake-folder")
    if key not in _done:
        root, good, bad, checkpoint = (t.scratch(spark, f"intake-{n}") for n in ("files", "accepted", "rejected", "checkpoint"))
        kind = F.col("s_suppkey") % 5
        head = F.when(kind == 0, "BM").when(kind == 1, "GIF89a").when(kind == 2, "0000ftypheic").when(kind == 3, "RIFF0000AVI LIST").otherwise("")
        suppliers = t.table(spark, sf_dir, "supplier")
        pev._line_files(suppliers, root, "s_suppkey", line=F.concat(head, "s_name"))
        # every micro-batch has a cost of its own, so they grow with the folder once it needs more than a few
        most = max(200, -(-suppliers.count() // INTAKE_BATCHES))
        for _ in range(2):
            intake.intake_stream(intake.watch_folder(spark, root, most), good, bad, checkpoint).awaitTermination()
        _done[key] = (good, bad)
    good, bad = _done[key]
    supplier = F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("bigint").alias("supplier")
    return spark.read.parquet(good).select(supplier, "source_sha256", F.lit("accepted").alias("verdict")).unionByName(
        spark.read.parquet(bad).select(supplier, "source_sha256", F.col("reason").alias("verdict")))


QUERIES = {
    "stream_chain_verify": verify,
    "stream_chain_verify_hot": verify_hot,
    "stream_chain_append": append,
    "stream_trial_clock": trials,
    "stream_licence_issue": licences,
    "stream_checkout_fresh": fresh,
    "stream_intake": intake_judged,
    "stream_intake_folder": intake_folder,
}

ORACLE = {
    "stream_chain_verify": "SELECT case_id, entries, valid_prefix, chain_ok FROM (" + custody._verdict_sql("edited") + ")",
    "stream_chain_verify_hot": "SELECT case_id, entries, valid_prefix, chain_ok FROM (" + custody._verdict_sql("edited", ledger_sql=t.HOT_LEDGER_SQL) + ")",
    "stream_chain_append": t.LEDGER_SQL + f"""
SELECT h.case_id, h.id, h.pos AS seq, c.prev_hash, c.entry_hash FROM head h JOIN chain c USING (case_id, pos)
WHERE h.id > ({custody.HALF_SQL})""",
    "stream_trial_clock": pe.OBSERVED_SQL + "SELECT install_id, started_ms, last_seen_ms, active, days_left FROM state",
    "stream_licence_issue": pe.EVENTS_SQL + 'SELECT id, "order", seats, issued, expires FROM licences',
    "stream_checkout_fresh": pe.ORACLE["checkout_fresh"],
    "stream_intake_folder": f"""
WITH f AS (SELECT s_suppkey, s_suppkey % 5 AS kind, CASE s_suppkey % 5 WHEN 0 THEN 'BM' WHEN 1 THEN 'GIF89a' WHEN 2 THEN '0000ftypheic'
           WHEN 3 THEN 'RIFF0000AVI LIST' ELSE '' END || s_name || chr(10) AS body FROM supplier)
SELECT s_suppkey AS supplier, sha256(body) AS source_sha256, CASE kind WHEN 2 THEN '{pev.fx.HEIF_REASON}'
  WHEN 0 THEN 'accepted' WHEN 3 THEN 'accepted' ELSE '{pev.fx.UNSUPPORTED}' END AS verdict FROM f""",
    "stream_intake": pev.CONTAINERS_SQL + f"""
SELECT p_partkey::VARCHAR AS path, CASE WHEN video IS NOT NULL THEN 'accepted' WHEN heif THEN '{pev.fx.HEIF_REASON}'
  WHEN photo_format IS NULL THEN '{pev.fx.UNSUPPORTED}' ELSE 'accepted' END AS verdict FROM sniffed""",
}
