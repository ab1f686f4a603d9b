"""Registered queries over custody ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains
from ..sources import ledgers as src
from ..sources.ledger_store import LedgerStore
from . import tables as t

def _verdict(df):
    return df.select("case_id", "entries", "valid_prefix", "chain_ok",
                     F.coalesce("first_bad_position", F.lit(0)).alias("first_bad_position"),
                     F.coalesce("first_bad_id", F.lit(-1)).alias("first_bad_id"), "head", "trusted_head")


def _verdict_sql(source: str, row_ok: str = t.ROW_OK_SQL, ledger_sql: str = t.LEDGER_SQL) -> str:
    return f"""{ledger_sql},
checked AS (
  SELECT case_id, id, entry_hash, row_number() OVER w AS p,
         coalesce(lag(entry_hash) OVER w, repeat('0', 64)) AS expected,
         ({row_ok}) AND prev_hash = coalesce(lag(entry_hash) OVER w, repeat('0', 64)) AS ok
  FROM {source} WINDOW w AS (PARTITION BY case_id ORDER BY id))
SELECT case_id, count(*) AS entries,
       coalesce(min(p) FILTER (WHERE NOT ok) - 1, count(*)) AS valid_prefix,
       bool_and(ok) AS chain_ok, coalesce(min(p) FILTER (WHERE NOT ok), 0) AS first_bad_position,
       coalesce(min(id) FILTER (WHERE NOT ok), -1) AS first_bad_id,
       arg_max(entry_hash, id) AS head,
       coalesce(arg_min(expected, p) FILTER (WHERE NOT ok), arg_max(entry_hash, id)) AS trusted_head
FROM checked GROUP BY case_id"""


def flagship(spark, sf_dir):
    """Custody verification over many cases, one row per case."""
    return _verdict(chains.verify_chain(t.ledger_edited(spark, sf_dir)))


def _cases(spark, sf_dir):
    c = t.table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return c.select(F.col("c_custkey").alias("case_pk"), F.col("c_name").alias("case_name"),
                    F.col("c_mktsegment").alias("source_root"))


def _multi_case(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_pk"), F.col("event_id").alias("id"), F.col("props").alias("path"))


def _tail_cut(spark, sf_dir):
    return t.ledger(spark, sf_dir).where(F.col("ts") < 1706572800)


# concat dialect

def _concat_ledger(spark, sf_dir):
    def build():
        e = t.table(spark, sf_dir, "events").select(
            F.concat(F.lit("src-"), F.col("event_type")).alias("case_id"), F.col("event_id").alias("id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.sha2("props", 256).alias("hash_data"), "value")
        # material is prev || timestamp || data, so nothing precedes the previous hash
        out = chains.chain_rows(e, "id", F.lit(""), F.concat("timestamp", "hash_data"))
        return out.withColumnsRenamed({"prev_hash": "hash_prev", "entry_hash": "hash_chain"})
    df = t.once(spark, sf_dir, "ledger-concat", build)
    return df.withColumn("hash_data", F.when(t.tampered(), F.sha2("hash_data", 256)).otherwise(F.col("hash_data")))


CONCAT_SQL = """
WITH RECURSIVE ev AS (
  SELECT 'src-' || event_type AS case_id, event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
         sha256(props) AS hash_data, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos
  FROM events),
chain AS (
  SELECT case_id, pos, repeat('0', 64) AS hash_prev, sha256(repeat('0', 64) || timestamp || hash_data) AS hash_chain
  FROM ev WHERE pos = 1
  UNION ALL
  SELECT e.case_id, e.pos, c.hash_chain, sha256(c.hash_chain || e.timestamp || e.hash_data)
  FROM chain c JOIN ev e ON e.case_id = c.case_id AND e.pos = c.pos + 1),
stored AS (
  SELECT case_id, id, pos, timestamp, hash_prev, hash_chain,
         CASE WHEN value > 250 THEN sha256(hash_data) ELSE hash_data END AS hash_data
  FROM ev JOIN chain USING (case_id, pos)),
checked AS (
  SELECT *, sha256(hash_prev || timestamp || hash_data) = hash_chain AS hash_ok FROM stored)
"""


# jsonl dialect

def _jsonl_events(spark, sf_dir):
    """What happened, one JSONL ledger per event type."""
    return t.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("case_id"), "event_id", "value",
        F.concat(F.lit('{"k":'), F.regexp_extract("props", r"(\d+)", 1), F.lit(',"user":'),
                 F.col("user_id").cast("string"), F.lit("}")).alias("data"),
        F.lit("note").alias("event"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"))


def _jsonl_rows(spark, sf_dir):
    """Entries of one JSONL ledger per event type, chained in canonical form."""
    return src.append_jsonl(_jsonl_events(spark, sf_dir), order="event_id")


def _jsonl_files(spark, sf_dir):
    def build():
        rows = _jsonl_rows(spark, sf_dir)
        edited = rows.withColumn("data", F.when(t.tampered() & (F.col("seq") > 50), F.lit('{"k":0}'))
                                 .otherwise(F.col("data")))
        return edited
    key = ("jsonl", spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        path = t.scratch(spark, "ledger-lines")
        src.write_ledger_jsonl(build(), path)
        _files[key] = path
    return _files[key]


_files: dict = {}


def jsonl_verify(spark, sf_dir):
    lines = src.read_ledger_jsonl(spark, _jsonl_files(spark, sf_dir))
    return _verdict(chains.verify_chain(lines, "jsonl")).drop("first_bad_id")


def jsonl_line_checks(spark, sf_dir):
    lines = src.with_line_numbers(src.read_ledger_jsonl(spark, _jsonl_files(spark, sf_dir)))
    checked = chains.hash_ok(chains.seq_ok(lines), "jsonl")
    return checked.select("case_id", "line_no", "seq", "seq_ok", "hash_ok", "hash")


JSONL_SQL = """
WITH RECURSIVE ev AS (
  SELECT event_type AS case_id, event_id, value,
         '{"data":{"k":' || regexp_extract(props, '(\\d+)', 1) || ',"user":' || user_id || '},"event":"note","prev":"' AS head,
         '{"data":{"k":0},"event":"note","prev":"' AS changed,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq,
         strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS ts
  FROM events),
chain AS (
  SELECT case_id, seq, repeat('0', 64) AS prev,
         sha256(head || repeat('0', 64) || '","seq":1,"ts":"' || ts || '"}') AS hash
  FROM ev WHERE seq = 1
  UNION ALL
  SELECT e.case_id, e.seq, c.hash, sha256(e.head || c.hash || '","seq":' || e.seq || ',"ts":"' || e.ts || '"}')
  FROM chain c JOIN ev e ON e.case_id = c.case_id AND e.seq = c.seq + 1),
lines AS (
  SELECT case_id, seq, hash, prev,
         sha256(CASE WHEN value > 250 AND seq > 50 THEN changed ELSE head END
                || prev || '","seq":' || seq || ',"ts":"' || ts || '"}') = hash AS hash_ok
  FROM ev JOIN chain USING (case_id, seq))
"""

def pipe_csv(spark, sf_dir):
    """The ledger written as CSV and read back through the relational source."""
    key = ("pipe-csv", spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        path = t.scratch(spark, "ledger-csv")
        t.ledger(spark, sf_dir).drop("value").write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
        _files[key] = path
    return src.read_ledger_pipe(spark, _files[key], "csv")


# growing ledgers

def half_of(rows, order):
    """The middle between the least and the greatest order number."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return (low + high) // 2


HALF_SQL = "SELECT (min(event_id) + max(event_id)) // 2 FROM events"


def append_existing(spark, sf_dir):
    """A ledger of the first half of the events, continued with the second half, twice tried."""
    events = t.custody_events(spark, sf_dir)
    half = half_of(events, "id")
    store = LedgerStore(spark, t.scratch(spark, "ledger-store"))
    store.append(events.where(F.col("id") <= half), 0, "id")
    late = events.where(F.col("id") > half)
    assert store.append(late, 1, "id") and not store.append(late, 1, "id")
    return store.rows().select("case_id", "id", "prev_hash", "entry_hash")


def jsonl_append_existing(spark, sf_dir):
    """JSONL files of the first half of the events, continued by a store, and verified as one ledger."""
    events = _jsonl_events(spark, sf_dir)
    half = half_of(events, "event_id")
    base = t.scratch(spark, "ledger-base")
    src.write_ledger_jsonl(src.append_jsonl(events.where(F.col("event_id") <= half), "event_id"), base)
    store = LedgerStore(spark, t.scratch(spark, "ledger-lines-store"), "jsonl", base)
    late = events.where(F.col("event_id") > half)
    assert store.append(late, 1, "event_id") and not store.append(late, 1, "event_id")
    return _verdict(chains.verify_chain(store.rows(), "jsonl")).drop("first_bad_id")


def jsonl_head_check(spark, sf_dir):
    """Chain and expected head in one verdict: the edited ledger against the heads it had when written; of
    purchases a later head is expected than the file has."""
    lines = src.read_ledger_jsonl(spark, _jsonl_files(spark, sf_dir))
    pinned = chains.heads(lines, "jsonl").select("case_id", F.when(F.col("case_id") == "purchase", F.sha2("head", 256))
                                                 .otherwise(F.col("head")).alias("head"))
    return chains.verify_with_heads(lines, pinned, "jsonl").select("case_id", "entries", "chain_ok", "head_ok", "ok")


QUERIES = {
    "chain_append_existing": append_existing,
    "ledger_jsonl_append_existing": jsonl_append_existing,
    "ledger_jsonl_heads": lambda s, d: chains.heads(src.read_ledger_jsonl(s, _jsonl_files(s, d)), "jsonl"),
    "ledger_jsonl_recent": lambda s, d: chains.recent_entries(src.read_ledger_jsonl(s, _jsonl_files(s, d)), 20, "jsonl").select(
        "case_id", "seq", "hash", "recency"),
    "ledger_jsonl_listing": lambda s, d: chains.events_in_order(src.read_ledger_jsonl(s, _jsonl_files(s, d)), "jsonl").select(
        "case_id", "seq", "event", "ts", "hash"),
    "ledger_jsonl_head_check": jsonl_head_check,
    "ledger_pipe_read": lambda s, d: chains.verify_chain(pipe_csv(s, d)).select("case_id", "entries", "chain_ok", "head"),
    "chain_build": lambda s, d: t.ledger(s, d).select("case_id", "id", "prev_hash", "entry_hash"),
    "chain_build_segmented": lambda s, d: chains.build_pipe(t.custody_events(s, d), segment_rows=25).select(
        "case_id", "id", "entry_hash"),
    "chain_fold": lambda s, d: chains.chain_fold(t.custody_events(s, d)),
    "chain_verify": flagship,
    "chain_verify_intact": lambda s, d: _verdict(chains.verify_chain(t.ledger(s, d))),
    "chain_verify_gapped": lambda s, d: _verdict(chains.verify_chain(t.ledger_gapped(s, d))),
    "chain_verify_bucketed": lambda s, d: _verdict(chains.verify_chain(t.ledger_edited(s, d), bucket_rows=512)),
    "chain_first_break": lambda s, d: chains.first_break(t.ledger_edited(s, d)),
    "chain_link_check": lambda s, d: chains.link_ok(t.ledger_gapped(s, d), bucket_rows=4096),
    "chain_row_hash_check": lambda s, d: chains.hash_ok(
        t.ledger_edited(s, d).withColumn("path", F.regexp_replace("path", "edited .*7", "a|b"))
    ).select("case_id", "id", "hash_ok", "ambiguous_material"),
    "chain_concat_check": lambda s, d: chains.hash_ok(_concat_ledger(s, d), "concat").select(
        "case_id", "id", "hash_ok"),
    "chain_concat_verify": lambda s, d: chains.verify_chain(_concat_ledger(s, d), "concat").select(
        "case_id", "entries", "valid_prefix", "chain_ok"),
    "ledger_jsonl_verify": jsonl_verify,
    "ledger_jsonl_lines": jsonl_line_checks,
    "ledger_heads": lambda s, d: chains.heads(t.ledger(s, d)),
    "ledger_head_check": lambda s, d: chains.check_heads(
        chains.heads(_tail_cut(s, d)), chains.heads(t.ledger(s, d))
    ).select("case_id", "head_ok", F.coalesce("head", F.lit("missing")).alias("head")),
    "ledger_recent_entries": lambda s, d: chains.recent_entries(t.ledger(s, d), 20).select(
        "case_id", "id", "action", "recency"),
    "ledger_listing": lambda s, d: chains.events_in_order(t.ledger(s, d)).select(
        "case_id", "id", "ts", "operator", "action", "path"),
    "ledger_event_profile": lambda s, d: chains.event_profile(t.ledger(s, d)),
    "ledger_unique_violations": lambda s, d: chains.unique_violations(t.ledger(s, d), "sha256"),
    "ledger_attach_case": lambda s, d: chains.attach_case(_multi_case(s, d), _cases(s, d)).select(
        "case_pk", "id", "case_name", "source_root"),
    "ledger_orphans": lambda s, d: chains.orphan_entries(_multi_case(s, d), _cases(s, d)),
    "ledger_missing_case": lambda s, d: chains.verify_chain(
        t.ledger(s, d), cases=t.table(s, d, "customer").select(
            F.concat(F.lit("case-"), F.col("c_custkey").cast("string")).alias("case_id"))
    ).select("case_id", "entries", "chain_ok", "head"),
}

ORACLE = {
    "chain_append_existing": t.LEDGER_SQL + "SELECT case_id, id, prev_hash, entry_hash FROM ledger",
    "ledger_jsonl_append_existing": JSONL_SQL + """
SELECT case_id, count(*) AS entries, count(*) AS valid_prefix, true AS chain_ok, 0 AS first_bad_position,
       arg_max(hash, seq) AS head, arg_max(hash, seq) AS trusted_head
FROM chain GROUP BY case_id""",
    "ledger_jsonl_heads": JSONL_SQL + "SELECT case_id, arg_max(hash, seq) AS head, count(*) AS entries FROM chain GROUP BY case_id",
    "ledger_jsonl_recent": JSONL_SQL + """
SELECT case_id, seq, hash, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS recency FROM chain
QUALIFY recency <= 20""",
    "ledger_jsonl_listing": JSONL_SQL + "SELECT case_id, seq, 'note' AS event, ts, hash FROM ev JOIN chain USING (case_id, seq)",
    "ledger_jsonl_head_check": JSONL_SQL + """
SELECT case_id, count(*) AS entries, bool_and(hash_ok) AS chain_ok, case_id <> 'purchase' AS head_ok,
       bool_and(hash_ok) AND case_id <> 'purchase' AS ok
FROM lines GROUP BY case_id""",
    "ledger_pipe_read": "SELECT case_id, entries, chain_ok, head FROM (" + _verdict_sql("ledger") + ")",
    "chain_build": t.LEDGER_SQL + "SELECT case_id, id, prev_hash, entry_hash FROM ledger",
    "chain_build_segmented": t.LEDGER_SQL + "SELECT case_id, id, entry_hash FROM ledger",
    "chain_fold": t.LEDGER_SQL + """
SELECT case_id, count(*) AS entries,
       list_reduce(list_concat([repeat('0', 64)], list(material ORDER BY id)),
                   lambda acc, x: sha256(x || acc)) AS head
FROM head GROUP BY case_id""",
    "chain_verify": _verdict_sql("edited"),
    "chain_verify_intact": _verdict_sql("ledger"),
    "chain_verify_gapped": _verdict_sql("gapped"),
    "chain_verify_bucketed": _verdict_sql("edited"),
    "chain_first_break": "SELECT case_id, valid_prefix, first_bad_position, first_bad_id FROM ("
                         + _verdict_sql("edited") + ") WHERE NOT chain_ok",
    "chain_link_check": t.LEDGER_SQL + """
SELECT case_id, id, prev_hash = coalesce(lag(entry_hash) OVER (PARTITION BY case_id ORDER BY id), repeat('0', 64)) AS link_ok
FROM gapped""",
    "chain_row_hash_check": t.LEDGER_SQL + f""",
shown AS (SELECT * REPLACE (regexp_replace(path, 'edited .*7', 'a|b') AS path) FROM edited)
SELECT case_id, id, {t.ROW_OK_SQL} AS hash_ok,
       contains(path, '|') OR contains(operator, '|') OR contains(action, '|') AS ambiguous_material
FROM shown""",
    "chain_concat_check": CONCAT_SQL + "SELECT case_id, id, hash_ok FROM checked",
    "chain_concat_verify": CONCAT_SQL + """
SELECT case_id, count(*) AS entries, coalesce(min(pos) FILTER (WHERE NOT hash_ok) - 1, count(*)) AS valid_prefix,
       bool_and(hash_ok) AS chain_ok
FROM checked GROUP BY case_id""",
    "ledger_jsonl_verify": JSONL_SQL + """
SELECT case_id, count(*) AS entries, coalesce(min(seq) FILTER (WHERE NOT hash_ok) - 1, count(*)) AS valid_prefix,
       bool_and(hash_ok) AS chain_ok, coalesce(min(seq) FILTER (WHERE NOT hash_ok), 0) AS first_bad_position,
       arg_max(hash, seq) AS head,
       coalesce(arg_min(prev, seq) FILTER (WHERE NOT hash_ok), arg_max(hash, seq)) AS trusted_head
FROM lines GROUP BY case_id""",
    "ledger_jsonl_lines": JSONL_SQL + "SELECT case_id, seq AS line_no, seq, true AS seq_ok, hash_ok, hash FROM lines",
    "ledger_heads": t.LEDGER_SQL + "SELECT case_id, arg_max(entry_hash, id) AS head, count(*) AS entries FROM ledger GROUP BY case_id",
    "ledger_head_check": t.LEDGER_SQL + """,
full_heads AS (SELECT case_id, arg_max(entry_hash, id) AS head FROM ledger GROUP BY case_id),
cut AS (SELECT case_id, arg_max(entry_hash, id) AS head FROM ledger WHERE ts < 1706572800 GROUP BY case_id)
SELECT f.case_id, f.head IS NOT DISTINCT FROM c.head AS head_ok, coalesce(c.head, 'missing') AS head
FROM full_heads f LEFT JOIN cut c USING (case_id)""",
    "ledger_recent_entries": t.LEDGER_SQL + """
SELECT case_id, id, action, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id DESC) AS recency FROM ev) WHERE recency <= 20""",
    "ledger_listing": t.LEDGER_SQL + "SELECT case_id, id, ts, operator, action, path FROM ev",
    "ledger_event_profile": t.LEDGER_SQL + """
SELECT *, opens = 1 AND manifest_writes = 1 AND total = ingests + 2 AS profile_ok FROM (
  SELECT case_id, count(*) FILTER (WHERE action = 'case-open') AS opens,
         count(*) FILTER (WHERE action = 'ingest-seal') AS ingests,
         count(*) FILTER (WHERE action = 'manifest-write') AS manifest_writes, count(*) AS total
  FROM ev GROUP BY case_id)""",
    "ledger_unique_violations": "SELECT sha256(props) AS sha256, count(*) AS occurrences FROM events GROUP BY 1 HAVING count(*) > 1",
    "ledger_attach_case": """
SELECT c_custkey AS case_pk, event_id AS id, c_name AS case_name, c_mktsegment AS source_root
FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0""",
    "ledger_orphans": """
SELECT user_id AS case_pk, event_id AS id, props AS path FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "ledger_missing_case": t.LEDGER_SQL + """
SELECT 'case-' || c_custkey AS case_id, count(l.id) AS entries, count(l.id) > 0 AS chain_ok,
       coalesce(arg_max(l.entry_hash, l.id), repeat('0', 64)) AS head
FROM customer LEFT JOIN ledger l ON l.case_id = 'case-' || c_custkey GROUP BY c_custkey""",
}
