"""Evidence-shaped views over the driver tables, each with its SQL twin.

Every view is a projection of a whole table. Damage is planted by rules on the data itself
(a large ``value``, the first digit of a digest), so the checks have something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chains
from ..session import scratch_path, settle, shared_root, stage

_staged: dict[tuple, DataFrame] = {}

TEXT_FILE_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, name: str, build, partition_by=()) -> DataFrame:
    """A derived table written to the shared folder once per application."""
    key = (spark.sparkContext.applicationId, shared_root(spark), sf_dir, name)
    if key not in _staged:
        _staged[key] = stage(build(), name, partition_by)
    return _staged[key]


def epoch_seconds(col) -> F.Column:
    return F.unix_seconds(F.col(col).cast("timestamp"))


def tampered() -> F.Column:
    """Rows altered after hashing in the damaged copies."""
    return F.col("value") > 250


# ---- custody ledger from events --------------------------------------------------------

def custody_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("case-"), F.col("user_id").cast("string")).alias("case_id"),
        F.col("event_id").alias("id"), epoch_seconds("ts").alias("ts"),
        F.col("event_type").alias("operator"),
        F.when(F.col("event_type") == "signup", "case-open")
        .when(F.col("event_type") == "purchase", "manifest-write").otherwise("ingest-seal").alias("action"),
        F.col("props").alias("path"), F.sha2("props", 256).alias("sha256"), "value")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "ledger", lambda: chains.build_pipe(custody_events(spark, sf_dir)))


def ledger_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with paths changed after hashing."""
    df = ledger(spark, sf_dir)
    return df.withColumn("path", F.when(tampered(), F.concat(F.lit("edited "), "path")).otherwise(F.col("path")))


def ledger_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with rows removed."""
    return ledger(spark, sf_dir).where(~tampered())


def hot_ledger_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ledger_edited``, but two of the event types make up one case."""
    def build():
        hot = F.when(F.col("operator").isin("view", "click"), F.lit("case-hot")).otherwise(F.col("case_id"))
        return chains.build_pipe(custody_events(spark, sf_dir).withColumn("case_id", hot))
    df = once(spark, sf_dir, "hot-ledger", build)
    # one late edit in the hot case, so that most of it is good
    edited = F.when(F.col("case_id") == "case-hot", F.col("value") > 499.5).otherwise(tampered())
    return df.withColumn("path", F.when(edited, F.concat(F.lit("edited "), "path")).otherwise(F.col("path")))


LEDGER_SQL = """
WITH RECURSIVE ev AS (
  SELECT 'case-' || user_id AS case_id, event_id AS id, epoch_us(ts) // 1000000 AS ts,
         event_type AS operator,
         CASE event_type WHEN 'signup' THEN 'case-open' WHEN 'purchase' THEN 'manifest-write'
              ELSE 'ingest-seal' END AS action,
         props AS path, sha256(props) AS sha256, value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos
  FROM events),
head AS (
  SELECT *, ts || '|' || operator || '|' || action || '|' || path || '|' || sha256 || '|' AS material FROM ev),
chain AS (
  SELECT case_id, pos, repeat('0', 64) AS prev_hash, sha256(material || repeat('0', 64)) AS entry_hash
  FROM head WHERE pos = 1
  UNION ALL
  SELECT h.case_id, h.pos, c.entry_hash, sha256(h.material || c.entry_hash)
  FROM chain c JOIN head h ON h.case_id = c.case_id AND h.pos = c.pos + 1),
ledger AS (
  SELECT h.case_id, h.id, h.ts, h.operator, h.action, h.path, h.sha256, h.value, c.prev_hash, c.entry_hash
  FROM head h JOIN chain c USING (case_id, pos)),
edited AS (
  SELECT * REPLACE (CASE WHEN value > 250 THEN 'edited ' || path ELSE path END AS path) FROM ledger),
gapped AS (SELECT * FROM ledger WHERE NOT value > 250)
"""

HOT_LEDGER_SQL = (LEDGER_SQL
    .replace("'case-' || user_id AS case_id", "CASE WHEN event_type IN ('view', 'click') THEN 'case-hot' ELSE 'case-' || user_id END AS case_id")
    .replace("PARTITION BY user_id ORDER", "PARTITION BY CASE WHEN event_type IN ('view', 'click') THEN 'case-hot' ELSE 'case-' || user_id END ORDER")
    .replace("CASE WHEN value > 250 THEN 'edited '", "CASE WHEN CASE case_id WHEN 'case-hot' THEN value > 499.5 ELSE value > 250 END THEN 'edited '"))

ROW_OK_SQL = ("sha256(ts || '|' || operator || '|' || action || '|' || path || '|' || sha256 || '|' || prev_hash)"
              " = entry_hash")


def packed(df: DataFrame):
    """A writer of compressed text files (JSON, CSV). They cannot be split when read, so their rows are bounded."""
    return df.write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", TEXT_FILE_ROWS)


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
