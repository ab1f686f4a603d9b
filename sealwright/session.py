"""Session defaults and written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_scratch: str | None = None


# The operators count on these. A union that claims its children's partitioning (new in Spark 4.1)
# loses it again when adaptive execution coalesces each child differently, and rows of one key then
# sit in two partitions; so that claim is switched off. The group limit lets "largest 5000 per page"
# be cut inside every task before the shuffle; by default only limits up to 1000 are.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def settle(spark: SparkSession) -> SparkSession:
    """Puts the required settings on a session built elsewhere."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "sealwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **REQUIRED,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.redaction.regex": "(?i)secret|password|passphrase|token|key_hex",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a ``local`` session without that setting (tests, a
    laptop) uses a folder on this machine; elsewhere executors could not see each other's files there.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_scratch is None or not os.path.isdir(_local_scratch):
        _local_scratch = tempfile.mkdtemp(prefix="spark-")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other call has used, below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/sealwright-{app}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every intermediate of this application. DataFrames built on them stop working."""
    remove_path(spark, f"{shared_root(spark)}/sealwright-{spark.sparkContext.applicationId}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of this library's own making, sorted; none where it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage for iterative work: the rows survive executor loss, generated row ids are
    frozen, and unlike a checkpoint the last stage runs once.
    """
    path = path or scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning at the session's full shuffle width, for stages whose cost is CPU rather
    than bytes; adaptive execution would fold small ones into a single task. The hash is written
    out, so a partitioning the input already has never stands in for this one."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, F.xxhash64(*keys))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a lookup side only after counting it; larger tables keep a shuffled join."""
    seen = df.limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else df
