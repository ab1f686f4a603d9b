"""Incremental evidence intake: each new file once, rejections as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.files import intake_reason
from ..functions.hashing import sha256_hex

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(spark: SparkSession, root: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", max_files_per_trigger).load(root))


def judged(files: DataFrame, rules: str = "photo") -> DataFrame:
    """Digest and verdict of arriving files; ``reason`` is null for accepted ones."""
    return files.select("path", "length", sha256_hex(F.col("content")).alias("source_sha256"),
                        intake_reason(F.col("content"), F.col("length"), rules).alias("reason"))


def intake_stream(files: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str, rules: str = "photo"):
    """Starts the intake with two sinks. The batch number is part of the folder name, so a batch
    that is replayed after a failure replaces its own output and nothing else."""
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for path, rows in ((accepted_path, batch.where("reason is null").drop("reason")),
                               (rejected_path, batch.where("reason is not null"))):
                rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()
    return (judged(files, rules).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
