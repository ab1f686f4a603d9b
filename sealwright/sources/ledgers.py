"""Ledger sources and the JSONL sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.canonical import body_prefix, body_suffix, canonical_line, json_string
from ..operators.chains import SEGMENT_ROWS, chain_rows
from ..operators.joins import skew_join
from ..operators.ordered import Running, prefix_scan, with_position
from ..schemas import LEDGER_LINE, LEDGER_PIPE


FILE_ROWS = 200_000


def read_ledger_pipe(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Relational ledger rows from parquet or CSV."""
    reader = spark.read.schema(LEDGER_PIPE)
    return reader.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_ledger_jdbc(spark: SparkSession, url: str, partitions: int, lower: int, upper: int,
                     ledger_table: str = "custody_ledger", cases_table: str = "forensic_cases",
                     **options: str) -> tuple[DataFrame, DataFrame]:
    """Multi-case store: (ledger, cases). The ledger is read in parallel on ``case_pk``."""
    def reader():
        r = spark.read.format("jdbc").option("url", url)
        for key, value in options.items():
            r = r.option(key, value)
        return r
    ledger = (reader().option("dbtable", ledger_table).option("partitionColumn", "case_pk")
              .option("lowerBound", lower).option("upperBound", upper)
              .option("numPartitions", partitions).load())
    ledger = ledger.withColumnsRenamed({"ts_unix": "ts", "action_taken": "action", "sha256_hash": "sha256"})
    return ledger, reader().option("dbtable", cases_table).load()


def read_ledger_jsonl(spark: SparkSession, path: str | list[str], case_from: str = "partition") -> DataFrame:
    """JSONL ledger lines with their place in the file.

    Files are split as usual; nothing reads a whole file into one row. ``chunk`` is the split a
    line came from and ``line_pos`` its order in the whole scan, so (chunk, line_pos) is file order;
    files of one case follow their part number.
    The case is the ``case_id=`` folder, or the file itself with ``case_from="file"``. Several paths are read as one
    table, each with its own part numbers.
    """
    reader = spark.read.option("lineSep", "\n")
    if case_from == "partition" and not isinstance(path, str):
        # folders of several roots are no partitions of one table, so the name is taken from the path
        name = F.regexp_extract("_metadata.file_path", r"(?s)^.*/case_id=([^/]*)/", 1)
        plain = F.url_decode(F.replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit("%2B")))
        lines = reader.option("recursiveFileLookup", "true").text(path).withColumn(
            "case_id", F.when(name != "__HIVE_DEFAULT_PARTITION__", plain))
    elif case_from == "partition":
        lines = reader.schema("value string, case_id string").text(path)
    else:
        lines = reader.text(path).withColumn("case_id", F.col("_metadata.file_path"))
    parsed = F.from_json("value", LEDGER_LINE)
    return lines.select(
        "case_id", F.col("value").alias("line"),
        F.struct(F.coalesce(F.regexp_extract("_metadata.file_path", r"/part=(\d+)/", 1).try_cast("bigint"),
                            F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint"),
                            F.lit(0)).alias("part"),
                 F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("start")).alias("chunk"),
        F.monotonically_increasing_id().alias("line_pos"),
        parsed.alias("entry")).select("case_id", "line", "chunk", "line_pos", "entry.*")


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """1-based line number per case: number within the split plus the lines of earlier splits."""
    return prefix_scan(lines, ["case_id"], "chunk", "line_pos", [Running("line_no", "count")])


def append_jsonl(events: DataFrame, order: str, segment_rows: int = SEGMENT_ROWS,
                 tips: DataFrame | None = None) -> DataFrame:
    """Sequence numbers and hashes for entries to come.

    Needs case_id, event, ts and canonical ``data``; adds seq, prev and hash. Cases listed in ``tips``
    (case_id, seq, hash) go on from there, others begin a new ledger.
    """
    placed = with_position(events, ["case_id"], order, out="seq")
    if tips is not None:
        before = tips.select("case_id", F.col("seq").alias("_before"))
        placed = skew_join(placed, before, ["case_id"], "left").withColumn(
            "seq", F.col("seq") + F.coalesce("_before", F.lit(0))).drop("_before")
    named = placed.withColumns({"_event": json_string(F.col("event")), "_ts": json_string(F.col("ts"))})
    rows = chain_rows(named, "seq", body_prefix(F.col("data"), F.col("_event")),
                      body_suffix(F.col("seq"), F.col("_ts")), segment_rows, sized_by=events, tips=tips)
    return (rows.withColumnsRenamed({"prev_hash": "prev", "entry_hash": "hash"})
            .drop("_event", "_ts"))


def ledger_lines(rows: DataFrame) -> DataFrame:
    """Canonical text of ledger rows."""
    c = F.col
    return rows.select("case_id", "seq", canonical_line(
        c("data"), json_string(c("event")), c("hash"), c("prev"), c("seq"), json_string(c("ts"))).alias("line"))


def write_ledger_jsonl(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Compressed text files below ``case_id=…/part=…``, each with ``file_rows`` consecutive lines. Never overwrites.
    A compressed file is one split, so ``file_rows`` also bounds what a reading task and a bucket hold.

    The part is arithmetic on ``seq``, so one exchange places the rows, a large case is written by
    many tasks, and no sampling pass computes the hashes a second time.
    """
    lines = ledger_lines(rows).withColumn("part", F.call_function("div", F.col("seq") - 1, F.lit(file_rows)))
    (lines.repartition("case_id", "part").sortWithinPartitions("case_id", "part", "seq")
     .select("case_id", "part", "line").write.mode("errorifexists")
     .option("compression", "gzip").partitionBy("case_id", "part").text(path))
