"""A ledger that grows by batches, each added once however often it is tried."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.chains import build_pipe, tips_of
from ..session import child_names, path_exists, remove_path
from .ledgers import append_jsonl, read_ledger_jsonl, write_ledger_jsonl

_BASE = "base"


class LedgerStore:
    """Batches below ``root``, in the pipe dialect (Parquet rows) or the JSONL dialect (text lines).

    Batches are numbered, or named so that their names sort as they come. A batch folder holds the entries and, written last, their tips: one (case_id, seq, hash) row per case of the batch.
    The batch counts from the moment its tips are complete. Entries without tips are what a failed try left; no reader
    sees them, and the next try removes them. So trying a batch again adds nothing once it is in, and a case goes on
    from its highest tip. One writer at a time, as with any ledger; batches come in the order of their entries.

    ``base`` is the path of a ledger written elsewhere that this store continues. It is read whole once, for its tips.
    """

    def __init__(self, spark: SparkSession, root: str, dialect: str = "pipe", base: str | None = None) -> None:
        if dialect not in ("pipe", "jsonl"):
            raise ValueError(f"unknown dialect: {dialect}")
        self.spark, self.root, self.dialect, self.base = spark, root.rstrip("/"), dialect, base

    def _folder(self, batch: str) -> str:
        return f"{self.root}/batches/{batch}"

    def committed(self) -> list[str]:
        """Names of the batches that count."""
        return [name for name in child_names(self.spark, f"{self.root}/batches")
                if path_exists(self.spark, f"{self._folder(name)}/tips/_SUCCESS")]

    def _read(self, paths: list[str]) -> DataFrame:
        if self.dialect == "pipe":
            return self.spark.read.parquet(*paths)
        # batches follow each other by name, the base comes first; parts count within each
        batch = F.regexp_extract("chunk.file", r"(?s)^.*/batches/([A-Za-z0-9-]+)/rows/", 1).alias("batch")
        return read_ledger_jsonl(self.spark, paths).withColumn("chunk", F.struct(batch, F.col("chunk.part"), F.col("chunk.file"), F.col("chunk.start")))

    def _adopt(self, committed: list[str]) -> None:
        if self.base is not None and _BASE not in committed:
            remove_path(self.spark, self._folder(_BASE))
            tips_of(self._read([self.base]), self.dialect).write.parquet(f"{self._folder(_BASE)}/tips")

    def tips(self) -> DataFrame | None:
        """(case_id, seq, hash) of every case so far; None for an empty ledger."""
        self._adopt(self.committed())
        paths = [f"{self._folder(name)}/tips" for name in self.committed()]
        if not paths:
            return None
        return self.spark.read.parquet(*paths).groupBy("case_id").agg(
            F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))

    def append(self, events: DataFrame, batch: int | str, order: str) -> bool:
        """Chains ``events`` and adds them as ``batch``; False, and nothing done, if it is in already.

        ``order`` is an integer column, rising over all batches of a case in the pipe dialect.
        """
        name = f"{batch:012d}" if isinstance(batch, int) else batch
        if not re.fullmatch(r"[A-Za-z0-9-]+", name) or name == _BASE:
            raise ValueError(f"no name for a batch: {name}")
        if name in self.committed():
            return False
        tips, folder = self.tips(), self._folder(name)
        remove_path(self.spark, folder)
        if self.dialect == "jsonl":
            write_ledger_jsonl(append_jsonl(events, order, tips=tips), f"{folder}/rows")
        else:
            build_pipe(events, order, tips=tips).write.parquet(f"{folder}/rows")
        added = tips_of(self._read([f"{folder}/rows"]), self.dialect) if self._holds(folder) else None
        if added is None:
            added = self.spark.range(0).select(F.lit("").alias("case_id"), F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("hash"))
        elif tips is not None:
            # a batch's tip counts the entries before it, too
            before = tips.select("case_id", F.col("seq").alias("before"))
            added = added.join(before, "case_id", "left").select(
                "case_id", (F.col("seq") + F.coalesce("before", F.lit(0))).alias("seq"), "hash")
        added.write.parquet(f"{folder}/tips")
        return True

    def _holds(self, folder: str) -> bool:
        """Whether a batch wrote entries; an empty JSONL batch has no case folders."""
        return any(not n.startswith(("_", ".")) for n in child_names(self.spark, f"{folder}/rows"))

    def rows(self) -> DataFrame:
        """All entries that count; JSONL lines as ``read_ledger_jsonl`` gives them, ``chunk`` with the batch before it."""
        paths = [] if self.base is None else [self.base]
        paths += [f"{self._folder(n)}/rows" for n in self.committed() if n != _BASE and self._holds(self._folder(n))]
        if not paths:
            raise FileNotFoundError(f"no entries in {self.root}")
        return self._read(paths)
