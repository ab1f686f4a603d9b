"""Licences and trial clocks from live feeds."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.licences import trial_active, trial_days_left
from ..operators.entitlements import build_licenses, licence_columns, paid_sessions, with_plan
from ..session import child_names, path_exists, remove_path
from .runtime import use_rocksdb

#: Days for which an issued session is remembered.
KEEP_DAYS = 90


class FirstPayment(StatefulProcessor):
    """Passes on the earliest row of a session once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.issued = handle.getValueState("issued", "done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if not len(pdf):
                continue
            top = pdf.sort_values(["recv_order", "type_order"], kind="stable").iloc[[0]]
            if first is None or (top["recv_order"].iloc[0], top["type_order"].iloc[0]) < (first["recv_order"].iloc[0], first["type_order"].iloc[0]):
                first = top
        if first is not None and not self.issued.exists():
            self.issued.update((True,))
            yield first.drop(columns=["recv_order", "type_order"])

    def close(self) -> None:
        pass


def issue_licenses(events: DataFrame, plans: DataFrame, product: str) -> DataFrame:
    """One licence per paid session, however late its event comes; of the events of one micro-batch the earliest
    decides. Unpaid events are dropped before, so a later payment of the same session still issues. Every issued
    session is remembered by one flag, without a time limit; ``issue_once`` forgets after 90 days."""
    use_rocksdb(events.sparkSession)
    planned = with_plan(paid_sessions(events), plans, product)
    rows = licence_columns(planned, product, F.unix_micros("recv_ts").alias("recv_order"), F.col("type").alias("type_order"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("recv_order", "type_order"))
    return rows.groupBy("order").transformWithStateInPandas(
        statefulProcessor=FirstPayment(), outputStructType=out, outputMode="Append", timeMode="None")


class IssueOnce:
    """Handler of micro-batches that issues each session once within ``keep_days``.

    Below ``path``, ``licences/batch=…`` holds what each batch issued, for good, and ``issued/day=…/…`` the ids to
    remember, by the day the clock stood at. The clock is the latest receiving day seen, so it never goes back. A batch
    leaves out sessions that are listed within ``keep_days`` before their own day, and days older than that before the
    clock are dropped whole: what is remembered, and what a batch reads, is bounded by the sessions of ``keep_days``
    days. A repeated batch overwrites its own folders and does not look at them, so it issues what it issued before.
    """

    def __init__(self, plans: DataFrame, product: str, path: str, keep_days: int = KEEP_DAYS) -> None:
        self.plans, self.product, self.path, self.keep_days = plans, product, path.rstrip("/"), keep_days

    def _days(self, spark: SparkSession) -> list[datetime.date]:
        return [datetime.date.fromisoformat(n.removeprefix("day=")) for n in child_names(spark, f"{self.path}/issued")
                if n.startswith("day=")]

    def _day(self, day: datetime.date) -> str:
        return f"{self.path}/issued/day={day.isoformat()}"

    def _merge(self, spark: SparkSession, day: datetime.date) -> None:
        """One folder for a day that is over, instead of one for each of its batches."""
        names = [n for n in child_names(spark, self._day(day)) if n.startswith("batch=")]
        merged = f"{self._day(day)}/all"
        if not path_exists(spark, f"{merged}/_SUCCESS"):
            if len(names) < 2:
                return
            spark.read.parquet(*[f"{self._day(day)}/{n}" for n in names]).coalesce(1).write.mode("overwrite").parquet(merged)
        for name in names:
            remove_path(spark, f"{self._day(day)}/{name}")

    def _remembered(self, spark: SparkSession, days: list[datetime.date], own: str) -> DataFrame | None:
        """(order, day) of the sessions on record, without those of the batch at hand."""
        out = None
        for day in days:
            paths = [f"{self._day(day)}/{n}" for n in child_names(spark, self._day(day)) if n != own and not n.startswith(("_", "."))]
            if paths:
                part = spark.read.schema("`order` string").parquet(*paths).withColumn("day", F.lit(day))
                out = part if out is None else out.unionByName(part)
        return out

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"batch={batch_id:012d}"
        latest = batch.agg(F.max(F.to_date("recv_ts"))).first()[0]
        if latest is None:
            return
        known = [d for d in self._days(spark) if any(n != own and not n.startswith(("_", ".")) for n in child_names(spark, self._day(d)))]
        before = max(known, default=None)
        for day in known:
            if before - day > datetime.timedelta(self.keep_days):
                remove_path(spark, self._day(day))
            elif day != before:
                self._merge(spark, day)
        kept = [d for d in known if before - d <= datetime.timedelta(self.keep_days)]
        fresh = build_licenses(batch, self.plans, self.product)
        seen = self._remembered(spark, kept, own)
        if seen is not None:
            fresh = fresh.join(seen.withColumnRenamed("order", "__order"), (F.col("order") == F.col("__order"))
                               & (F.col("day") >= F.date_sub("issued", self.keep_days)), "left_anti")
        folder = f"{self.path}/licences/{own}"
        fresh.write.mode("overwrite").parquet(folder)
        clock = latest if before is None else max(latest, before)
        spark.read.schema(fresh.schema).parquet(folder).select("order").write.mode("overwrite").parquet(f"{self._day(clock)}/{own}")


def issue_once(events: DataFrame, plans: DataFrame, product: str, path: str, checkpoint: str,
               keep_days: int = KEEP_DAYS, **trigger) -> StreamingQuery:
    """Starts issuing licences from a live feed into ``path``; see ``IssueOnce``. The query keeps no state of its own."""
    return (events.writeStream.foreachBatch(IssueOnce(plans, product, path, keep_days))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def issued_licences(spark: SparkSession, path: str) -> DataFrame:
    """Everything issued so far."""
    return spark.read.parquet(f"{path.rstrip('/')}/licences").drop("batch")


class TrialClock(StatefulProcessor):
    """State per install: first time seen and the latest; the clock only moves forward."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", "started bigint, last_seen bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, latest, order, count = None, None, None, 0
        for pdf in rows:
            at = pdf["arrival"].idxmin()
            if order is None or pdf["arrival"][at] < order:
                order, first = pdf["arrival"][at], int(pdf["observed_ms"][at])
            top = int(pdf["observed_ms"].max())
            latest = top if latest is None else max(latest, top)
            count += len(pdf)
        if self.state.exists():
            started, last_seen = self.state.get()
            last_seen = max(last_seen, latest)
        else:
            started, last_seen = first, latest
        self.state.update((started, last_seen))
        yield pd.DataFrame({"install_id": [key[0]], "started_ms": [started], "last_seen_ms": [last_seen]})

    def close(self) -> None:
        pass


def trial_stream(observations: DataFrame) -> DataFrame:
    """Trial state per install and micro-batch."""
    use_rocksdb(observations.sparkSession)
    key_type = observations.schema["install_id"].dataType.simpleString()
    states = observations.select("install_id", "arrival", "observed_ms").groupBy("install_id").transformWithStateInPandas(
        statefulProcessor=TrialClock(), outputStructType=f"install_id {key_type}, started_ms bigint, last_seen_ms bigint",
        outputMode="Append", timeMode="None")
    c = F.col
    return states.withColumns({"active": trial_active(c("started_ms"), c("last_seen_ms")),
                               "days_left": trial_days_left(c("started_ms"), c("last_seen_ms"))})
