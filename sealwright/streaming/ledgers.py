"""Live custody ledgers: verification and appending with per-case state.

Verification sums up every bucket of a micro-batch before the shuffle by case, so a state handler sees one row per
``BUCKET_ROWS`` rows of a case. An appending handler must hash every entry of its case in order; bound its batch with
``maxFilesPerTrigger``, ``maxBytesPerTrigger`` or the Kafka offsets per trigger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.canonical import body_prefix, json_string, line_hash_ok
from ..functions.hashing import GENESIS, pipe_material, pipe_prefix, sha256_hex
from ..operators.ordered import bucket_of
from .runtime import use_rocksdb

VERDICT = "case_id string, seen bigint, valid_prefix bigint, chain_ok boolean, broken_at bigint, tip string, alert boolean"
APPENDED = "case_id string, order_no bigint, seq bigint, prev_hash string, entry_hash string, line string"
STRETCH = ("case_id string, ord bigint, n bigint, first_prev string, first_seq bigint, last_hash string, bad_pos bigint, "
           "bad_before string")

#: Rows of a case summed up as one in live verification.
BUCKET_ROWS = 10_000
#: Tasks that sum up, for each partition of the states; rows a task sends on at a time.
TASKS, SENT_ROWS = 4, 10_000


def _joined(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row: equal, or both null."""
    equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return equal.to_numpy(zero_copy_only=False)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary per (case, bucket) of a partition: what the state needs to go over the stretch in one step. Texts stay
    in Arrow."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    held.clear()
    table = table.sort_by([("case_id", "ascending"), ("bucket", "ascending"), ("ord", "ascending")]).combine_chunks()
    case, bucket, prev, digest = (table[c].combine_chunks() for c in ("case_id", "bucket", "prev", "hash"))
    ordinal, seq = table["ord"].to_numpy(), table["seq"].to_numpy()
    first = np.r_[True, ~(_same(case[1:], case[:-1]) & _same(bucket[1:], bucket[:-1]))]
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(case)]
    stretch = np.cumsum(first) - 1
    linked = first | np.r_[True, _same(prev[1:], digest[:-1])]
    place = np.arange(len(case)) - starts[stretch]
    counted = (seq == -1) | (seq - seq[starts][stretch] == place)
    bad = np.flatnonzero(~(table["hash_ok"].to_numpy(zero_copy_only=False).astype(bool) & linked & counted))
    broken, at = np.unique(stretch[bad], return_index=True)
    bad_pos, before = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    bad_pos[broken] = place[bad[at]] + 1
    before[broken] = np.where(bad_pos[broken] > 1, bad[at] - 1, -1)
    out = pa.RecordBatch.from_arrays(
        [case.take(pa.array(starts)), pa.array(ordinal[starts]), pa.array(ends - starts), prev.take(pa.array(starts)),
         pa.array(seq[starts]), digest.take(pa.array(ends - 1)), pa.array(bad_pos, mask=bad_pos == 0),
         digest.take(pa.array(before, mask=before < 0))],
        names=[c.split()[0] for c in STRETCH.split(", ")])
    for low in range(0, out.num_rows, SENT_ROWS):
        yield out.slice(low, SENT_ROWS)


class ChainWatch(StatefulProcessor):
    """State per case: rows seen, last good hash, length of the valid prefix, first broken position."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", "seen bigint, tip string, good bigint, broken bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen, tip, good, broken = self.state.get() or (0, GENESIS, 0, None)
        was_broken = broken is not None
        for r in sorted(rows, key=lambda r: r["ord"]):
            if broken is None:
                bad = r["bad_pos"]
                if r["first_prev"] != tip or (r["first_seq"] != -1 and r["first_seq"] != good + 1):
                    bad = 1
                if bad is None:
                    tip, good = r["last_hash"], good + r["n"]
                else:
                    broken = seen + bad
                    tip, good = tip if bad == 1 else r["bad_before"], good + bad - 1
            seen += r["n"]
        self.state.update((seen, tip, good, broken))
        yield Row(case_id=key[0], seen=seen, valid_prefix=good, chain_ok=broken is None, broken_at=broken, tip=tip,
                  alert=broken is not None and not was_broken)

    def close(self) -> None:
        pass


def stretches(rows: DataFrame, dialect: str = "pipe", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per case, bucket and micro-batch, as ``_stretches`` makes them. Row hashes are checked before the shuffle,
    which deals a case out by buckets, so no task sees a whole hot case."""
    c = F.col
    if dialect == "pipe":
        digest = sha256_hex(pipe_material(c("ts"), c("operator"), c("action"), c("path"), c("sha256"), c("prev_hash")))
        slim = rows.select("case_id", c("id").alias("ord"), c("prev_hash").alias("prev"), c("entry_hash").alias("hash"),
                           F.coalesce(digest == c("entry_hash"), F.lit(False)).alias("hash_ok"),
                           F.lit(-1).cast("bigint").alias("seq"))
    elif dialect == "jsonl":
        slim = rows.select("case_id", c("line_no").alias("ord"), "prev", "hash",
                           line_hash_ok(c("line"), c("hash")).alias("hash_ok"), F.coalesce("seq", F.lit(0)).alias("seq"))
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    slim = slim.withColumn("bucket", bucket_of(c("ord"), bucket_rows))
    # a task holds its rows to sort them, so they are dealt to more tasks than the states
    tasks = TASKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(tasks, "case_id", "bucket").mapInArrow(_stretches, STRETCH)


def verify_stream(rows: DataFrame, dialect: str = "pipe", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One verdict row per case and micro-batch; ``alert`` marks the batch of the first break.

    Entries are taken in order within a batch; one that comes after its successors is a break, so there is no watermark.
    """
    use_rocksdb(rows.sparkSession)
    return stretches(rows, dialect, bucket_rows).groupBy("case_id").transformWithState(
        statefulProcessor=ChainWatch(), outputStructType=VERDICT, outputMode="Append", timeMode="None")


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """Last verdict per case from the emitted rows."""
    return verdicts.groupBy("case_id").agg(F.max_by(F.struct(*[c for c in verdicts.columns if c != "case_id"]), "seen").alias("v")) \
        .select("case_id", "v.*")


class ChainAppend(StatefulProcessor):
    """State per case: last sequence number and tip. Rows carry the hash text before the previous
    hash (``head``) and, in the JSONL dialect, the quoted time stamp that closes the entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tip", "seq bigint, tip string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.state.update((int(initialState["seq"].iloc[0]), initialState["hash"].iloc[0]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq, tip = self.state.get() if self.state.exists() else (0, GENESIS)
        batch = _joined(rows, "order_no")
        seqs, prevs, hashes, lines = [], [], [], []
        for head, stamp in zip(batch["head"], batch["stamp"]):
            seq += 1
            prevs.append(tip)
            seqs.append(seq)
            tail = f'","seq":{seq},"ts":{stamp}}}' if stamp else ""
            digest = hashlib.sha256((head + tip + tail).encode()).hexdigest()
            if stamp:
                start = head.removesuffix(',"prev":"')
                lines.append(f'{start},"hash":"{digest}","prev":"{tip}{tail}')
            else:
                lines.append(None)
            hashes.append(digest)
            tip = digest
        self.state.update((seq, tip))
        yield pd.DataFrame({"case_id": key[0], "order_no": batch["order_no"].to_numpy(), "seq": seqs,
                            "prev_hash": prevs, "entry_hash": hashes, "line": pd.Series(lines, dtype=object)})

    def close(self) -> None:
        pass


def append_stream(events: DataFrame, order: str = "id", dialect: str = "pipe", tips: DataFrame | None = None) -> DataFrame:
    """Chains arriving events: sequence, previous hash and hash per event, and in the JSONL dialect
    the line to write. JSONL events need event, ts and canonical ``data``. A case listed in ``tips``
    (case_id, seq, hash; see ``chains.tips_of`` and ``LedgerStore.tips``) goes on from there; tips are read
    when the query starts for the first time, afterwards its state knows better."""
    use_rocksdb(events.sparkSession)
    c = F.col
    if dialect == "pipe":
        head = pipe_prefix(c("ts"), c("operator"), c("action"), c("path"), c("sha256"))
        stamp = F.lit("")
    elif dialect == "jsonl":
        head, stamp = body_prefix(c("data"), json_string(c("event"))), json_string(c("ts"))
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    slim = events.select("case_id", c(order).alias("order_no"), head.alias("head"), stamp.alias("stamp"))
    return slim.groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=ChainAppend(), outputStructType=APPENDED, outputMode="Append", timeMode="None",
        initialState=None if tips is None else tips.select("case_id", "seq", "hash").groupBy("case_id"))
