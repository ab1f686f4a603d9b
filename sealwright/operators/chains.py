"""Hash-chained custody ledgers: build, verify, heads and the checks around them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.canonical import line_hash_ok
from ..functions.hashing import (GENESIS, ambiguous_material, concat_material, pipe_material,
                                 pipe_prefix, sha256_hex)
from ..session import broadcast_if_small, spread, stage
from .joins import skew_join
from .ordered import BUCKET_ROWS, bucket_of, with_position

SEGMENT_ROWS = 5_000_000      # rows of one case a task hashes in a row, streamed
FOLD_ROWS = 100_000           # rows of one case folded as one array


# ---- row checks -------------------------------------------------------------------------

def _normalised(ledger: DataFrame, dialect: str, bucket_rows: int) -> DataFrame:
    """One shape for all dialects, hash check done per row before any shuffle.

    Columns: case_id, ord, bucket, prev, hash, hash_ok, seq (null where the dialect has none).
    """
    c = F.col
    if dialect == "pipe":
        digest = sha256_hex(pipe_material(c("ts"), c("operator"), c("action"), c("path"),
                                          c("sha256"), c("prev_hash")))
        return ledger.select("case_id", c("id").alias("ord"),
                             bucket_of(c("id"), bucket_rows).alias("bucket"),
                             c("prev_hash").alias("prev"), c("entry_hash").alias("hash"),
                             F.coalesce(digest == c("entry_hash"), F.lit(False)).alias("hash_ok"),
                             F.lit(None).cast("bigint").alias("seq"))
    if dialect == "concat":
        digest = sha256_hex(concat_material(c("hash_prev"), c("timestamp"), c("hash_data")))
        return ledger.select("case_id", c("id").alias("ord"),
                             bucket_of(c("id"), bucket_rows).alias("bucket"),
                             c("hash_prev").alias("prev"), c("hash_chain").alias("hash"),
                             F.coalesce(digest == c("hash_chain"), F.lit(False)).alias("hash_ok"),
                             F.lit(None).cast("bigint").alias("seq"))
    if dialect == "jsonl":
        return ledger.select("case_id", c("line_pos").alias("ord"), c("chunk").alias("bucket"),
                             "prev", "hash", line_hash_ok(c("line"), c("hash")).alias("hash_ok"),
                             F.coalesce(c("seq"), F.lit(-1)).alias("seq"))
    raise ValueError(f"unknown dialect: {dialect}")


def hash_ok(ledger: DataFrame, dialect: str = "pipe") -> DataFrame:
    """Adds ``hash_ok``, and ``ambiguous_material`` in the pipe dialect. No shuffle."""
    c = F.col
    if dialect == "pipe":
        digest = sha256_hex(pipe_material(c("ts"), c("operator"), c("action"), c("path"),
                                          c("sha256"), c("prev_hash")))
        return ledger.withColumns({
            "hash_ok": digest == c("entry_hash"),
            "ambiguous_material": ambiguous_material(c("operator"), c("action"), c("path"),
                                                     c("sha256"))})
    if dialect == "concat":
        digest = sha256_hex(concat_material(c("hash_prev"), c("timestamp"), c("hash_data")))
        return ledger.withColumn("hash_ok", digest == c("hash_chain"))
    if dialect == "jsonl":
        return ledger.withColumn("hash_ok", line_hash_ok(c("line"), c("hash")))
    raise ValueError(f"unknown dialect: {dialect}")


def link_ok(ledger: DataFrame, dialect: str = "pipe", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: does the stored previous hash equal the hash of the row before it?"""
    rows = _normalised(ledger, dialect, bucket_rows)
    inside = Window.partitionBy("case_id", "bucket").orderBy("ord")
    first = F.row_number().over(inside) == 1
    rows = rows.select("case_id", "bucket", "ord", "prev", "hash", F.lag("hash").over(inside).alias("before"),
                       first.alias("is_first"))
    edges = (_normalised(ledger, dialect, bucket_rows).groupBy("case_id", "bucket")
             .agg(F.max_by("hash", "ord").alias("last_hash")))
    edges = edges.select("case_id", "bucket", F.lag("last_hash").over(
        Window.partitionBy("case_id").orderBy("bucket")).alias("edge"))
    joined = rows.join(edges, ["case_id", "bucket"], "left")
    expected = F.coalesce(F.when(F.col("is_first"), F.col("edge")).otherwise(F.col("before")),
                          F.lit(GENESIS))
    return joined.select("case_id", F.col("ord").alias("id"),
                         F.coalesce(F.col("prev") == expected, F.lit(False)).alias("link_ok"))


def seq_ok(lines: DataFrame) -> DataFrame:
    """Sequence check of numbered lines: position in the file, not ``seq``, is the order."""
    return lines.withColumn("seq_ok", F.coalesce(F.col("seq") == F.col("line_no"), F.lit(False)))


# ---- verification -----------------------------------------------------------------------

def _bucket_summary(rows: DataFrame) -> DataFrame:
    """One row per (case, bucket). The group-by reuses the window's exchange and sort."""
    w = Window.partitionBy("case_id", "bucket").orderBy("ord")
    c = F.col
    marked = rows.select("case_id", "bucket", "ord", "prev", "hash", "hash_ok", "seq",
                         F.row_number().over(w).alias("pos"), F.lag("hash").over(w).alias("before"),
                         F.first("seq").over(w).alias("seq0"))
    linked = (c("pos") == 1) | F.coalesce(c("prev") == c("before"), F.lit(False))
    counted = c("seq").isNull() | (c("seq") - c("seq0") == c("pos") - 1)
    bad = ~(c("hash_ok") & linked & counted)
    marked = marked.withColumn("bad_pos", F.when(bad, c("pos")))
    return marked.groupBy("case_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("prev", "pos").alias("first_prev"), F.min_by("seq", "pos").alias("first_seq"),
        F.max_by("hash", "pos").alias("last_hash"),
        F.min("bad_pos").alias("bad_pos"),
        F.min_by("before", "bad_pos").alias("bad_before"),
        F.min_by("ord", "bad_pos").alias("bad_ord"), F.min_by("ord", "pos").alias("first_ord"))


def verify_chain(ledger: DataFrame, dialect: str = "pipe", bucket_rows: int = BUCKET_ROWS,
                 cases: DataFrame | None = None) -> DataFrame:
    """Verdict per case.

    ``valid_prefix`` counts the good rows before the first break, ``trusted_head`` is the last
    good hash, ``head`` the hash of the last row. A case listed in ``cases`` without any row
    does not verify.
    """
    summary = _bucket_summary(_normalised(ledger, dialect, bucket_rows))
    c = F.col
    across = Window.partitionBy("case_id").orderBy("bucket")
    placed = summary.select(
        "*",
        F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.coalesce(F.lag("last_hash").over(across), F.lit(GENESIS)).alias("edge"))
    edge_ok = (F.coalesce(c("first_prev") == c("edge"), F.lit(False))
               & (c("first_seq").isNull() | (c("first_seq") == c("offset") + 1)))
    local = F.when(~edge_ok, F.lit(1)).otherwise(c("bad_pos"))
    placed = placed.withColumns({
        "bad_at": c("offset") + local,
        "bad_after": F.when(local == 1, c("edge")).otherwise(c("bad_before")),
        "bad_id": F.when(~edge_ok, c("first_ord")).otherwise(c("bad_ord"))})
    out = placed.groupBy("case_id").agg(
        F.sum("n").alias("entries"), F.min("bad_at").alias("first_bad_position"),
        F.min_by("bad_after", "bad_at").alias("bad_after"),
        F.min_by("bad_id", "bad_at").alias("first_bad_id"),
        F.max_by("last_hash", "bucket").alias("head"))
    out = out.select(
        "case_id", "entries",
        F.coalesce(c("first_bad_position") - 1, c("entries")).alias("valid_prefix"),
        c("first_bad_position").isNull().alias("chain_ok"), "first_bad_position", "first_bad_id",
        "head", F.coalesce(c("bad_after"), c("head")).alias("trusted_head"))
    if cases is None:
        return out
    full = cases.select("case_id").join(out, "case_id", "left")
    return full.select("case_id", F.coalesce("entries", F.lit(0)).alias("entries"),
                       F.coalesce("valid_prefix", F.lit(0)).alias("valid_prefix"),
                       F.coalesce("chain_ok", F.lit(False)).alias("chain_ok"),
                       "first_bad_position", "first_bad_id",
                       F.coalesce("head", F.lit(GENESIS)).alias("head"),
                       F.coalesce("trusted_head", F.lit(GENESIS)).alias("trusted_head"))


def first_break(ledger: DataFrame, dialect: str = "pipe", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Broken cases only, with the position and id of the first bad row."""
    verdict = verify_chain(ledger, dialect, bucket_rows)
    return verdict.where(~F.col("chain_ok")).select(
        "case_id", "valid_prefix", "first_bad_position", "first_bad_id")


# ---- building ---------------------------------------------------------------------------

def _fold_batches(columns: Sequence[str]):
    """Partition iterator: rows arrive sorted by (case, position); only one tip is held. A row with a ``_start`` is no
    entry but the tip its case goes on from; it sorts before the entries. Columns that are not hashed stay in Arrow."""
    def run(batches):
        case, tip = None, None
        for batch in batches:
            prevs, hashes, entries = [], [], []
            for key, start, head, tail in zip(*(batch.column(c).to_pylist() for c in ("case_id", "_start", "_head", "_tail"))):
                if key != case:
                    case, tip = key, start or GENESIS
                entries.append(start is None)
                if start is None:
                    prevs.append(tip)
                    tip = hashlib.sha256((head + tip + tail).encode()).hexdigest()
                    hashes.append(tip)
            kept = batch if all(entries) else batch.filter(pa.array(entries, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in columns), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
                names=[*columns, "prev_hash", "entry_hash"])
    return run


def _after_tips(rows: DataFrame, tips: DataFrame | None) -> DataFrame:
    """``rows`` with one row before those of each case that carries the hash it goes on from. They travel with the rows
    of their case, so going on from tips takes no join."""
    bare = rows.withColumn("_start", F.lit(None).cast("string"))
    if tips is None:
        return bare
    starts = tips.select("case_id", F.col("hash").alias("_start"), F.lit(-2 ** 63).cast("bigint").alias("_pos"))
    return bare.unionByName(starts, allowMissingColumns=True)


def _in_order(rows: DataFrame, order: str) -> DataFrame:
    """Rows whose order and case can be chained, at every size alike: an order that is no integer is refused
    now, a null order or case when its row is read."""
    if not isinstance(rows.schema[order].dataType, T.IntegralType):
        raise TypeError(f"a chain needs an integer order, {order} is {rows.schema[order].dataType.simpleString()}")
    say = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a chain row has no {c}")).cast(rows.schema[c].dataType))
    return rows.withColumns({order: say(order), "case_id": say("case_id")})


def _segments(rows: DataFrame, order: str, segment_rows: int,
              sized_by: DataFrame | None = None) -> tuple[DataFrame, int]:
    rows = _in_order(rows, order)
    longest = (rows if sized_by is None else sized_by).groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, -(-longest // segment_rows))
    if rounds == 1:
        return rows.withColumn("_pos", F.col(order).cast("bigint")), 1
    placed = with_position(rows, ["case_id"], order, out="_pos")
    return placed.withColumn("_seg", F.floor((F.col("_pos") - 1) / F.lit(segment_rows)).cast("int")), rounds


def chain_rows(rows: DataFrame, order: str, head: Column, tail: Column,
               segment_rows: int = SEGMENT_ROWS, sized_by: DataFrame | None = None,
               tips: DataFrame | None = None) -> DataFrame:
    """Every row with its ``prev_hash`` and ``entry_hash = sha256(head ‖ prev ‖ tail)``.

    A hash chain is sequential within a case. Cases are therefore cut into segments: round k
    hashes segment k of every case that is that long and hands the tips to round k + 1, so no
    task ever walks more than ``segment_rows`` rows of a case and a lost executor repeats one
    segment only. With no case above ``segment_rows`` rows there is a single round. Case sizes are
    counted on ``sized_by`` where that is cheaper to read than ``rows``. Cases listed in ``tips``
    (case_id, hash; one row each) go on from there, others begin a new chain.
    """
    keep = [f for f in rows.schema.fields]
    names = [f.name for f in keep]
    out_schema = T.StructType(keep + [T.StructField("prev_hash", T.StringType()),
                                      T.StructField("entry_hash", T.StringType())])
    placed, rounds = _segments(rows.withColumns({"_head": head, "_tail": tail}), order, segment_rows, sized_by)

    def hashed(part: DataFrame, known: DataFrame | None, schema: T.StructType, columns) -> DataFrame:
        ordered = spread(_after_tips(part, known), "case_id").sortWithinPartitions("case_id", "_pos")
        return ordered.mapInArrow(_fold_batches(columns), schema)

    if rounds == 1:
        return hashed(placed, tips, out_schema, names)

    staged = stage(placed, "chain-segments", ("_seg",))
    wide = T.StructType(out_schema.fields[:-2] + [T.StructField("_pos", T.LongType())]
                        + out_schema.fields[-2:])
    done = []
    for k in range(rounds):
        out = stage(hashed(staged.where(F.col("_seg") == k), tips, wide, [*names, "_pos"]), f"chain-round{k}")
        tips = (out.where(F.col("_pos") == (k + 1) * segment_rows)
                .select("case_id", F.col("entry_hash").alias("hash")))
        done.append(out)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("_pos")


def build_pipe(events: DataFrame, order: str = "id", segment_rows: int = SEGMENT_ROWS,
               tips: DataFrame | None = None) -> DataFrame:
    """Ledger rows in the pipe dialect, going on from ``tips`` where a case has one."""
    c = F.col
    head = pipe_prefix(c("ts"), c("operator"), c("action"), c("path"), c("sha256"))
    return chain_rows(events, order, head, F.lit(""), segment_rows, tips=tips)


def chain_fold(events: DataFrame, order: str = "id", segment_rows: int = FOLD_ROWS) -> DataFrame:
    """Tip hash and row count per case, folded in the JVM without materialising row hashes."""
    c = F.col
    head = pipe_prefix(c("ts"), c("operator"), c("action"), c("path"), c("sha256"))
    slim = events.select("case_id", order, head.alias("_head"))
    placed, rounds = _segments(slim, order, segment_rows)

    def fold(part: DataFrame, start: Column) -> DataFrame:
        grouped = part.groupBy("case_id").agg(
            F.array_sort(F.collect_list(F.struct("_pos", "_head"))).alias("items"),
            F.first(start).alias("start"))
        return grouped.select(
            "case_id", F.size("items").cast("bigint").alias("n"),
            F.aggregate("items", F.col("start"),
                        lambda acc, x: F.sha2(F.concat(x["_head"], acc), 256)).alias("tip"))

    if rounds == 1:
        return fold(placed, F.lit(GENESIS)).select(
            "case_id", F.col("n").alias("entries"), F.col("tip").alias("head"))
    staged = stage(placed, "fold-segments", ("_seg",))
    tips = None
    for k in range(rounds):
        part = staged.where(F.col("_seg") == k)
        if tips is None:
            tips = stage(fold(part, F.lit(GENESIS)), "fold-round0")
            continue
        step = fold(part.join(tips.select("case_id", F.col("tip").alias("_start")), "case_id"),
                    F.col("_start"))
        merged = tips.alias("t").join(step.alias("s"), "case_id", "left").select(
            "case_id", (F.col("t.n") + F.coalesce(F.col("s.n"), F.lit(0))).alias("n"),
            F.coalesce(F.col("s.tip"), F.col("t.tip")).alias("tip"))
        tips = stage(merged, f"fold-round{k}")
    return tips.select("case_id", F.col("n").alias("entries"), F.col("tip").alias("head"))


# ---- reports on ledgers -----------------------------------------------------------------

def _place(dialect: str) -> Column:
    """What orders the entries of a case."""
    if dialect == "jsonl":
        return F.struct("chunk", "line_pos")
    if dialect in ("pipe", "concat"):
        return F.col("id")
    raise ValueError(f"unknown dialect: {dialect}")


def _digest_column(dialect: str) -> str:
    return {"pipe": "entry_hash", "concat": "hash_chain", "jsonl": "hash"}[dialect]


def heads(ledger: DataFrame, dialect: str = "pipe") -> DataFrame:
    """Last hash per case."""
    return ledger.groupBy("case_id").agg(F.max_by(_digest_column(dialect), _place(dialect)).alias("head"),
                                         F.count(F.lit(1)).alias("entries"))


def tips_of(ledger: DataFrame, dialect: str = "pipe") -> DataFrame:
    """(case_id, seq, hash) of the last entry of every case: where an append goes on."""
    return heads(ledger, dialect).select("case_id", F.col("entries").alias("seq"), F.col("head").alias("hash"))


def verify_with_heads(ledger: DataFrame, pinned: DataFrame, dialect: str = "pipe") -> DataFrame:
    """One verdict per pinned case (case_id, head): the chain holds, and it ends in the head recorded elsewhere. A tail
    that was cut off, or written anew as a whole, shows only here. A missing ledger is not ok."""
    verdict = verify_chain(ledger, dialect, cases=pinned.select("case_id"))
    expected = pinned.select("case_id", F.col("head").alias("expected_head"))
    return verdict.join(expected, "case_id").withColumns({
        "head_ok": F.col("head") == F.col("expected_head"),
        "ok": F.col("chain_ok") & (F.col("head") == F.col("expected_head"))})


def check_heads(current: DataFrame, pinned: DataFrame) -> DataFrame:
    """Heads recorded elsewhere against the ledger's heads; a missing ledger is not ok."""
    found = broadcast_if_small(current.select("case_id", "head"))
    return (pinned.select("case_id", F.col("head").alias("expected_head"))
            .join(found, "case_id", "left")
            .withColumn("head_ok", F.col("expected_head").eqNullSafe(F.col("head"))))


def recent_entries(ledger: DataFrame, n: int = 500, dialect: str = "pipe") -> DataFrame:
    """The newest ``n`` entries per case (planned as a partial group limit before the shuffle)."""
    w = Window.partitionBy("case_id").orderBy(F.desc("id") if dialect != "jsonl" else _place(dialect).desc())
    return (ledger.withColumn("recency", F.row_number().over(w))
            .where(F.col("recency") <= n))


def events_in_order(ledger: DataFrame, dialect: str = "pipe") -> DataFrame:
    return ledger.orderBy("case_id", _place(dialect))


def event_profile(ledger: DataFrame) -> DataFrame:
    """Event counts per case: one open, N ingests, one manifest write, N + 2 in total."""
    def hits(action: str) -> Column:
        return F.count_if(F.col("action") == action)
    counted = ledger.groupBy("case_id").agg(
        hits("case-open").alias("opens"), hits("ingest-seal").alias("ingests"),
        hits("manifest-write").alias("manifest_writes"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn(
        "profile_ok", (F.col("opens") == 1) & (F.col("manifest_writes") == 1)
        & (F.col("total") == F.col("ingests") + 2))


def unique_violations(df: DataFrame, *key: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def attach_case(ledger: DataFrame, cases: DataFrame) -> DataFrame:
    """Ledger rows with their case; rows without one are left to ``orphan_entries``."""
    return skew_join(ledger, cases, ["case_pk"], "inner")


def orphan_entries(ledger: DataFrame, cases: DataFrame) -> DataFrame:
    return skew_join(ledger, cases.select("case_pk"), ["case_pk"], "left_anti")
