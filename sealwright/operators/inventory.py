"""Acquisition: inventory, manifest rows, skips, duplicates and output names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import files as fx
from ..functions.hashing import sha256_hex
from ..session import broadcast_if_small, spread, stage
from .joins import skew_join
from .ordered import Running, bucket_of, prefix_scan, range_bucketed, with_position

CASE_MAX_FILES = 5
CASE_MAX_BYTES = 1024 * 1024


def with_skips(inventory: DataFrame, limit: int = fx.LIMIT_ACQUIRE) -> DataFrame:
    """Adds ``reason``. Needs case_id, path, root, file_kind and length; folders are left out."""
    outside = fx.escapes_root(F.col("path"), F.col("root"))
    return (inventory.where(F.col("file_kind") != "dir")
            .withColumn("reason", fx.skip_reason(F.col("file_kind"), outside, F.col("length"), limit)))


def acquire(inventory: DataFrame, limit: int = fx.LIMIT_ACQUIRE, sniff_bytes: int = 16) -> DataFrame:
    """Manifest rows of accepted files: one narrow pass over names and bytes, no shuffle."""
    kept = with_skips(inventory, limit).where(F.col("reason").isNull())
    rel = fx.relative_path(F.col("path"), F.col("root"))
    hashed = kept.select(
        "case_id", F.col("path").alias("source_path"), rel.alias("relative_path"),
        F.col("length").alias("size_bytes"), sha256_hex(F.col("content")).alias("sha256"),
        fx.claimed_extension(rel).alias("claimed_extension"),
        fx.magic_hint(F.col("content"), sniff_bytes).alias("magic_hint"))
    return hashed.withColumn("vault_relpath", fx.blob_name(F.col("sha256")))


def acquisition_events(manifest: DataFrame, cases: DataFrame, digests: DataFrame) -> DataFrame:
    """What acquisition writes to the ledgers, ready for ``build_pipe``: per case its opening, one sealing per accepted
    file in path order, and the writing of the manifest: case_id, id (from 1), ts, operator, action, path, sha256.

    ``cases``: case_id, operator, source_root, created_unix; a case without files has two events. ``digests``: case_id
    and the sha256 of the manifest file. Files are numbered over range partitions, so a case of any size spreads.
    """
    c = F.col
    placed = range_bucketed(manifest.select("case_id", "relative_path", "sha256"), ["case_id"], ["relative_path", "sha256"])
    numbered = prefix_scan(placed, ["case_id"], "_bucket", "_ord", [Running("n", "count")])
    sized = broadcast_if_small(cases.join(manifest.groupBy("case_id").agg(F.count(F.lit(1)).alias("files")), "case_id", "left")
                               .join(digests.select("case_id", c("sha256").alias("manifest_sha256")), "case_id", "left"))
    stamp = (c("created_unix").alias("ts"), c("operator"))
    sealed = skew_join(numbered, sized.select("case_id", "created_unix", "operator"), ["case_id"]).select(
        "case_id", (c("n") + 1).alias("id"), *stamp, F.lit("ingest-seal").alias("action"), c("relative_path").alias("path"), "sha256")
    ends = sized.select("case_id", *stamp, F.inline(F.array(
        F.struct(F.lit(1).cast("bigint").alias("id"), F.lit("case-open").alias("action"), c("source_root").alias("path"),
                 F.sha2("case_id", 256).alias("sha256")),
        F.struct((F.coalesce("files", F.lit(0)) + 2).alias("id"), F.lit("manifest-write").alias("action"),
                 F.lit("manifest.json").alias("path"), c("manifest_sha256").alias("sha256")))))
    return sealed.unionByName(ends)


def acquire_summary(inventory: DataFrame, verdict: DataFrame, limit: int = fx.LIMIT_ACQUIRE) -> DataFrame:
    """Acquired and skipped counts per case beside the ledger's event count and chain verdict."""
    counted = with_skips(inventory, limit).groupBy("case_id").agg(
        F.count_if(F.col("reason").isNull()).alias("acquired"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped"))
    seen = verdict.select("case_id", F.col("entries").alias("events"), "chain_ok")
    return counted.join(seen, "case_id", "left").select(
        "case_id", "acquired", "skipped", F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("chain_ok", F.lit(False)).alias("chain_ok"))


def skip_summary(inventory: DataFrame, limit: int = fx.LIMIT_ACQUIRE) -> DataFrame:
    return (with_skips(inventory, limit).where(F.col("reason").isNotNull())
            .groupBy("case_id", "reason").agg(F.count(F.lit(1)).alias("files")))


def over_cap(inventory: DataFrame, max_files: int = CASE_MAX_FILES, max_bytes: int = CASE_MAX_BYTES) -> DataFrame:
    """Cases above the trial caps on file count or file size."""
    return (inventory.where(F.col("file_kind") == "file").groupBy("case_id")
            .agg(F.count(F.lit(1)).alias("files"), F.max("length").alias("largest"))
            .where((F.col("files") > max_files) | (F.col("largest") > max_bytes)))


def duplicate_content(manifest: DataFrame) -> DataFrame:
    """Digests held by more than one path: exhibits against distinct blobs."""
    return (manifest.groupBy("sha256")
            .agg(F.count(F.lit(1)).alias("exhibits"), F.min("source_path").alias("first_path"),
                 F.max("source_path").alias("last_path"))
            .where("exhibits > 1"))


def magic_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("claimed_extension", "magic_hint").agg(F.count(F.lit(1)).alias("files"))


def new_only(inputs: DataFrame, sealed: DataFrame) -> DataFrame:
    """Inputs whose digest has not been sealed before."""
    return skew_join(inputs, sealed.select("sha256").distinct(), ["sha256"], "left_anti")


# ---- output names -----------------------------------------------------------------------

_NUMBERED = r"(?s)^(.+)-([1-9]\d{0,17})$"


#: Numbers of one name that a task walks in a row, streamed.
SEGMENT_ROWS = 5_000_000


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which contested numbers a name loses; rows come by (name, number). A number is lost if, with the numbers lost
    before it, the name's inputs get to it too late. One count per name is held; ``lost`` of a name's first row is what
    earlier segments lost."""
    name, lost = None, 0
    for batch in batches:
        out = []
        for key, room, carried in zip(*(batch.column(c).to_pylist() for c in ("name", "room", "carried"))):
            if key != name:
                name, lost = key, carried
            out.append(lost <= room)
            lost += out[-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "number", "child")), pa.array(out, pa.bool_())],
                                         names=["name", "number", "child", "gone"])


def _contest(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Adds ``gone`` to contested numbers (name, number, child, room), a segment of every name after the other."""
    schema = "name string, number bigint, child string, gone boolean"
    longest = rows.groupBy("name").count().agg(F.max("count")).first()[0] or 0
    walk = lambda part: spread(part, "name").sortWithinPartitions("name", "number").mapInArrow(_lost, schema)
    if longest <= segment_rows:
        return stage(walk(rows.withColumn("carried", F.lit(0).cast("bigint"))), "contested")
    placed = stage(with_position(rows, ["name"], "number", out="_pos").withColumn(
        "_seg", F.floor((F.col("_pos") - 1) / segment_rows).cast("int")), "contest")
    done = None
    for k in range(-(-longest // segment_rows)):
        part = placed.where(F.col("_seg") == k)
        if done is None:
            part = part.withColumn("carried", F.lit(0).cast("bigint"))
        else:
            before = done.groupBy("name").agg(F.count_if("gone").alias("carried"))
            part = part.join(before, "name")
        out = stage(walk(part.select("name", "number", "child", "room", "carried")), f"contested-{k}")
        done = out if done is None else done.unionByName(out)
    return done


def _contested(inputs: DataFrame, used: DataFrame, names: DataFrame, segment_rows: int) -> DataFrame | None:
    """(name, number) pairs that are taken by the inputs themselves; None where no input is named like a numbered other.

    The first input named ``name-7`` takes that name, unless an input of ``name`` was given it before. With the taken
    numbers below 7 known, and the inputs of ``name`` before that one, this is settled for all numbers of a name by one
    walk in order of the numbers; names are settled from the shortest of a family on, since ``name-7`` has numbers, too.
    """
    c = F.col
    firsts = inputs.groupBy(c("name").alias("child")).agg(F.min("path").alias("first"))
    kids = firsts.select(F.regexp_extract("child", _NUMBERED, 1).alias("name"),
                         F.regexp_extract("child", _NUMBERED, 2).try_cast("bigint").alias("number"), "child", "first").where("name <> ''")
    kids = kids.join(names, "name", "left_semi")
    if kids.isEmpty():
        return None
    used = stage(used, "used-names")
    kids = stage(kids.join(used, ["name", "number"], "left_anti"), "numbered-inputs")
    parents = kids.select("name").distinct()
    none = F.lit(None).cast("bigint")
    marks = skew_join(inputs.select("name", "path"), parents, ["name"], "left_semi").select(
        "name", "path", none.alias("number"), F.lit(1).alias("mine")).unionByName(
        kids.select("name", c("first").alias("path"), "number", F.lit(0).alias("mine")))
    counted = prefix_scan(range_bucketed(marks, ["name"], ["path"]), ["name"], "_bucket", "_ord",
                          [Running("before", "sum", c("mine"), inclusive=False)]).where("number is not null").select("name", "number", "before")
    below = used.join(parents, "name", "left_semi").select("name", "number", F.lit(1).alias("there"), none.alias("before")).unionByName(
        counted.select("name", "number", F.lit(0).alias("there"), "before")).withColumn("bucket", bucket_of(c("number")))
    free = prefix_scan(below, ["name"], "bucket", "number", [Running("under", "sum", c("there"), inclusive=False)]).where(
        "there = 0").select("name", "number", (c("number") - c("under") - c("before")).alias("room"))
    waiting = stage(kids.select("name", "number", "child").join(free, ["name", "number"]), "contests")
    taken = None
    while True:
        behind = waiting.select(c("child").alias("name")).distinct()
        ready = waiting.join(behind, "name", "left_anti")
        # a name whose bare form went to a numbered other has one number less
        bare = taken.where("number = 0") if taken is not None else names.select("name", F.lit(0).cast("bigint").alias("number")).limit(0)
        ready = ready.join(bare.select("name", F.lit(1).alias("lost")), "name", "left").withColumn(
            "room", c("room") - F.coalesce("lost", F.lit(0))).drop("lost")
        settled = _contest(ready, segment_rows)
        mine = settled.select(F.when(c("gone"), c("name")).otherwise(c("child")).alias("name"),
                              F.when(c("gone"), c("number")).otherwise(F.lit(0)).alias("number"))
        taken = mine if taken is None else taken.unionByName(mine)
        waiting = stage(waiting.join(settled.select("name").distinct(), "name", "left_anti"), "contests")
        if waiting.isEmpty():
            return taken


def assign_names(inputs: DataFrame, existing: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """A unique output stem per input: ``name``, ``name-1``, ``name-2`` … avoiding ``existing``.

    Inputs (name, path) are taken in path order, paths are unique. The k-th input of a name gets
    the k-th free number, found by counting taken numbers below it; both counts run over buckets,
    so a name shared by a third of all inputs stays spread out. Numbers that inputs contest among
    each other, because one is named like the numbered form of another, are settled before
    (``_contested``); no task walks more than ``segment_rows`` of them for a name.
    """
    names = inputs.select("name").distinct()
    taken = existing.select("name").distinct()
    used = taken.select(F.col("name"), F.lit(0).cast("bigint").alias("number")).unionByName(
        taken.select(F.regexp_extract("name", _NUMBERED, 1).alias("name"),
                     F.regexp_extract("name", _NUMBERED, 2).try_cast("bigint").alias("number")).where("name <> ''"))
    used = used.join(names, "name", "left_semi")
    contested = _contested(inputs, used, names, segment_rows)
    if contested is not None:
        used = stage(used.unionByName(contested).distinct(), "used-names")

    placed = range_bucketed(inputs.select("name", "path"), ["name"], ["path"])
    ranked = prefix_scan(placed, ["name"], "_bucket", "_ord", [Running("rank", "count", inclusive=False)])
    below = with_position(used, ["name"], "number", out="k")
    steps = below.groupBy("name", (F.col("number") - F.col("k") + 1).alias("rank")).agg(
        F.count(F.lit(1)).alias("step"))
    events = steps.select("name", (F.col("rank") * 2).alias("at"), "step", F.lit(None).cast("string").alias("path")) \
        .unionByName(ranked.select("name", (F.col("rank") * 2 + 1).alias("at"), F.lit(0).cast("bigint").alias("step"),
                                   "path"))
    counted = prefix_scan(events.withColumn("bucket", bucket_of(F.col("at"))), ["name"], "bucket", "at",
                          [Running("shift", "sum", F.col("step"))])
    number = F.floor(F.col("at") / 2) + F.col("shift")
    return counted.where(F.col("path").isNotNull()).select(
        "path", "name", F.when(number == 0, F.col("name"))
        .otherwise(F.concat("name", F.lit("-"), number.cast("string"))).alias("stem"))
