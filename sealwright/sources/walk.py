"""Evidence listing: every entry below one root per case, walked over the cluster.

Spark's own file sources list regular files only; acquisition must also report what it passes by. A task walks the
folders dealt to it, one after the other, until it has listed ``budget`` entries; folders it did not come to are dealt
out anew in the next round. So a deep or lopsided tree is spread after a round or two, nothing is listed on the driver,
and a lost executor repeats the folders of one task. Links are reported, never followed.

Roots on a mounted file system (plain paths and ``file:`` URIs; every executor must see them) tell links and special
files apart. Other URIs (HDFS, object stores) go through Arrow's file systems, which know files and folders.
"""

from __future__ import annotations

import datetime
import os
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..functions import files as fx
from ..session import stage

BUDGET = 50_000
#: Bytes of content a task holds before it passes them on; a single file may be larger.
HELD_BYTES = 32 << 20

ENTRY = "case_id string, root string, path string, file_kind string, length bigint, modificationTime timestamp, error string"
_ENTRY = pa.schema([("case_id", pa.string()), ("root", pa.string()), ("path", pa.string()), ("file_kind", pa.string()),
                    ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")), ("error", pa.string())])
_OPEN = "open"

Entry = tuple[str, str, int | None, datetime.datetime | None, str | None]


def _local(path: str) -> str | None:
    """The path on a mounted file system, or None for other stores."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def _time(seconds: float) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)


def _entries(folder: str) -> Iterator[Entry]:
    """(name, kind, length, time, error) of what lies in a folder, in no order."""
    mounted = _local(folder)
    if mounted is None:
        store, inner = fs.FileSystem.from_uri(folder)
        kinds = {fs.FileType.File: "file", fs.FileType.Directory: "dir"}
        for info in store.get_file_info(fs.FileSelector(inner, recursive=False)):
            yield info.base_name, kinds.get(info.type, "special"), info.size, info.mtime, None
        return
    with os.scandir(mounted) as found:
        for entry in found:
            try:
                entry.name.encode()
            except UnicodeEncodeError:
                # such a name cannot be written down, hence not acquired
                yield entry.name.encode("utf-8", "replace").decode(), "error", None, None, "name is not UTF-8"
                continue
            try:
                seen = entry.stat(follow_symlinks=False)
            except OSError as fault:
                yield entry.name, "error", None, None, fault.strerror
                continue
            kind = ("symlink" if stat.S_ISLNK(seen.st_mode) else "dir" if stat.S_ISDIR(seen.st_mode)
                    else "file" if stat.S_ISREG(seen.st_mode) else "special")
            yield entry.name, kind, seen.st_size if kind == "file" else None, _time(seen.st_mtime), None


def _walk(budget: int, hidden: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        listed = 0
        for batch in batches:
            for case, root, folder in zip(*(c.to_pylist() for c in batch.columns)):
                ahead = [folder]
                while ahead and listed < budget:
                    at = ahead.pop()
                    try:
                        for name, kind, length, modified, error in _entries(at):
                            if not hidden and name.startswith((".", "_")):
                                continue
                            listed += 1
                            path = f"{at.rstrip('/')}/{name}"
                            yield case, root, path, kind, length, modified, error
                            if kind == "dir":
                                ahead.append(path)
                    except OSError as fault:
                        yield case, root, at, "error", None, None, fault.strerror or str(fault)
                for rest in ahead:
                    yield case, root, rest, _OPEN, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ENTRY)], schema=_ENTRY)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ENTRY)], schema=_ENTRY)
    return run


def list_evidence(roots: DataFrame, budget: int = BUDGET, hidden: bool = True) -> DataFrame:
    """Every entry below the roots (case_id, root): case_id, root, path, file_kind (file, dir, symlink, special, error),
    length, modificationTime, error. A root that is missing, or a folder that cannot be read, is one ``error`` row.
    ``hidden`` tells whether names that begin with a dot or an underscore count."""
    spark = roots.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ahead = roots.select("case_id", F.regexp_replace("root", "(?<=.)/+$", "").alias("root")).withColumn("folder", F.col("root"))
    found = None
    while True:
        dealt = ahead.repartition(width, F.xxhash64("folder"))
        listed = stage(dealt.mapInArrow(_walk(budget, hidden), ENTRY), "listing")
        seen = listed.where(F.col("file_kind") != _OPEN)
        found = seen if found is None else found.unionByName(seen)
        left = listed.where(F.col("file_kind") == _OPEN)
        if left.isEmpty():
            return found
        ahead = left.select("case_id", "root", F.col("path").alias("folder"))


def _content(path: str, limit: int) -> bytes:
    """At most one byte more than ``limit``, which tells a file that has grown since it was listed."""
    mounted = _local(path)
    if mounted is not None:
        # a link put in the file's place since then is not followed
        with os.fdopen(os.open(mounted, os.O_RDONLY | os.O_NOFOLLOW), "rb") as source:
            return source.read(limit + 1)
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as source:
        return source.read(limit + 1)


def with_content(inventory: DataFrame, limit: int = fx.LIMIT_ACQUIRE) -> DataFrame:
    """Adds ``content`` to listed files that acquisition takes; other rows keep null. Oversized files are never opened.
    A file that cannot be read becomes an ``error`` row, one that has grown beyond the limit keeps its larger length."""
    wanted = fx.skip_reason(F.col("file_kind"), fx.escapes_root(F.col("path"), F.col("root")), F.col("length"), limit)
    rows = inventory.select(*ENTRY_COLUMNS, ((F.col("file_kind") == "file") & wanted.isNull()).alias("wanted"))
    schema = _ENTRY.append(pa.field("content", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for batch in batches:
            for *row, take in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if take:
                    try:
                        content = _content(row[2], limit)
                        row[4] = max(len(content), row[4]) if len(content) > limit else len(content)
                    except OSError as fault:
                        row[3], row[4], row[6] = "error", None, fault.strerror or str(fault)
                held.append((*row, content if content is not None and len(content) <= limit else None))
                size += len(content or b"")
                if size > HELD_BYTES or len(held) == 5000:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    width = int(inventory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, F.xxhash64("path")).mapInArrow(run, f"{ENTRY}, content binary")


def _put(path: str, content: bytes, aside: str) -> None:
    """One file, whole or not at all: written aside and put in place, so a repeated task leaves no rest among the files."""
    mounted = _local(path)
    if mounted is None:
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rpartition("/")[0])
        with store.open_output_stream(inner) as target:
            target.write(content)
        return
    partial = f"{_local(aside)}/{uuid.uuid4().hex}"
    with open(partial, "wb") as target:
        target.write(content)
    os.makedirs(os.path.dirname(mounted), exist_ok=True)
    os.replace(partial, mounted)


def write_files(rows: DataFrame, root: str) -> int:
    """One file below ``root`` per row (path, content); returns their number. Tasks write the files they are dealt, so
    neither one task nor a commit on the driver goes over all of them. ``content`` is text or bytes."""
    root = root.rstrip("/")
    aside = f"{root}.partial"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _local(aside) is not None:
            os.makedirs(_local(aside), exist_ok=True)
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                _put(f"{root}/{path}", content, aside)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("path", F.col("content").cast("binary").alias("content")).repartition(width, F.xxhash64("path"))
    return dealt.mapInArrow(run, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"]


ENTRY_COLUMNS = tuple(c.split()[0] for c in ENTRY.split(", "))
