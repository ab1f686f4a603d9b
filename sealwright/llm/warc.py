"""Web archives with a two-level capture index.

Pages are written as WARC records, one gzip member each. Captures are indexed by reversed-host keys
(``org,example,www)/path``): sorted over the cluster into shards, each shard a file of compressed blocks of
lines, followed by its sparse directory of the blocks' first keys. Which shard begins where is the upper level,
one entry per shard. A lookup finds the shard and then the block by binary search, reads that block's range of
the shard, and gets file, offset and length of the record, whose range is then read from the archive.

Files go through the file system that the shared folder's address names, never to a task's own disk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, stage

BLOCK_LINES = 512  # captures of a compressed index block
SHARD_LINES = 1_000_000  # captures of an index shard, at most about
READ_BYTES = 8 << 20  # neighbouring records are read together up to this size
LEVEL = 1  # of compression
CAPTURED = "2020-01-01T00:00:00Z"  # pages carry no time; every record gets this one
_TRAILER = 16
NO_ID = -(1 << 63) - 1  # sorts where Spark sorts null

CAPTURES = "key string, page_id bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def open_folder(path: str):
    """(file system, path in it) of a folder's address."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def url_key(url: str = "url") -> Column:
    """Reversed-host key of an address: scheme and fragment dropped, host in lower case, its labels reversed.
    Null gives the empty key."""
    rest = F.regexp_replace(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    tail = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?#:]*(.*)$", 1), r"(?s)#.*$", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail), F.lit(""))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[str], block: bytes) -> bytes:
    raw = ("WARC/1.1\r\n" + "".join(h + "\r\n" for h in head) + f"Content-Length: {len(block)}\r\n\r\n").encode() \
        + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _header(text: str | None) -> str:
    """A header's value on one line."""
    return " ".join((text or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, captured: str) -> bytes:
    """A response record, or with ``refers_to`` a revisit, which keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    head = ["WARC-Type: " + ("response" if refers_to is None else "revisit"),
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {_header(url)}", f"WARC-Date: {captured}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is None:
        return _member(head, http.encode() + payload)
    return _member([*head, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    f"WARC-Refers-To: <urn:page:{refers_to}>"], http.encode())


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers with lower-case names, HTTP header, payload) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload of at least ``least`` bytes a page with a smaller
    id has too. Copies are counted before the shuffle, and only ids and digests travel."""
    known = pages.where(F.col("_bytes") >= least).select("page_id", "_digest")
    first = known.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where(
        "_n > 1 and refers_to is not null").drop("_n")
    return known.join(first, "_digest").where("page_id is null or page_id <> refers_to").dropDuplicates()


def write_archives(pages: DataFrame, folder: str, least: int = 0, captured: str = CAPTURED) -> DataFrame:
    """Writes one archive per task into ``folder`` and returns where every capture lies (CAPTURES).

    A task that is run again writes a file of another name; only the locations of the successful one count.
    """
    whole = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumns(
        {"_bytes": F.octet_length("html"), "_digest": F.sha1("html")})
    again = revisits(whole, least).select(F.col("page_id").alias("_id"), F.col("_digest").alias("_same"), "refers_to")
    rows = whole.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_same")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", url_key().alias("key"))

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                info = _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
                                f"WARC-Date: {captured}", "Content-Type: application/warc-fields"],
                               b"format: WARC File Format 1.1\r\n")
                out.write(info)
                at = len(info)
            offsets, lengths = [], []
            for page_id, url, html, other in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                raw = record(None if pd.isna(page_id) else int(page_id), url, html.encode("utf-8", "surrogatepass"),
                             None if pd.isna(other) else int(other), captured)
                out.write(raw)
                offsets.append(at)
                lengths.append(len(raw))
                at += len(raw)
            yield pd.DataFrame({"key": batch["key"], "page_id": batch["page_id"].astype("Int64"), "file": name,
                                "offset": offsets, "length": lengths})
        if out is not None:
            out.close()

    return stage(rows.mapInPandas(per_task, CAPTURES), "captures")


def _line_key(key: str, page_id) -> tuple[bytes, int]:
    return key.encode(), NO_ID if pd.isna(page_id) else int(page_id)


def _line(fields: tuple) -> str:
    key, page_id, file, offset, length = fields
    # keys hold no line feeds or tabs: these are escaped
    key = key.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t")
    return f"{key}\t{'' if pd.isna(page_id) else int(page_id)}\t{file}\t{offset}\t{length}\n"


_ESCAPES = {"\\\\": "\\", "\\n": "\n", "\\t": "\t"}


def _unescape(key: str) -> str:
    if "\\" not in key:
        return key
    import re

    return re.sub(r"\\[\\nt]", lambda m: _ESCAPES[m[0]], key)


def _parse_block(raw: bytes) -> list[tuple]:
    out = []
    for line in zlib.decompress(raw).decode().split("\n")[:-1]:
        key, page_id, file, offset, length = line.split("\t")
        key = _unescape(key)
        number = None if page_id == "" else int(page_id)
        out.append(((key.encode(), NO_ID if number is None else number), key, number, file, int(offset), int(length)))
    return out


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES,
                shard_lines: int = SHARD_LINES) -> list[tuple[tuple[bytes, int], str]]:
    """Writes the shards into ``folder`` and returns the upper level: (first key, file) of each, in order.

    Its length is the number of shards, which is about the shuffle width or one per ``shard_lines`` captures.
    Keys end with the page id, so that an address with very many captures is spread over shards.
    """
    spark = captures.sparkSession
    n = captures.count()
    shards = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_lines)),
                        -(-n // block_lines)))

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        name, out, at, first = f"{uuid.uuid4().hex}.idx", None, 0, None
        directory: list[str] = []
        lines: list[tuple] = []

        def put(some: list[tuple]) -> None:
            nonlocal at
            raw = zlib.compress("".join(map(_line, some)).encode(), LEVEL)
            directory.append(_line((some[0][0], some[0][1], "", at, len(raw))))
            out.write(raw)
            at += len(raw)

        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                first = batch.iloc[0]
            lines += list(batch.itertuples(index=False, name=None))
            while len(lines) >= block_lines:
                put(lines[:block_lines])
                lines = lines[block_lines:]
        if out is None:
            return
        if lines:
            put(lines)
        raw = zlib.compress("".join(directory).encode(), LEVEL)
        out.write(raw + at.to_bytes(8, "little") + len(raw).to_bytes(8, "little"))
        out.close()
        yield pd.DataFrame({"key": [first["key"]], "page_id": pd.array([first["page_id"]], "Int64"), "file": [name]})

    ordered = captures.repartitionByRange(shards, "key", "page_id", "file", "offset").sortWithinPartitions(
        "key", "page_id", "file", "offset").select("key", "page_id", "file", "offset", "length")
    top = stage(ordered.mapInPandas(per_task, "key string, page_id bigint, file string"), "index")
    return sorted((_line_key(r["key"], r["page_id"]), r["file"]) for r in top.collect())


class Index:
    """Reads shards by range; keeps the directory of the last shard and the last block."""

    def __init__(self, folder: str, upper: list[tuple[tuple[bytes, int], str]]):
        self.store, self.base = open_folder(folder)
        self.firsts = [k for k, _ in upper]
        self.files = [f for _, f in upper]
        self.shard = self.block = None
        self.blocks_read = 0

    def _open(self, number: int) -> None:
        if self.shard == number:
            return
        if self.shard is not None:
            self.file.close()
        self.file = self.store.open_input_file(f"{self.base}/{self.files[number]}")
        size = self.file.size()
        tail = self.file.read_at(_TRAILER, size - _TRAILER)
        at, length = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
        self.directory = _parse_block(self.file.read_at(length, at))
        self.keys = [d[0] for d in self.directory]
        self.shard, self.block = number, None

    def _lines(self, number: int, block: int) -> list[tuple]:
        self._open(number)
        if self.block != block:
            _, _, _, _, offset, length = self.directory[block]
            self.lines = _parse_block(self.file.read_at(length, offset))
            self.line_keys = [x[0] for x in self.lines]
            self.block = block
            self.blocks_read += 1
        return self.lines

    def find(self, key: tuple[bytes, int]) -> list[tuple]:
        """(key, page_id, file, offset, length) of every capture with exactly this key, also where they run on
        into further blocks or shards."""
        out: list[tuple] = []
        shard = max(bisect_left(self.firsts, key) - 1, 0)
        while shard < len(self.files) and (self.firsts[shard] <= key):
            self._open(shard)
            block = max(bisect_left(self.keys, key) - 1, 0)
            while block < len(self.keys) and self.keys[block] <= key:
                lines = self._lines(shard, block)
                i = bisect_left(self.line_keys, key)
                while i < len(lines) and lines[i][0] == key:
                    out.append(lines[i][1:])
                    i += 1
                block += 1
            shard += 1
        return out


def look_up(wanted: DataFrame, folder: str, upper: list[tuple[tuple[bytes, int], str]]) -> DataFrame:
    """Locations (CAPTURES) of the captures with the (key, page_id) of ``wanted``. The wanted keys are sorted over
    the cluster, so each task walks through neighbouring blocks."""
    shared = wanted.sparkSession.sparkContext.broadcast(upper)  # one entry per shard

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(folder, shared.value)
        for batch in batches:
            found = [f for k, i in zip(batch["key"], batch["page_id"]) for f in index.find(_line_key(k, i))]
            frame = pd.DataFrame(found, columns=["key", "page_id", "file", "offset", "length"])
            yield frame.astype({"page_id": "Int64"})

    ordered = wanted.select("key", "page_id").distinct().repartitionByRange("key", "page_id").sortWithinPartitions(
        "key", "page_id")
    return ordered.mapInPandas(per_task, CAPTURES)


def read_records(locations: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records at some locations (RECORDS), each checked against its digest; ``with_payload`` adds the
    payload of responses. Neighbouring ranges of an archive are read together."""
    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        name, file, low, window = None, None, 0, b""
        for batch in batches:
            out = []
            rows = list(batch.itertuples(index=False, name=None))
            for n, (path, offset, length) in enumerate(rows):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file, window = path, store.open_input_file(f"{base}/{path}"), b""
                if not low <= offset <= offset + length <= low + len(window):
                    low, high = offset, offset + length
                    for k in range(n + 1, len(rows)):
                        other, at, size = rows[k]
                        if other != path or at != high or at + size - low > READ_BYTES:
                            break
                        high = at + size
                    window = file.read_at(high - low, low)
                raw = zlib.decompress(window[offset - low:offset - low + length], 31)
                fields, http, payload = parse_record(raw)
                kind = fields["warc-type"]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"payload of {path} at {offset} does not match its digest")
                size = int(http.decode().lower().rpartition("content-length:")[2].split()[0])
                of = lambda uri: int(uri[10:-1]) if len(uri) > 11 else None  # noqa: E731  <urn:page:7>
                row = (of(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind,
                       of(fields["warc-refers-to"]) if kind == "revisit" else None)
                out.append((*row, payload if kind == "response" else None) if with_payload else row)
            columns = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload
            yield pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    ordered = locations.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length").mapInPandas(
        per_task, RECORDS + (", payload binary" if with_payload else ""))


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes all pages into archives, indexes the captures, finds every page in the index again and reads its
    record back.

    Of equal payloads of at least ``least`` bytes the page with the smallest id is the response and the others
    revisit it; rows that share that smallest id are responses each. Null html is the empty payload. A null id
    never is a response to others; a null address has the empty key. Repeated rows get a record each, other
    columns are not read, and an empty table gives no rows and no files.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "archive")
    captures = write_archives(pages, folder, least)
    upper = build_index(captures, f"{folder}/index")
    wanted = pages.select(url_key().alias("key"), F.col("page_id").cast("bigint"))
    located = stage(look_up(wanted, f"{folder}/index", upper), "located")
    return read_records(located, folder, with_payload)
