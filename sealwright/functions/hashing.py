"""Digests and the hash material of the ledger dialects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values
GENESIS = "0" * 64
HEX64 = "^[0-9a-f]{64}$"


def sha256_hex(content: Column) -> Column:
    """Lower-case hex digest of text or bytes."""
    return F.sha2(content, 256)


def pipe_material(ts: Column, operator: Column, action: Column, path: Column, sha256: Column,
                  prev: Column) -> Column:
    """Pipe-joined row material."""
    return F.concat_ws("|", ts.cast("string"), operator, action, path, sha256, prev)


def pipe_prefix(ts: Column, operator: Column, action: Column, path: Column, sha256: Column) -> Column:
    """The part of the pipe material known before the previous hash is."""
    return F.concat(F.concat_ws("|", ts.cast("string"), operator, action, path, sha256), F.lit("|"))


def ambiguous_material(*fields: Column) -> Column:
    """True when a field holds a pipe, so two different rows could share one material."""
    flag = F.lit(False)
    for field in fields:
        flag = flag | F.coalesce(field.contains("|"), F.lit(False))
    return flag


def concat_material(prev: Column, timestamp: Column, data: Column) -> Column:
    return F.concat(prev, timestamp, data)
