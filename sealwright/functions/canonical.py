"""Canonical JSON lines of the JSONL ledger dialect.

Canonical means sorted keys, no spaces and ASCII escapes. The envelope has fixed keys, so it
is put together with ``concat``. Python is only entered for whole JSON values that must be
written again, as an Arrow UDF whose input is null for every other row.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The tail every canonical line ends with (keys are sorted).
HASH_MEMBER = r',"hash":"[0-9a-f]{64}"(,"prev":"[0-9a-f]{64}","seq":\d+,"ts":"[^"]*"\})$'
PLAIN_STRING = r"^[ !#-\[\]-~]*$"
SHORT_ESCAPES = {"0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r",
                 "0022": '\\"', "005C": "\\\\"}
_TEXT = r'"[ !#-\[\]-~]*"'
_DECIMAL = r"-?(?:0\.(?:0|0{0,3}[1-9]|\d{4}(?<!0000)\d{0,6}[1-9]|\d{1,3}[1-9])|[1-9]\d{0,6}\.(?:0|\d{0,6}[1-9]))"
_SCALAR = rf"(?:{_TEXT}|-?[1-9]\d*|0|{_DECIMAL}|true|false|null)"
_MEMBER = rf"{_TEXT}:{_SCALAR}"
_FLAT_LINE = (rf'^\{{"data":\{{(?:{_MEMBER}(?:,{_MEMBER})*)?\}},"event":{_TEXT},"hash":"[0-9a-f]{{64}}",'
              rf'"prev":"[0-9a-f]{{64}}","seq":(?:0|[1-9]\d*),"ts":{_TEXT}\}}$')
MAX_FAST_LINE = 4096
BODY_KEYS = ("seq", "ts", "event", "data", "prev")


def _dumps(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _canonical_value(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else _dumps(json.loads(s)))


@F.pandas_udf(T.StringType())
def _body_digest(lines: pd.Series) -> pd.Series:
    def one(line):
        if line is None:
            return None
        try:
            entry = json.loads(line)
            body = {k: entry[k] for k in BODY_KEYS}
        except (ValueError, KeyError, TypeError):
            return None
        return hashlib.sha256(_dumps(body).encode()).hexdigest()
    return lines.map(one)


def json_string(col: Column) -> Column:
    """A JSON string literal in ASCII. Other strings than plain ones are taken apart into UTF-16
    units, so characters beyond the basic plane become surrogate pairs as JSON has them."""
    units = F.regexp_extract_all(F.hex(F.encode(col, "UTF-16BE")), F.lit("(.{4})"))

    def written(unit):
        out = F.when(unit.isin(*SHORT_ESCAPES), F.element_at(
            F.create_map(*[F.lit(v) for pair in SHORT_ESCAPES.items() for v in pair]), unit))
        plain_unit = unit.rlike("^00(?:[2-6].|7[0-9A-E])$")
        return (out.when(plain_unit, F.decode(F.unhex(F.substring(unit, 3, 2)), "US-ASCII"))
                .otherwise(F.concat(F.lit("\\u"), F.lower(unit))))
    escaped = F.array_join(F.transform(units, written), "")
    body = F.when(col.rlike(PLAIN_STRING), col).otherwise(escaped)
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_json(text: Column) -> Column:
    """Any JSON text in canonical form."""
    return _canonical_value(text)


def body_prefix(data: Column, event: Column) -> Column:
    """Canonical entry body up to the previous hash; ``data`` is already canonical."""
    return F.concat(F.lit('{"data":'), data, F.lit(',"event":'), event, F.lit(',"prev":"'))


def body_suffix(seq: Column, ts: Column) -> Column:
    """Canonical entry body after the previous hash."""
    return F.concat(F.lit('","seq":'), seq.cast("string"), F.lit(',"ts":'), ts, F.lit("}"))


def canonical_line(data: Column, event: Column, entry_hash: Column, prev: Column, seq: Column,
                   ts: Column) -> Column:
    """One ledger line. ``event`` and ``ts`` are JSON string literals (see ``json_string``)."""
    return F.concat(F.lit('{"data":'), data, F.lit(',"event":'), event, F.lit(',"hash":"'),
                    entry_hash, F.lit('","prev":"'), prev, F.lit('","seq":'), seq.cast("string"),
                    F.lit(',"ts":'), ts, F.lit("}"))


def raw_body_digest(line: Column) -> Column:
    """Digest of a canonical line with its ``hash`` member cut out, all in the JVM."""
    return F.sha2(F.regexp_replace(line, HASH_MEMBER, "$1"), 256)


def surely_canonical(line: Column) -> Column:
    """True for lines whose text shows that writing them again would change nothing: a flat
    ``data`` object of plain strings, whole numbers and short decimals, with sorted, distinct keys.

    Longer lines are left to the full check, which also keeps the pattern's recursion small.
    """
    data = F.regexp_extract(line, r'^\{"data":\{([^{}]*)\},"event":', 1)
    keys = F.regexp_extract_all(data, F.lit(r'"([^"]*)":'))
    return F.when(F.length(line) <= MAX_FAST_LINE, F.coalesce(
        line.rlike(_FLAT_LINE) & (F.array_sort(F.array_distinct(keys)) == keys), F.lit(False))).otherwise(False)


def line_hash_ok(line: Column, stored: Column) -> Column:
    """Row hash check of a line. The hash is over the canonical form: lines that surely have it are
    checked on their raw text in the JVM, all others are parsed and written again."""
    raw_ok = surely_canonical(line) & F.coalesce(raw_body_digest(line) == stored, F.lit(False))
    reparsed = _body_digest(F.when(~raw_ok, line))
    return raw_ok | F.coalesce(reparsed == stored, F.lit(False))
