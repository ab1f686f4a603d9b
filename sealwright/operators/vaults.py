"""Sealed containers: header audits, sealing, opening and bulk fixity.

Two layouts. The *stretched* layout is magic, version, salt and an AES-256-GCM body whose key is
stretched from a passphrase. The *role* layout carries a JSON header that is authenticated with
the body; its keys come from a key table. Keys are always joined in as a column, never written
into a plan as a literal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.files import uint_be
from ..functions.hashing import sha256_hex
from .joins import skew_join

# Stretched layout.
STRETCHED_MAGIC = b"ARCN"
STRETCHED_VERSION = 1
SALT_BYTES = 16
NONCE_BYTES = 12
TAG_BYTES = 16
STRETCH_ROUNDS = 100_000
MIN_PASSPHRASE = 12

# Role layout.
ROLE_MAGIC = b"ARCR"
ROLE_VERSION = 1
MAX_HEADER_BYTES = 64 * 1024
MAX_PAYLOAD_BYTES = 512 * 1024 * 1024
ROLES = ("manifest", "original", "restored", "mask")
KDF_NAME = "argon2id"
KDF_BOUNDS = {"t": (1, 10), "m_kib": (16384, 1048576), "p": (1, 16)}

# Fault texts.
TOO_SHORT = "blob too short"
BAD_MAGIC = "bad magic"
BAD_VERSION = "unsupported version "
HEADER_SIZE = "vault header is truncated or oversized"
HEADER_JSON = "invalid vault header (json)"
HEADER_KDF = "invalid vault header (kdf)"
HEADER_ENTRIES = "invalid vault header (entries)"
HEADER_PAYLOAD = "invalid vault header (size)"
NOT_AUTHENTIC = "authentication failed"
ENTRY_SIZES = "entry sizes do not match payload"

_BODY_AT = len(STRETCHED_MAGIC) + 1 + SALT_BYTES + 1


# ---- keys -------------------------------------------------------------------------------

def _stretch(passphrase: str, salt: bytes, domain: bytes, rounds: int) -> bytes | None:
    raw = passphrase.encode()
    if len(raw) < MIN_PASSPHRASE:
        return None
    acc = hashlib.sha256(raw + salt + domain).digest()
    for n in range(rounds):
        acc = hashlib.sha256(acc + salt + n.to_bytes(4, "little")).digest()
    return acc


def derive_keys(salts: DataFrame, passphrases: DataFrame, domain: bytes,
                rounds: int = STRETCH_ROUNDS, width: int | None = None) -> DataFrame:
    """Key table (salt, passphrase_ref, key): each distinct salt is stretched once.

    ``salts``: salt, passphrase_ref. ``passphrases``: passphrase_ref, passphrase. The work is pure
    hashing, so rows are dealt out over ``width`` partitions. A passphrase below the minimum
    length gives a null key.
    """
    pairs = salts.select("salt", "passphrase_ref").distinct().join(passphrases, "passphrase_ref", "inner")
    width = width or salts.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [_stretch(p, bytes(s), domain, rounds) for p, s in zip(pdf["passphrase"], pdf["salt"])]
            yield pd.DataFrame({"salt": pdf["salt"], "passphrase_ref": pdf["passphrase_ref"], "key": keys})

    return pairs.repartition(width, "salt").mapInPandas(run, "salt binary, passphrase_ref string, key binary")


#: Keys of at most this many bytes travel to the contents; beyond, keys are brought to the contents' ids.
MOST_KEY_BYTES = 64 << 20
_KEY_ROW = 256


def key_rows(salts: DataFrame) -> int:
    """Number of keys ``derive_keys`` gives for ``salts``, at most; counted on the narrow columns."""
    return salts.select("salt", "passphrase_ref").distinct().count()


def _with_keys(rows: DataFrame, keys: DataFrame, how: str, known: int | None) -> DataFrame:
    """``rows`` with the ``key`` of their salt and passphrase, never dealing contents out by salt: one salt may have sealed
    them all. With ``known`` keys of checked size these are broadcast. Otherwise the narrow columns of a row name it, they
    are joined to the keys, and what was found is brought back to the contents by that name."""
    pair = ["salt", "passphrase_ref"]
    if known is not None and known * _KEY_ROW <= MOST_KEY_BYTES:
        return rows.join(F.broadcast(keys.select(*pair, "key")), pair, how)
    plain = ("string", "bigint", "int", "smallint", "tinyint", "date", "timestamp", "boolean")
    name = [f.name for f in rows.schema.fields if f.name not in pair and f.dataType.simpleString() in plain]
    found = skew_join(rows.select(*name, *pair).distinct(), keys.select(*pair, "key"), pair)
    found = found.select(F.struct(*[F.col(n) for n in (*name, *pair)]).alias("_name"), "key")
    return rows.withColumn("_name", F.struct(*[F.col(n) for n in (*name, *pair)])).join(found, "_name", how).drop("_name")


# ---- stretched layout -------------------------------------------------------------------

def audit_stretched(blob: Column) -> Column:
    """First header fault, null when the header is sound."""
    version = uint_be(blob, 5, 1)
    return (F.when(F.length(blob) < _BODY_AT - 1 + NONCE_BYTES + TAG_BYTES, TOO_SHORT)
            .when(~F.startswith(blob, F.lit(STRETCHED_MAGIC)), BAD_MAGIC)
            .when(version != STRETCHED_VERSION, F.concat(F.lit(BAD_VERSION), version.cast("string"))))


def stretched_salt(blob: Column) -> Column:
    return F.substring(blob, len(STRETCHED_MAGIC) + 2, SALT_BYTES)


def seal_stretched(rows: DataFrame, keys: DataFrame, known_keys: int | None = None) -> DataFrame:
    """Adds ``blob`` to rows with content, salt and passphrase_ref. The cipher output already is
    nonce, ciphertext and tag in a row, so the header is simply put in front. ``known_keys`` bounds the
    number of ``keys`` (see ``key_rows``)."""
    joined = _with_keys(rows, keys, "inner", known_keys)
    header = F.concat(F.lit(STRETCHED_MAGIC), F.lit(bytes([STRETCHED_VERSION])))
    return joined.withColumn("blob", F.concat(header, F.col("salt"), F.aes_encrypt("content", "key", F.lit("GCM")))) \
        .drop("key")


def open_stretched(blobs: DataFrame, keys: DataFrame, known_keys: int | None = None) -> DataFrame:
    """Adds ``plain`` (null where header or authentication fails) and ``fault``."""
    c = F.col
    marked = blobs.withColumns({"fault": audit_stretched(c("blob")), "salt": stretched_salt(c("blob"))})
    joined = _with_keys(marked, keys, "left", known_keys)
    body = F.substring(c("blob"), _BODY_AT, 2147483647)
    plain = F.when(c("fault").isNull(), F.try_aes_decrypt(body, c("key"), F.lit("GCM")))
    opened = joined.withColumn("plain", plain)
    fault = F.coalesce(c("fault"), F.when(c("plain").isNull(), NOT_AUTHENTIC))
    return opened.withColumn("fault", fault).drop("key", "salt")


def fixity_check(blobs: DataFrame, keys: DataFrame, manifest: DataFrame, known_keys: int | None = None) -> DataFrame:
    """Every manifest row against its opened blob: ok, mismatch, missing or the header fault."""
    opened = open_stretched(blobs, keys, known_keys).select(
        "case_id", "vault_relpath", F.lit(True).alias("found"), "fault",
        sha256_hex(F.col("plain")).alias("blob_sha256"), F.length("plain").cast("bigint").alias("blob_size"))
    joined = skew_join(manifest, opened, ["case_id", "vault_relpath"], "left")
    c = F.col
    same = (c("blob_sha256") == c("sha256")) & (c("blob_size") == c("size_bytes"))
    return joined.withColumn("fixity", F.when(c("found").isNull(), "missing")
                             .when(c("fault").isNotNull(), c("fault")).when(same, "ok").otherwise("mismatch")) \
        .drop("found", "fault", "blob_sha256", "blob_size")


# ---- role layout ------------------------------------------------------------------------

def _role_parts(blobs: DataFrame) -> DataFrame:
    c = F.col
    parts = blobs.withColumn("_hlen", uint_be(c("blob"), 6, 4))
    text = F.decode(F.substr(c("blob"), F.lit(10), c("_hlen").cast("int")), "UTF-8")
    sane = (c("_hlen") > 0) & (c("_hlen") <= MAX_HEADER_BYTES)
    return parts.withColumn("_header", F.try_parse_json(F.when(sane, text)))


def _type_of(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("missing"))


def _role_fault() -> Column:
    c = F.col
    header = c("_header")

    def member(path: str, kind: str) -> Column:
        return F.try_variant_get(header, path, kind)
    too_short = F.length("blob") < 9 + c("_hlen") + NONCE_BYTES + TAG_BYTES
    bad_kdf = F.coalesce(member("$.kdf.name", "string") != KDF_NAME, F.lit(True))
    bad_kdf = bad_kdf | ~F.coalesce(member("$.kdf.salt", "string").rlike("^([0-9a-fA-F]{2}){16}$"), F.lit(False))
    for name, (low, high) in KDF_BOUNDS.items():
        value = member(f"$.kdf.{name}", "bigint")
        whole = _type_of(member(f"$.kdf.{name}", "variant")) == "BIGINT"
        bad_kdf = bad_kdf | ~(whole & F.coalesce(value.between(low, high), F.lit(False)))
    entries = member("$.entries", "array<variant>")
    roles = F.transform(entries, lambda e: F.try_variant_get(e, "$.role", "string"))
    sizes = F.transform(entries, lambda e: F.try_variant_get(e, "$.size", "bigint"))
    whole_sizes = F.forall(entries, lambda e: _type_of(F.try_variant_get(e, "$.size", "variant")) == "BIGINT")
    bad_entries = (entries.isNull() | (F.size(entries) == 0)
                   | ~F.coalesce(F.get(roles, F.lit(0)) == "manifest", F.lit(False))
                   | ~F.forall(roles, lambda r: F.coalesce(r.isin(*ROLES), F.lit(False)))
                   | (F.size(F.array_distinct(roles)) != F.size(roles))
                   | ~whole_sizes | ~F.forall(sizes, lambda s: F.coalesce(s >= 0, F.lit(False))))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, s: acc + s)
    version = uint_be(c("blob"), 5, 1)
    return (F.when((F.length("blob") < 9) | ~F.startswith(c("blob"), F.lit(ROLE_MAGIC)), BAD_MAGIC)
            .when(version != ROLE_VERSION, F.concat(F.lit(BAD_VERSION), version.cast("string")))
            .when((c("_hlen") == 0) | (c("_hlen") > MAX_HEADER_BYTES) | too_short,
                  HEADER_SIZE)
            .when(header.isNull(), HEADER_JSON)
            .when(bad_kdf, HEADER_KDF)
            .when(bad_entries, HEADER_ENTRIES)
            .when(total > MAX_PAYLOAD_BYTES, HEADER_PAYLOAD))


def audit_role(blobs: DataFrame) -> DataFrame:
    """Header audit without a passphrase. Adds ``fault`` (null when sound), the key derivation
    parameters and the entry list; the salt is not shown."""
    c = F.col
    parts = _role_parts(blobs)
    out = parts.withColumn("fault", _role_fault())

    def shown(path: str, kind: str) -> Column:
        return F.when(c("fault").isNull(), F.try_variant_get("_header", path, kind))
    return out.withColumns({
        "kdf_t": shown("$.kdf.t", "bigint"), "kdf_m_kib": shown("$.kdf.m_kib", "bigint"),
        "kdf_p": shown("$.kdf.p", "bigint"),
        "entries": shown("$.entries", "array<struct<role:string,size:bigint>>")}).drop("_hlen", "_header")


def role_prefix(header_json: Column) -> Column:
    """Magic, version, length and header: everything the body is authenticated with."""
    raw = F.encode(header_json, "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.length(raw)), 8, "0"))
    return F.concat(F.lit(ROLE_MAGIC), F.lit(bytes([ROLE_VERSION])), size, raw)


def seal_role(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``blob`` to rows with vault, header_json and payload (entries back to back)."""
    prefix = role_prefix(F.col("header_json"))
    nonce = F.unhex(F.substring(F.sha2(F.expr("uuid()"), 256), 1, 2 * NONCE_BYTES))
    joined = rows.join(keys.select("vault", "key"), "vault", "inner").withColumns({"_prefix": prefix, "_nonce": nonce})
    body = F.aes_encrypt("payload", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("_nonce"), F.col("_prefix"))
    return joined.withColumn("blob", F.concat("_prefix", body)).drop("key", "_prefix", "_nonce")


def open_role(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per entry: vault, role, size, content, sha256; faulty vaults give one row with the
    fault and null entry columns. ``keys``: vault, key."""
    c = F.col
    audited = _role_parts(blobs).withColumn("fault", _role_fault())
    prefix_len = (c("_hlen") + 9).cast("int")
    joined = audited.join(keys.select("vault", "key"), "vault", "left")
    plain = F.when(c("fault").isNull(), F.try_aes_decrypt(
        F.substr(c("blob"), prefix_len + 1, F.length("blob")), c("key"), F.lit("GCM"), F.lit("DEFAULT"),
        F.substr(c("blob"), F.lit(1), prefix_len)))
    entries = F.try_variant_get("_header", "$.entries", "array<struct<role:string,size:bigint>>")
    opened = joined.withColumns({"plain": plain, "entries": entries})
    total = F.aggregate("entries", F.lit(0).cast("bigint"), lambda acc, e: acc + e["size"])
    fault = (F.when(c("fault").isNotNull(), c("fault"))
             .when(c("plain").isNull(), NOT_AUTHENTIC)
             .when(F.length("plain") != total, ENTRY_SIZES))
    opened = opened.withColumn("fault", fault).select(
        "vault", "fault", "plain",
        F.posexplode_outer(F.when(fault.isNull(), c("entries"))).alias("i", "entry"), "entries")
    start = F.aggregate(F.slice("entries", F.lit(1), c("i")), F.lit(0).cast("bigint"), lambda acc, e: acc + e["size"])
    content = F.when(c("entry").isNotNull(),
                     F.substr(c("plain"), (start + 1).cast("int"), c("entry.size").cast("int")))
    return opened.select("vault", "fault", c("entry.role").alias("role"), c("entry.size").alias("size"),
                         content.alias("content")).withColumn("sha256", sha256_hex(c("content")))
