"""Registered queries that compare manifests, blobs, ledgers and reports, and on vault containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, reconcile as rec, vaults
from ..sources import evidence as src, manifests as msrc, walk
from . import tables as t

_files: dict = {}


def documents(spark, sf_dir):
    """Documents as sealed exhibits; the first digit of the digest plants the damage."""
    d = t.table(spark, sf_dir, "documents")
    return d.select(
        F.replace("source", F.lit("src"), F.lit("case-")).alias("case_id"), "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"),
        F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes")).withColumns({
            "vault_relpath": F.concat(F.lit("vault/"), "sha256", F.lit(".arcv")),
            "digit": F.substring("sha256", 1, 1)})


DOCS_SQL = """
WITH docs AS (
  SELECT replace(source, 'src', 'case-') AS case_id, doc_id, 'doc-' || doc_id || '.txt' AS relative_path, text,
         sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes, substr(sha256(text), 1, 1) AS digit
  FROM documents),
vaulted AS (SELECT *, 'vault/' || sha256 || '.arcv' AS vault_relpath,
            CASE digit WHEN '0' THEN 'mismatch' WHEN '1' THEN 'missing' ELSE 'ok' END AS vault_status FROM docs)
"""


def manifest(spark, sf_dir):
    return documents(spark, sf_dir).select("case_id", "relative_path", "size_bytes", "sha256", "vault_relpath")


def blobs(spark, sf_dir):
    """What opening each blob gives: altered where the digit is 0, absent where it is 1."""
    d = documents(spark, sf_dir).where("digit <> '1'")
    content = F.when(F.col("digit") == "0", F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))
    return d.select("case_id", "vault_relpath", F.sha2(content, 256).alias("blob_sha256"),
                    F.length(content).cast("bigint").alias("blob_size")).distinct()


def seal_ledger(spark, sf_dir):
    """Ingest rows of the documents: other path where the digit is 2, dropped for 3, twice for 4."""
    d = documents(spark, sf_dir).where("digit <> '3'")
    path = F.when(F.col("digit") == "2", F.concat(F.lit("moved/"), "relative_path")).otherwise(F.col("relative_path"))
    copies = F.when(F.col("digit") == "4", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("case_id", path.alias("path"), "sha256", F.lit("ingest-seal").alias("action"),
                    F.explode(copies).alias("copy")).drop("copy")


RECONCILE_SQL = DOCS_SQL + """,
stacked AS (
  SELECT case_id, relative_path AS path, sha256, 1 AS m, 0 AS l FROM docs
  UNION ALL
  SELECT case_id, CASE digit WHEN '2' THEN 'moved/' || relative_path ELSE relative_path END, sha256, 0, 1
  FROM docs, LATERAL (SELECT unnest(range(CASE digit WHEN '4' THEN 2 ELSE 1 END))) WHERE digit <> '3'),
compared AS (
  SELECT case_id, path, sha256, sum(m) AS manifest_rows, sum(l) AS ledger_rows,
         CASE WHEN sum(l) = 0 THEN 'manifest_only' WHEN sum(m) = 0 THEN 'ledger_only'
              WHEN sum(m) = sum(l) THEN 'matched' ELSE 'count_differs' END AS status
  FROM stacked GROUP BY ALL)
"""


def sealed_lines(spark, sf_dir):
    d = documents(spark, sf_dir)
    vault = F.concat(F.lit("evidence-"), F.col("doc_id").cast("string"), F.lit(".arcr"))
    seal = d.select("case_id", F.lit("evidence_sealed").alias("event"), F.to_json(F.struct(
        F.col("sha256").alias("source_sha256"), vault.alias("vault"), F.sha2("relative_path", 256).alias("vault_sha256"),
        F.lit("stable").alias("status"), F.lit(0.0).alias("masked_fraction"))).alias("data"))
    gone = d.where("digit = '1'").select("case_id", F.lit("vault_deleted").alias("event"), F.to_json(F.struct(
        vault.alias("vault"), F.sha2("relative_path", 256).alias("vault_sha256"))).alias("data"))
    return seal.unionByName(gone)


def sealed_check(spark, sf_dir):
    lines = sealed_lines(spark, sf_dir)
    d = documents(spark, sf_dir).where("digit not in ('1', '2')")
    found = d.select("case_id", F.concat(F.lit("evidence-"), F.col("doc_id").cast("string"), F.lit(".arcr")).alias("vault"),
                     F.sha2(F.when(F.col("digit") == "0", "changed").otherwise(F.col("relative_path")), 256).alias("sha256"))
    return rec.verify_sealed(rec.sealed_events(lines), found, rec.deleted_events(lines)).select(
        "case_id", "vault", "source_sha256", "status")


def report_check(spark, sf_dir):
    d = documents(spark, sf_dir)
    vault = F.col("relative_path").alias("vault")
    reports = d.where("digit <> '1'").select(
        vault, F.when(F.col("digit") == "0", F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("plaintext_sha256"),
        F.col("relative_path").alias("source_name"))
    out = rec.verify_reports(d.select(vault, "sha256"), reports)
    return out.select("vault", F.coalesce(F.col("report_verified").cast("string"), F.lit("unverified")).alias("verdict"))


def entry_check(spark, sf_dir):
    d = documents(spark, sf_dir)
    entry = F.struct("sha256", F.col("size_bytes").alias("size"))
    manifests = d.select(F.col("relative_path").alias("vault"), F.create_map(
        F.lit("original"), entry, F.lit("restored"), F.struct(F.sha2("relative_path", 256).alias("sha256"),
                                                              F.lit(1).cast("bigint").alias("size")),
        F.lit("mask"), entry).alias("entries"))
    held = d.select(F.col("relative_path").alias("vault"), F.explode(F.array(
        F.struct(F.lit("original").alias("role"), F.when(F.col("digit") == "0", F.sha2(F.lit("x"), 256))
                 .otherwise(F.col("sha256")).alias("sha256")),
        F.struct(F.lit("restored").alias("role"), F.sha2("relative_path", 256).alias("sha256")))).alias("e")).select(
        "vault", "e.role", "e.sha256")
    return rec.verify_entries(held, manifests).select("vault", "role", "entry_ok")


def manifest_digest(spark, sf_dir):
    c = t.table(spark, sf_dir, "orders")
    files = c.select(F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"),
                     F.encode(F.concat_ws(";", "o_orderstatus", "o_orderpriority"), "UTF-8").alias("content"))
    logged = c.select(F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("case_id"),
                      F.col("o_orderkey").alias("id"), F.lit("manifest-write").alias("action"),
                      F.sha2(F.concat_ws(";", F.lit("F"), "o_orderpriority"), 256).alias("sha256"))
    return rec.verify_manifest_digest(files, logged).select("case_id", "manifest_ok")


def manifest_files(spark, sf_dir):
    """Manifest documents written one per case and read back as evidence rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        path = t.scratch(spark, "manifests")
        rows = documents(spark, sf_dir).select(
            "case_id", F.lit("acquire").alias("tool"), F.lit("1").alias("version"), F.lit("op").alias("operator"),
            F.col("doc_id").alias("created_unix"), F.lit("/evidence").alias("source_root"),
            F.array(F.struct(F.concat(F.lit("/evidence/"), "relative_path").alias("source_path"), "relative_path",
                             "size_bytes", "sha256", F.lit("txt").alias("claimed_extension"),
                             F.lit("text").alias("magic_hint"), "vault_relpath")).alias("evidence"))
        msrc.write_manifest(rows, path)
        _files[key] = path
    return _files[key]


def manifest_read(spark, sf_dir):
    docs = msrc.read_manifest_rows(spark, manifest_files(spark, sf_dir), msrc.MANIFEST)
    return docs.select("case_id", F.explode("evidence").alias("e")).select("case_id", "e.relative_path", "e.size_bytes", "e.sha256")


def manifest_append(spark, sf_dir):
    """All manifest rows offered to a table that already holds most of them: what is refused."""
    key = (spark.sparkContext.applicationId, sf_dir, "append")
    rows = manifest(spark, sf_dir).withColumn("digit", F.substring("sha256", 1, 1))
    if key not in _files:
        path = t.scratch(spark, "manifest-table")
        rows.where("digit > '5'").write.mode("errorifexists").parquet(path)
        _files[key] = t.stage(msrc.append_new(rows, path, ["case_id", "relative_path"]), "refused")
    return _files[key].select("case_id", "relative_path")


def vault_listing(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("vault/"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"),
                 F.when(F.col("o_orderpriority") == "5-LOW", ".tmp").otherwise(".arcr")).alias("path"),
        F.floor("o_totalprice").cast("bigint").alias("length"), F.col("o_orderdate").alias("modificationTime"))


LISTING_SQL = """
WITH listing AS (
  SELECT 'vault/' || o_orderstatus || '/' || o_orderkey || CASE o_orderpriority WHEN '5-LOW' THEN '.tmp' ELSE '.arcr' END AS path,
         floor(o_totalprice)::BIGINT AS size_bytes, o_orderdate FROM orders),
kept AS (SELECT * FROM listing WHERE path LIKE '%.arcr' AND path LIKE 'vault/F%')
"""


# ---- containers -------------------------------------------------------------------------

DOMAIN = b"sealwright-demo-kdf"


def _salted(spark, sf_dir):
    """Documents with one salt per case."""
    return documents(spark, sf_dir).withColumns({
        "salt": F.unhex(F.substring(F.sha2("case_id", 256), 1, 32)),
        "passphrase_ref": F.lit("ref-1")})


def _keys(spark, sf_dir):
    """Keys are derived within each plan and never written."""
    refs = _salted(spark, sf_dir).select("passphrase_ref").distinct().withColumn(
        "passphrase", F.concat("passphrase_ref", F.lit(" long enough to use")))
    return vaults.derive_keys(_salted(spark, sf_dir), refs, DOMAIN)


def stretched_blobs(spark, sf_dir):
    """Sealed documents, then damaged: a flipped magic, a wrong version, a cut, a changed body."""
    def build():
        rows = _salted(spark, sf_dir).dropDuplicates(["case_id", "vault_relpath"])
        sealed = vaults.seal_stretched(rows, _keys(spark, sf_dir), vaults.key_rows(rows))
        b, n = F.col("blob"), F.length("blob")
        damaged = (F.when(F.col("digit") == "0", F.concat(F.lit(b"XXXX"), F.substring(b, 5, 2147483647)))
                   .when(F.col("digit") == "1", F.concat(F.substring(b, 1, 4), F.lit(b"\x02"), F.substring(b, 6, 2147483647)))
                   .when(F.col("digit") == "2", F.substring(b, 1, 40))
                   .when(F.col("digit") == "3", F.concat(F.substr(b, F.lit(1), n - 1), F.lit(b"\x00"), F.lit(b"\x00")))
                   .otherwise(b))
        return sealed.where("digit <> '4'").select("case_id", "vault_relpath", "passphrase_ref", damaged.alias("blob"))
    return t.once(spark, sf_dir, "stretched-blobs", build)


def fixity(spark, sf_dir):
    wrong = manifest(spark, sf_dir).withColumn("size_bytes", F.col("size_bytes") + F.when(
        F.substring("sha256", 1, 1) == "5", 1).otherwise(0))
    return vaults.fixity_check(stretched_blobs(spark, sf_dir), _keys(spark, sf_dir), wrong, vaults.key_rows(_salted(spark, sf_dir))).select(
        "case_id", "relative_path", "fixity")


ROLE_HEADERS = """CASE digit
  WHEN '0' THEN '{"entries":[{"role":"manifest","size":2},{"role":"original","size":SZ}],"kdf":{"m_kib":1024,"name":"argon2id","p":4,"salt":"SALT","t":3}}'
  WHEN '1' THEN '{"entries":[{"role":"original","size":SZ},{"role":"manifest","size":2}],"kdf":{"m_kib":65536,"name":"argon2id","p":4,"salt":"SALT","t":3}}'
  WHEN '2' THEN '{"entries":[{"role":"manifest","size":2},{"role":"manifest","size":SZ}],"kdf":{"m_kib":65536,"name":"argon2id","p":4,"salt":"SALT","t":3}}'
  WHEN '3' THEN '{"entries":[{"role":"manifest","size":2},{"role":"original","size":"SZ"}],"kdf":{"m_kib":65536,"name":"argon2id","p":4,"salt":"SALT","t":3}}'
  WHEN '4' THEN '{"entries":[{"role":"manifest","size":2},{"role":"original","size":536870912}],"kdf":{"m_kib":65536,"name":"argon2id","p":4,"salt":"SALT","t":3}}'
  WHEN '5' THEN '{"entries":[{"role":"manifest","size":2}],"kdf":{"m_kib":65536,"name":"scrypt","p":4,"salt":"SALT","t":3}}'
  WHEN '6' THEN '{"entries":'
  WHEN '7' THEN '{"entries":[{"role":"manifest","size":2},{"role":"original","size":SZ}],"kdf":{"m_kib":65536,"name":"argon2id","p":4,"salt":"abcd","t":3}}'
  WHEN '8' THEN '{"entries":[{"role":"manifest","size":2},{"role":"original","size":SZ}],"kdf":{"m_kib":65536,"name":"argon2id","p":4,"salt":"SALT","t":2.5}}'
  ELSE '{"entries":[{"role":"manifest","size":2},{"role":"original","size":SZ}],"kdf":{"m_kib":65536,"name":"argon2id","p":4,"salt":"SALT","t":3}}'
END"""


def _role_rows(spark, sf_dir):
    d = documents(spark, sf_dir)
    header = F.expr(ROLE_HEADERS)
    header = F.replace(F.replace(header, F.lit("SZ"), F.col("size_bytes").cast("string")), F.lit("SALT"),
                       F.substring("sha256", 1, 32))
    return d.select(F.col("relative_path").alias("vault"), "digit", "size_bytes", "sha256", header.alias("header_json"),
                    F.concat(F.lit(b"{}"), "content").alias("payload"))


def _role_keys(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("relative_path").alias("vault"), F.unhex("sha256").alias("key"))


def role_blobs(spark, sf_dir):
    def build():
        sealed = vaults.seal_role(_role_rows(spark, sf_dir), _role_keys(spark, sf_dir))
        b = F.col("blob")
        damaged = (F.when(F.col("digit") == "a", F.concat(F.lit(b"ARCX"), F.substring(b, 5, 2147483647)))
                   .when(F.col("digit") == "b", F.concat(F.substring(b, 1, 4), F.lit(b"\x09"), F.substring(b, 6, 2147483647)))
                   .when(F.col("digit") == "c", F.substring(b, 1, 60))
                   .when(F.col("digit") == "d", F.concat(b, F.lit(b"\x00"))).otherwise(b))
        return sealed.select("vault", damaged.alias("blob"))
    return t.once(spark, sf_dir, "role-blobs", build)


ROLE_SQL = DOCS_SQL + """,
roles AS (
  SELECT relative_path AS vault, digit, size_bytes, sha256, CASE digit
    WHEN '0' THEN 'invalid vault header (kdf)' WHEN '1' THEN 'invalid vault header (entries)'
    WHEN '2' THEN 'invalid vault header (entries)' WHEN '3' THEN 'invalid vault header (entries)'
    WHEN '4' THEN 'invalid vault header (size)' WHEN '5' THEN 'invalid vault header (kdf)'
    WHEN '6' THEN 'invalid vault header (json)' WHEN '7' THEN 'invalid vault header (kdf)'
    WHEN '8' THEN 'invalid vault header (kdf)' WHEN 'a' THEN 'bad magic' WHEN 'b' THEN 'unsupported version 9'
    WHEN 'c' THEN 'vault header is truncated or oversized' END AS fault
  FROM docs)
"""


def role_open(spark, sf_dir):
    out = vaults.open_role(role_blobs(spark, sf_dir), _role_keys(spark, sf_dir))
    return out.select("vault", F.coalesce("fault", F.lit("ok")).alias("fault"), F.coalesce("role", F.lit("none")).alias("role"),
                      F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("sha256", F.lit("none")).alias("sha256"))


def manifest_documents(spark, sf_dir):
    """Manifest documents, one JSON file per supplier with two evidence records, read as rows."""
    path = t.scratch(spark, "manifest-documents")
    sup = t.table(spark, sf_dir, "supplier")
    record = lambda n: F.struct(
        F.concat(F.lit("/e/"), F.lit(n)).alias("source_path"), F.lit(n).alias("relative_path"), F.length("s_name").cast("bigint").alias("size_bytes"),
        F.sha2(F.concat("s_name", F.lit(n)), 256).alias("sha256"), F.lit("txt").alias("claimed_extension"), F.lit("text").alias("magic_hint"),
        F.concat(F.lit("vault/"), F.sha2(F.concat("s_name", F.lit(n)), 256), F.lit(".arcv")).alias("vault_relpath"))
    doc = F.to_json(F.struct(
        F.lit("t").alias("tool"), F.lit("1").alias("version"), F.col("s_name").alias("case_id"), F.lit("op").alias("operator"),
        F.lit(1_700_000_000).alias("created_unix"), F.lit("/e").alias("source_root"), F.array(record("a.txt"), record("b.txt")).alias("evidence")))
    # so many documents to a folder that listing the folders is shared out and none is long
    place = F.concat(F.lit("folder="), F.call_function("div", F.col("s_suppkey"), F.lit(1000)).cast("string"), F.lit("/"),
                     F.col("s_suppkey").cast("string"), F.lit(".json"))
    walk.write_files(sup.select(place.alias("path"), doc.alias("content")), path)
    return msrc.read_manifests(spark, path).select("case_id", "relative_path", "size_bytes", "sha256", "vault_relpath")


QUERIES = {
    "manifest_documents": manifest_documents,
    "vault_verify": lambda s, d: rec.verify_vault(manifest(s, d), blobs(s, d)).select(
        "case_id", "relative_path", "vault_status"),
    "vault_verify_summary": lambda s, d: rec.verify_summary(
        manifest(s, d), blobs(s, d), chains.verify_chain(t.ledger_edited(s, d))),
    "vault_entry_check": entry_check,
    "vault_report_check": report_check,
    "ledger_manifest_reconcile": lambda s, d: rec.reconcile(manifest(s, d), seal_ledger(s, d)),
    "ledger_manifest_summary": lambda s, d: rec.reconcile_summary(manifest(s, d), seal_ledger(s, d)),
    "ledger_sealed_check": sealed_check,
    "ledger_manifest_digest": manifest_digest,
    "manifest_write_read": manifest_read,
    "manifest_append_refused": manifest_append,
    "vault_listing": lambda s, d: src.list_vaults(vault_listing(s, d), "vault/F").select(
        "path", "size_bytes", F.date_format("modificationTime", "yyyy-MM-dd").alias("modified")),
    "vault_totals": lambda s, d: src.vault_totals(src.list_vaults(vault_listing(s, d), "vault/F")),
    "vault_stretched_audit": lambda s, d: stretched_blobs(s, d).select(
        "case_id", "vault_relpath", F.coalesce(vaults.audit_stretched(F.col("blob")), F.lit("ok")).alias("audit")),
    "vault_fixity": fixity,
    "vault_role_audit": lambda s, d: vaults.audit_role(role_blobs(s, d)).select(
        "vault", F.coalesce("fault", F.lit("ok")).alias("audit"), F.coalesce("kdf_m_kib", F.lit(0)).alias("m_kib"),
        F.coalesce(F.size("entries"), F.lit(0)).alias("n_entries")),
    "vault_role_open": role_open,
}

ORACLE = {
    "manifest_documents": """
SELECT s_name AS case_id, f AS relative_path, length(s_name) AS size_bytes, sha256(s_name || f) AS sha256,
       'vault/' || sha256(s_name || f) || '.arcv' AS vault_relpath FROM supplier, (VALUES ('a.txt'), ('b.txt')) v(f)""",
    "vault_verify": DOCS_SQL + "SELECT case_id, relative_path, vault_status FROM vaulted",
    "vault_verify_summary": DOCS_SQL.replace("WITH docs", t.LEDGER_SQL.strip() + ",\ndocs", 1) + f""",
verdict AS (SELECT case_id, count(*) AS events, bool_and({t.ROW_OK_SQL}) AS chain_ok FROM edited GROUP BY case_id),
counted AS (SELECT case_id, count(*) AS files, count(*) FILTER (WHERE vault_status <> 'ok') AS vault_mismatches FROM vaulted GROUP BY case_id)
SELECT case_id, files, coalesce(events, 0) AS events, coalesce(chain_ok, false) AS chain_ok, vault_mismatches,
       coalesce(chain_ok, false) AND vault_mismatches = 0 AS ok FROM counted LEFT JOIN verdict USING (case_id)""",
    "vault_entry_check": DOCS_SQL + """
SELECT relative_path AS vault, 'original' AS role, digit <> '0' AS entry_ok FROM docs
UNION ALL SELECT relative_path, 'restored', true FROM docs""",
    "vault_report_check": DOCS_SQL + """
SELECT relative_path AS vault, CASE digit WHEN '1' THEN 'unverified' WHEN '0' THEN 'false' ELSE 'true' END AS verdict FROM docs""",
    "ledger_manifest_reconcile": RECONCILE_SQL + "SELECT * FROM compared",
    "ledger_manifest_summary": RECONCILE_SQL + """
SELECT case_id, count(*) FILTER (WHERE status = 'matched') AS matched,
       count(*) FILTER (WHERE status = 'manifest_only') AS manifest_only,
       count(*) FILTER (WHERE status = 'ledger_only') AS ledger_only,
       count(*) FILTER (WHERE status = 'count_differs') AS count_differs FROM compared GROUP BY case_id""",
    "ledger_sealed_check": DOCS_SQL + """
SELECT case_id, 'evidence-' || doc_id || '.arcr' AS vault, sha256 AS source_sha256,
       CASE digit WHEN '0' THEN 'altered' WHEN '1' THEN 'deleted' WHEN '2' THEN 'lost' ELSE 'ok' END AS status FROM docs""",
    "ledger_manifest_digest": """
SELECT 'case-' || o_orderkey AS case_id,
       sha256(o_orderstatus || ';' || o_orderpriority) = sha256('F;' || o_orderpriority) AS manifest_ok FROM orders""",
    "manifest_write_read": DOCS_SQL + "SELECT case_id, relative_path, size_bytes, sha256 FROM docs",
    "manifest_append_refused": DOCS_SQL + "SELECT case_id, relative_path FROM docs WHERE digit > '5'",
    "vault_listing": LISTING_SQL + "SELECT path, size_bytes, strftime(o_orderdate, '%Y-%m-%d') AS modified FROM kept",
    "vault_totals": LISTING_SQL + "SELECT count(*) AS count, sum(size_bytes)::BIGINT AS total_bytes FROM kept",
    "vault_stretched_audit": DOCS_SQL + """
SELECT DISTINCT case_id, vault_relpath, CASE digit WHEN '0' THEN 'bad magic' WHEN '1' THEN 'unsupported version 2'
       WHEN '2' THEN 'blob too short' ELSE 'ok' END AS audit FROM vaulted WHERE digit <> '4'""",
    "vault_fixity": DOCS_SQL + """
SELECT case_id, relative_path, CASE digit WHEN '0' THEN 'bad magic' WHEN '1' THEN 'unsupported version 2'
       WHEN '2' THEN 'blob too short' WHEN '3' THEN 'authentication failed' WHEN '4' THEN 'missing'
       WHEN '5' THEN 'mismatch' ELSE 'ok' END AS fixity FROM docs""",
    "vault_role_audit": ROLE_SQL + """
SELECT vault, coalesce(fault, 'ok') AS audit, CASE WHEN fault IS NULL THEN 65536 ELSE 0 END AS m_kib,
       CASE WHEN fault IS NULL THEN 2 ELSE 0 END AS n_entries FROM roles""",
    "vault_role_open": ROLE_SQL + """,
judged AS (SELECT vault, size_bytes, sha256, coalesce(fault, CASE digit WHEN 'd' THEN 'authentication failed' ELSE 'ok' END) AS fault FROM roles)
SELECT vault, fault, 'none' AS role, -1 AS size, 'none' AS sha256 FROM judged WHERE fault <> 'ok'
UNION ALL SELECT vault, fault, 'manifest', 2, sha256('{}') FROM judged WHERE fault = 'ok'
UNION ALL SELECT vault, fault, 'original', size_bytes, sha256 FROM judged WHERE fault = 'ok'""",
}
