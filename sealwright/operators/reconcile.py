"""Do manifests, sealed blobs, ledgers and reports agree?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import sha256_hex
from ..schemas import EVENT_DELETED, EVENT_SEALED
from .joins import skew_join


def verify_vault(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Manifest rows against opened blobs by relative path: ok, mismatch or missing.

    ``blobs``: case_id, vault_relpath, blob_sha256, blob_size (of the opened content), one row
    per blob. Many manifest rows may share one blob, so that side is treated as skewed.
    """
    joined = skew_join(manifest, blobs.select("case_id", "vault_relpath", "blob_sha256", "blob_size"),
                       ["case_id", "vault_relpath"], "left")
    c = F.col
    same = (c("blob_sha256") == c("sha256")) & (c("blob_size") == c("size_bytes"))
    return joined.withColumn("vault_status", F.when(c("blob_sha256").isNull(), "missing")
                             .when(same, "ok").otherwise("mismatch"))


def verify_summary(manifest: DataFrame, blobs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Files, events, chain verdict, vault mismatches and the overall result per case."""
    counted = verify_vault(manifest, blobs).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("vault_status") != "ok").alias("vault_mismatches"))
    chains = verdict.select("case_id", F.col("entries").alias("events"), "chain_ok")
    joined = counted.join(chains, "case_id", "left").select(
        "case_id", "files", F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("chain_ok", F.lit(False)).alias("chain_ok"), "vault_mismatches")
    return joined.withColumn("ok", F.col("chain_ok") & (F.col("vault_mismatches") == 0))


def verify_entries(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Opened vault entries against the digests in the vault's own manifest, role by role.

    ``entries``: vault, role, sha256. ``manifests``: vault, entries map. Roles the blob does not
    hold are passed over.
    """
    wanted = manifests.select("vault", F.explode("entries").alias("role", "meta")).select(
        "vault", "role", F.col("meta.sha256").alias("expected_sha256"))
    joined = wanted.join(entries.select("vault", "role", "sha256"), ["vault", "role"], "inner")
    return joined.withColumn("entry_ok", F.coalesce(F.col("sha256") == F.col("expected_sha256"), F.lit(False)))


def verify_reports(blobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Opened output digests against page reports; without a report the verdict stays null."""
    joined = blobs.select("vault", "sha256").join(
        reports.select("vault", F.col("plaintext_sha256").alias("expected_sha256"), "source_name"), "vault", "left")
    return joined.withColumn("report_verified", F.when(F.col("expected_sha256").isNotNull(),
                                                       F.col("sha256") == F.col("expected_sha256")))


def reconcile(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Manifest rows against ``ingest-seal`` ledger rows, both ways.

    Both sides are stacked and counted per (case, path, digest), so repeated rows combine before
    the shuffle and nothing is joined.
    """
    listed = manifest.select("case_id", F.col("relative_path").alias("path"), "sha256",
                             F.lit(1).alias("m"), F.lit(0).alias("l"))
    logged = ledger.where(F.col("action") == "ingest-seal").select(
        "case_id", "path", "sha256", F.lit(0).alias("m"), F.lit(1).alias("l"))
    both = listed.unionByName(logged).groupBy("case_id", "path", "sha256").agg(
        F.sum("m").alias("manifest_rows"), F.sum("l").alias("ledger_rows"))
    c = F.col
    return both.withColumn("status", F.when(c("ledger_rows") == 0, "manifest_only")
                           .when(c("manifest_rows") == 0, "ledger_only")
                           .when(c("manifest_rows") == c("ledger_rows"), "matched").otherwise("count_differs"))


def reconcile_summary(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    status = F.col("status")
    return reconcile(manifest, ledger).groupBy("case_id").agg(
        F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "manifest_only").alias("manifest_only"),
        F.count_if(status == "ledger_only").alias("ledger_only"),
        F.count_if(status == "count_differs").alias("count_differs"))


def sealed_events(lines: DataFrame) -> DataFrame:
    """Typed ``evidence_sealed`` events from JSONL rows with a ``data`` text column."""
    return lines.where(F.col("event") == "evidence_sealed").select(
        "case_id", F.from_json("data", EVENT_SEALED).alias("d")).select("case_id", "d.*")


def deleted_events(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("event") == "vault_deleted").select(
        "case_id", F.from_json("data", EVENT_DELETED).alias("d")).select("case_id", "d.*")


def verify_sealed(sealed: DataFrame, blobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Sealed events against blob digests: ok, altered, deleted (recorded) or lost."""
    found = blobs.select("case_id", "vault", F.col("sha256").alias("found_sha256"))
    gone = deleted.select("case_id", "vault").distinct().withColumn("recorded", F.lit(True))
    joined = sealed.join(found, ["case_id", "vault"], "left").join(gone, ["case_id", "vault"], "left")
    c = F.col
    return joined.withColumn("status", F.when(c("found_sha256") == c("vault_sha256"), "ok")
                             .when(c("found_sha256").isNotNull(), "altered")
                             .when(c("recorded"), "deleted").otherwise("lost")).drop("recorded")


def verify_manifest_digest(manifests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Digest of each case's manifest file against its ``manifest-write`` ledger row."""
    logged = (ledger.where(F.col("action") == "manifest-write").groupBy("case_id")
              .agg(F.max_by("sha256", "id").alias("logged_sha256")))
    files = manifests.select("case_id", sha256_hex(F.col("content")).alias("file_sha256"))
    return files.join(logged, "case_id", "inner").withColumn(
        "manifest_ok", F.col("file_sha256") == F.col("logged_sha256"))
