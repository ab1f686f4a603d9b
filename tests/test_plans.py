"""Physical plans stay the ones that scale."""

import re

import pytest
from pyspark.sql import functions as F

from sealwright.functions import files as fx
from sealwright.operators import chains, inventory as inv, pages as pg, reconcile as rec
from sealwright.plans import custody, evidence as pev, pages as pp, tables as t

SF = "/root/testdata/sf0.001"


def plan(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture
def unbroadcast(spark):
    """Plans as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verification_is_one_wide_exchange(unbroadcast):
    text = plan(unbroadcast, chains.verify_chain(t.ledger(unbroadcast, SF)))
    assert len(re.findall(r"Exchange hashpartitioning\(case_id#\d+, bucket#\d+L?", text)) == 1
    assert text.count("Exchange ") == 2 and text.count("+- Sort [") == 2
    # paths and operators do not travel
    assert "path" not in text.split("Window")[1] and "sha2" in text.split("Exchange hashpartitioning(case_id")[-1]


def test_row_checks_do_not_shuffle(spark):
    assert "Exchange" not in plan(spark, chains.hash_ok(t.ledger(spark, SF)))
    assert "Exchange" not in plan(spark, inv.acquire(pev.inventory(spark, SF)))


def test_only_needed_columns_are_read(spark):
    text = plan(spark, chains.heads(t.ledger(spark, SF)))
    assert re.search(r"FileScan parquet \[case_id#\d+,id#\d+L,entry_hash#\d+\]", text)
    text = plan(spark, pp.pg.histogram(pp.pixels(spark, SF)))
    assert "label" not in text.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(value), LessThanOrEqual(value,250.0)]" in plan(spark, t.ledger_gapped(spark, SF))


def test_top_k_is_cut_before_the_shuffle(spark):
    for df in (chains.recent_entries(t.ledger(spark, SF)), pg.cap_blocks(pp.blocks(spark, SF))):
        below = plan(spark, df).split("Exchange", 1)[1]
        assert "WindowGroupLimit" in below and "Partial" in below


def test_reconciliation_has_no_join(spark):
    manifest = spark.range(5).select(F.lit("c").alias("case_id"), F.lit("p").alias("relative_path"), F.lit("s").alias("sha256"))
    ledger = manifest.withColumnRenamed("relative_path", "path").withColumn("action", F.lit("ingest-seal"))
    text = plan(spark, rec.reconcile(manifest, ledger))
    assert "Join" not in text and "partial_sum" in text


def test_content_rules_stay_in_the_jvm(spark):
    df = pev.containers(spark, SF).select(fx.magic_hint(F.col("content")), fx.intake_reason(F.col("content"), F.col("length")))
    assert "Python" not in plan(spark, df) and "Pandas" not in plan(spark, df)


def test_flagship_columns(spark):
    assert custody.flagship(spark, SF).columns[:4] == ["case_id", "entries", "valid_prefix", "chain_ok"]
