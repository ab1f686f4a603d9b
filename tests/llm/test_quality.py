"""Decision list, rule ensemble and the statistics below them."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sealwright.llm import decision_list as dl, queries, rule_ensemble as en, textstats as ts

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, rule string, n_words string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b c a b c"), (5, "x\n\nx\ny\n x\nx"),
       (6, "é# ü* " * 400), (7, "w" * 200_000), (8, "a\x1cb a b\x0bc")]


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(hit))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "n") for i, t in rows], SCHEMA)


def test_base_counts_of_odd_texts(spark):
    got = ts.with_stats(docs(spark, ODD)).toPandas()
    assert len(got) == len(ODD)
    for (_, text), row in zip(ODD, got.itertuples()):
        assert tuple(getattr(row, c) for c in ts.COUNTS) == slow(text)


def test_base_counts_of_the_table(spark):
    got = queries.op1_quality_rules(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id").sort_index()
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").set_index("doc_id")["text"].sort_index()
    short = texts[texts.str.len() < 6_000]
    assert list(got.index) == list(texts.index)
    for i, text in short.items():
        n, chars, symbols, lines, repeats = slow(text)
        assert tuple(got.loc[i, list(ts.COUNTS)]) == (n, chars, symbols, lines, repeats)
        assert got.loc[i, "base_failed"] == (n < 50 or 100 * repeats > 50 * n)
    assert not (got["kept"] & got["base_failed"]).any()


def test_list_agrees_with_labels(spark):
    got = queries.op1_quality_rules(spark, SF).toPandas()
    rows = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    good = rows[(rows["quality"] == 1) & ~rows["base_failed"]]
    assert good["kept"].mean() > 0.97 and not rows[rows["quality"] == 0]["kept"].mean() > 0.05


def test_learned_rules_are_ordered_and_pruned():
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    y = ((x[:, 0] > 0.8) | ((x[:, 1] > 0.7) & (x[:, 2] < 0.3))).astype(int)
    rules = dl.learn(x, y, ["a", "b", "c"])
    hit = np.zeros(len(x), bool)
    for rule in rules:
        meets = np.ones(len(x), bool)
        for c in rule:
            column = x[:, "abc".index(c.name)]
            meets &= column > c.cut if c.above else column <= c.cut
        hit |= meets
    assert 1 < len(rules) <= 8 and (hit == (y == 1)).mean() > 0.97
    assert rules[0][0].name == "a" and rules[0][0].above
    assert dl.learn(x, np.zeros(900), "abc") == [] and dl.learn(x[:0], y[:0], "abc") == []


@pytest.mark.parametrize("rows", [[], ODD])
def test_without_labels(spark, rows):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    out, rules = dl.quality_rules(docs(spark, rows), labels)
    assert rules == [] and out.count() == len(rows) and out.where("kept").count() == sum(
        slow(t)[0] >= 50 and 100 * slow(t)[4] <= 50 * slow(t)[0] for _, t in rows)
    scored, model = en.quality_scores(docs(spark, rows), labels)
    assert model.rules == () and [r.score for r in scored.collect()] == [0.5] * len(rows)


def test_scores_on_held_out_rows(spark):
    got = queries.op4_rule_ensemble(spark, SF).toPandas()
    rows = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_held_out_labels_are_not_learned(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(ts.fold("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (en.quality_scores(table, x)[1] for x in (labels, turned))
    assert one == other


def test_compiled_score_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    y = (x[:, 0] + 0.1 * x[:, 1] > 0.6).astype(float)
    model = en.learn(x, y, ["a", "b"])
    assert 0 < len(model.rules) < 80
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).withColumn("s", model.score()).toPandas()
    z = model.intercept + en.apply_rules(x, ["a", "b"], model.rules) @ np.array(model.weights)
    assert np.allclose(frame["s"], 1 / (1 + np.exp(-z))) and ((frame["s"] > 0.5) == (y == 1)).mean() > 0.95


def test_sample_is_bounded_and_ignores_odd_labels(spark):
    rows = [(i, i % 2) for i in range(4000)] + [(None, 1), (1, 7), (2, None), (3, 0), (3, 0)]
    sample = ts.label_sample(spark.createDataFrame(rows, "doc_id bigint, quality int"), "quality", 100).toPandas()
    assert sample["doc_id"].is_unique and sample["doc_id"].notna().all()
    assert sample.groupby("y").size().between(60, 140).all()
