"""The corpus pipeline against its stages done by hand."""

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sealwright.llm import lshforest, packing, textstats, toxicity
from sealwright.session import stage
from test_near_copies import brute
from test_packing import verify

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, work in cp.STAGES:
        out.append(docs)
        docs = stage(work(spark, docs, SF), "test")
    return [*out, docs]


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    for df in stages[:4]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    net = toxicity.fit_on(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    before, after = stages[0].toPandas(), stages[1].toPandas()
    kept = before[toxicity.scores(net, before["text"].tolist()) < toxicity.THRESHOLD]
    assert sorted(kept["doc_id"]) == sorted(after["doc_id"]) and len(after) < len(before)


def test_poor_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from sealwright.llm import rule_ensemble as en

    _, model = en.quality_scores(stages[1], labels)
    before, after = stages[1].toPandas(), stages[2].toPandas()
    x = np.array([textstats.measure(t)[len(textstats.COUNTS):] for t in before["text"]])
    z = model.intercept + en.apply_rules(x, textstats.RATIOS, model.rules) @ np.array(model.weights)
    assert sorted(before["doc_id"][1 / (1 + np.exp(-z)) >= en.THRESHOLD]) == sorted(after["doc_id"])


def test_one_of_each_group_stays(stages):
    before, after = stages[2].toPandas(), stages[3].toPandas()
    kept = {i for i, _, c in brute(list(zip(before["doc_id"], before["text"]))) if i == c}
    assert set(after["doc_id"]) == kept and after["doc_id"].is_unique


def test_unlike_texts_of_one_id_stay(spark, stages):
    one, other, third = (" ".join(f"{c}{i}" for i in range(200)) for c in "abc")
    rows = [(3, one), (3, other), (3, other), (5, third), (1, one + " end"), (7, None), (7, ""), (9, third), (None, one), (9, third)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], stages[0].schema)
    got = [(r.doc_id or 0, r.text) for r in cp.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, one + " end"), (3, other), (5, third), (7, None), (7, ""), (0, one)], key=str)


def test_all_ids_are_packed(stages):
    docs = stages[3].toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    assert verify(stages[4].toPandas(), list(zip(docs["doc_id"], docs["text"])), tokenizer) == 0


def test_run_is_the_chain_of_stages(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    one, other = (df.select("doc_id", "doc_tokens").distinct().toPandas() for df in (cp.run(spark, SF), stages[4]))
    assert set(map(tuple, one.to_numpy())) == set(map(tuple, other.to_numpy())) and key


@pytest.mark.parametrize("number", range(4))
def test_odd_rows(spark, stages, number):
    text = stages[3].select("text").first()[0]
    rows = [(None, text, "en", "s", 1), (None, None, None, None, None), (1, None, "en", "s", 1), (2, "", "en", "s", 1),
            (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, stages[0].schema)
    got = [tuple(r) for r in cp.STAGES[number][1](spark, docs, SF).collect()]
    if number < 2:
        assert set(got) <= set(rows) and got.count(rows[4]) in (0, 2)
    elif number == 2:
        assert sorted(r[0] or 0 for r in got) == [0, 0, 1, 2, 3]
    else:
        assert len({(r[0]) for r in got}) == 5
    assert cp.STAGES[number][1](spark, docs.limit(0), SF).count() == 0
