"""Convolutional toxicity classifier."""

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from sealwright.llm import queries, toxicity as tx

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = queries.op3_toxicity_cnn(spark, SF).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    rows = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = rows[rows["held_out"]]
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.85
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.02


def small_net():
    clean = ["the cat of the house is on it", "le chat de la maison est dans un", "nothing to see"] * 20
    bad = [t + " awfulword" for t in clean]
    return tx.fit(clean + bad, np.array([0.0] * 60 + [1.0] * 60))


def test_long_texts_are_read_to_the_end():
    net = small_net()
    long = "the cat of the house " * 60_000
    low, high = tx.scores(net, [long, long + "awfulword"])
    assert low < 0.7 <= high
    # the piece size does not matter
    stream, starts, known = tx.encode([long[:9_000], "", None, "awfulword", "a awfulword of"], 3)
    b = tx.word_buckets(known, len(net.emb))
    assert np.allclose(tx.logits(net, stream, starts, b, piece=7), tx.logits(net, stream, starts, b))


def test_texts_are_scored_alone():
    net = small_net()
    texts = ["the cat", "awfulword awfulword of it", "", "awfulword", None, "le chat", "awfulword the", "nothing to see", "a"] * 30
    alone = np.array([tx.scores(net, [t])[0] for t in texts])
    assert np.allclose(tx.scores(net, texts), alone) and np.allclose(tx.scores(net, texts, chunk=7), alone)
    # whatever the filters are
    for seed in range(5):
        net = tx.new_network(seed=seed)
        net.shift = {name: 0.0 for name in tx.LANGUAGES}
        alone = np.array([tx.scores(net, [t])[0] for t in texts])
        assert np.allclose(tx.scores(net, texts), alone)
        stream, starts, known = tx.encode(texts, 3)
        b = tx.word_buckets(known, len(net.emb))
        for piece in (1, 2, 5):
            assert np.allclose(tx.logits(net, stream, starts, b, piece=piece), tx.logits(net, stream, starts, b))


def test_odd_rows(spark):
    rows = [(1, None, 5.0), (2, "", 5.0), (None, "Awfulword!", 5.0), (3, "the cat", 5.0), (3, "the cat", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    out = tx.toxicity_scores(docs, labels, model=small_net()).toPandas()
    assert list(out.columns) == ["doc_id", "text", "score", "held_out", "predicted"] and len(out) == 5
    assert out["predicted"].tolist() == [0, 0, 1, 0, 0] and out["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2)] + [False] + [zlib.crc32(b"3") % 3 == 1] * 2
    assert (tx.toxicity_scores(docs, labels).toPandas()["predicted"] == 0).all()
    assert tx.toxicity_scores(docs.limit(0), labels).count() == 0


def test_languages_come_from_the_text():
    texts = ["the cat and the dog", "le chat et la souris", "der hund und die katze", "el gato y los perros", "xyz", ""]
    stream, starts, known = tx.encode(texts, 3)
    assert [tx.LANGUAGES[i] for i in tx.languages_of(stream, starts, known)] == ["en", "fr", "de", "es", "other", "other"]


def test_thresholds_by_language():
    z = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] * 2, float)
    y = np.array([0] * 6 + [1] * 6 + [0] * 6 + [1] * 6)
    z[12:] += 20
    cut = tx.calibrate(z, y, np.array([0] * 12 + [1] * 12))
    assert cut["en"] == 5.5 and cut["fr"] == 25.5 and cut["other"] == cut["de"]


def test_held_out_labels_are_not_learned(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tx.fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (tx.fit_on(table, x) for x in (labels, turned))
    assert np.array_equal(one.emb, other.emb) and one.shift == other.shift


def by_hand(net, text):
    """The network's output of one text, word by word, window by window, filter by filter."""
    words = [[net.emb[b] for b in tx.features(w, len(net.emb))] for w in tx.tokens(text)]
    x = [[float(p) + float(q) for p, q in zip(*pair)] for pair in words] + [[0.0] * net.emb.shape[1]] * 3
    out, n = float(net.out_bias), 0
    for kernel, bias in zip(net.kernels, net.bias):
        width, dim, filters = kernel.shape
        for f in range(filters):
            best = max(sum(x[i + j][d] * float(kernel[j, d, f]) for j in range(width) for d in range(dim))
                       for i in range(len(x) - width + 1))
            out += max(best + float(bias[f]), 0.0) * float(net.out[n])
            n += 1
    return out


def test_forward_pass_by_hand():
    texts = ["the cat", "", None, "awfulword of it", "a", "Le chat, de la MAISON!", "x " * 40, "ein zwei drei vier fünf"]
    for net in (small_net(), tx.new_network(seed=9), tx.new_network(1 << 10, 5, 3, (1, 3), seed=2)):
        stream, starts, known = tx.encode(texts, 3)
        got = tx.logits(net, stream, starts, tx.word_buckets(known, len(net.emb)))
        assert np.allclose(got, [by_hand(net, t) for t in texts], atol=1e-4)


def test_driver_learns_from_coded_texts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    outside = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = docs.where(F.octet_length("text") <= tx.LEARN_BYTES).join(outside, "doc_id").toPandas()
    rows = rows.sort_values("doc_id")
    rows = rows.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in rows["doc_id"]], kind="stable")]
    want = tx.fit(rows["text"].tolist(), rows["toxic"].to_numpy(float))

    encode = tx.encode

    def in_tasks(*given):
        assert TaskContext.get() is not None, "texts are coded by the tasks"
        return encode(*given)

    monkeypatch.setattr(tx, "encode", in_tasks)
    got = tx.fit_on(docs, labels)
    assert np.allclose(got.emb, want.emb) and np.allclose(got.out, want.out) and got.shift == want.shift
