"""Packing: every id once, gapless sequences, little padding."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sealwright.llm import packing as pk, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(pk.TOKENIZER))


def verify(rows, texts, tokenizer, window=2048):
    """texts: list of (doc_id, text), ids distinct."""
    for i, text in texts:
        mine = rows[rows["doc_id"] == i].sort_values("start")
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert mine["start"].tolist() == [0, *mine["length"].cumsum()[:-1]] and mine["length"].sum() == len(ids)
        assert (mine["doc_tokens"] == len(ids)).all() and (mine["length"] > 0).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    padding = 0
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
        n = int(s["length"].sum())
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding


def test_table(spark, tokenizer):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = queries.op8_packing(spark, SF).toPandas()
    assert verify(rows, list(zip(docs["doc_id"], docs["text"])), tokenizer) == 0
    assert rows["sequence_id"].nunique() <= rows["length"].sum() // 2048 + 12


def test_odd_rows(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, " "), (4, "a  b\n c <|endoftext|> d"), (5, "word " * 30_000), (6, "x" * 9_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, length int").coalesce(1)
    assert verify(pk.pack_documents(docs, block_tokens=5_000).toPandas(), texts, tokenizer) == 0
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "null id", 1)], docs.schema))
    assert pk.pack_documents(twice).toPandas()["length"].sum() == 2 * pk.pack_documents(docs).toPandas()["length"].sum() + 3
    assert pk.pack_documents(docs.limit(0)).count() == 0


def test_ids_come_along(spark, tokenizer):
    docs = spark.createDataFrame([(1, "some words here " * 900)], "doc_id bigint, text string")
    rows = pk.pack_documents(docs, with_ids=True).toPandas().sort_values("start")
    assert np.concatenate(rows["ids"].to_numpy()).tolist() == [
        *tokenizer.encode("some words here " * 900, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("lengths", [[], [1], [2048] * 3, [1200] * 500, [2047] * 40, [700] * 301, [5000] * 7, [1] * 5000,
                                     list(range(1, 2049, 7)), [1024, 1024, 2047, 1]])
def test_windows_are_full(lengths):
    packed = pk.pack([pk.Piece(i, 0, n) for i, n in enumerate(lengths)])
    assert all(sum(p.length for p in s) == 2048 for s in packed.sequences)
    rest = sum(p.length for p in packed.rest)
    assert rest < 2048 and rest + 2048 * len(packed.sequences) == sum(lengths)
    covered = {}
    for p in [p for s in packed.sequences for p in s] + packed.rest:
        covered.setdefault(p.doc, []).append((p.start, p.start + p.length))
    for i, n in enumerate(lengths):
        runs = sorted(covered[i])
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert [sum(p.length for p in s) for s in pk.powers(packed.rest, 2048)] == [
        1 << k for k in range(11, -1, -1) if rest >> k & 1]


def test_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 5
        x = pk.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope[x > 0]).max() < 1e-6


def test_repeats_stay_within_the_histogram():
    rng = np.random.default_rng(1)
    histogram = rng.integers(0, 60, 64)
    used = np.zeros(64, int)
    for parts, n in pk.repeats(histogram):
        assert sum(p + 1 for p in parts) == 64 and len(parts) <= 3
        np.add.at(used, parts, n)
    assert (used <= histogram).all() and used.sum() > 0.8 * histogram.sum()


def test_encoder_equals_the_tokenizer(tokenizer):
    texts = ["a  b", "  x", " ", "a \n b", "it's  a 's x", "x  y", "a  b", "<|endoftext|> x<|endoftext|>", "\n\n a",
             "a b ", "1 2  3", "a\tb \tc", "a b  c d e  f", " a b", "  a b  c", "x \x1c y", "a b <|endoftext|> c", "é ü 字 𐍈"]
    for ranks in (None, public_tokenizers.path(pk.RANKS)):
        encoder = pk.Encoder(public_tokenizers.path(pk.TOKENIZER), ranks, cache=3)
        for text in texts:
            assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
