"""Merge rounds against the sentencepiece library."""

import hashlib
import random

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from sealwright.llm import pieces, queries

PATH = public_tokenizers.path(pieces.MODEL)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "ab cde\n\t  ▁éüñ€字𐍈\x00<s>/aaaeeett。・"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(n)]


EDGES = ["", " ", "a" * 500, " " * 300, "the" * 200, " 　x", "<s>x</s>", "a▁b", "\n\n", " \n ", "ﬁ Ⅷ"]


def test_encoding(library, vocab):
    for text in random_texts(3000) + EDGES:
        ids = library.encode(text)
        assert pieces.encode(vocab, text) == ids and pieces.decode(vocab, ids) == library.decode(ids)


def test_long_and_short_ways_agree(vocab):
    words = [w for t in random_texts(300, 2) for w in pieces.split_words(t)]
    assert [pieces.merge_long(vocab, w) for w in words] == pieces.merge_words(vocab, words)


def test_decoding_any_ids(library, vocab):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32_000)]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(vocab, ids) == library.decode(ids)


def test_table(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got = queries.op9_pieces(spark, SF).toPandas().sort_values("doc_id")
    ids = [library.encode(t or "") for t in docs["text"]]
    assert got["n_tokens"].tolist() == [len(i) for i in ids]
    assert got["ids_sha256"].tolist() == [sha(",".join(map(str, i))) for i in ids]
    assert got["decoded_sha256"].tolist() == [sha(library.decode(i)) for i in ids]


def test_odd_rows(spark, library):
    texts = [None, "", " ", "a b", "a b", "long " * 50_000, "x" * 20_000]
    rows = [(None if n == 3 else n, t, 7) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = pieces.piece_digests(docs, step=100, with_ids=True).collect()
    assert [list(r.ids) for r in got] == [library.encode(t or "") for t in texts]
    assert [r.n_tokens for r in got] == [len(r.ids) for r in got] and got[3].doc_id is None
    assert got[0].ids_sha256 == got[0].decoded_sha256 == sha("")
    assert pieces.piece_digests(docs.limit(0)).count() == 0
