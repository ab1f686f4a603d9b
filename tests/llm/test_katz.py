"""Katz backoff against a dictionary version."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from sealwright.llm import katz, queries

SF = "/root/testdata/sf0.01"


def corpus():
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), size=i % 13, p=[.3, .2, .15, .1, .1, .05, .05, .05]).tolist()))
            for i in range(300)]
    return rows + [(None, "a b zz"), (7, "A  b\nq"), (7, "A  b\nq"), (1000, None), (1001, " \t"), (30, "new words only")]


def tokens(text):
    return (text or "").encode().lower().split() + [b"</s>"]


class Dictionary:
    def __init__(self, rows, order):
        self.count = [None] + [Counter() for _ in range(order)]
        for i, text in rows:
            if i is not None and zlib.crc32(str(i).encode()) % 10:
                p = [b"<s>"] * (order - 1) + tokens(text)
                for j in range(order - 1, len(p)):
                    for k in range(1, order + 1):
                        self.count[k][tuple(p[j - k + 1:j + 1])] += 1
        self.n, self.v = sum(self.count[1].values()), len(self.count[1])
        self.ratio = {k: katz.discounts([0] + [sum(c == r for c in self.count[k].values()) for r in range(1, 7)])
                      for k in range(2, order + 1)}
        self.after = defaultdict(dict)
        for k in range(2, order + 1):
            for g, c in self.count[k].items():
                self.after[g[:-1]][g[-1]] = c

    def base(self, w):
        return (self.count[1].get((w,), 0) + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, gram):
        if len(gram) == 1:
            return self.base(gram[0])
        seen, ratio = self.after.get(gram[:-1]), self.ratio[len(gram)]
        if not seen:
            return self.p(gram[1:])
        d = {w: ratio[min(c, 6)] * c for w, c in seen.items()}
        total = sum(seen.values())
        norm = total if sum(d.values()) < total else total + 1
        if gram[-1] in seen:
            return d[gram[-1]] / norm
        rest = 1 - sum(self.p(gram[1:-1] + (w,)) for w in seen)
        return (1 - sum(d.values()) / norm) / rest * self.p(gram[1:])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, order):
    rows = corpus()
    model = Dictionary(rows, order)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double").repartition(3)
    got = katz.katz_scores(docs, order, block_tokens=100).toPandas()
    want = []
    for i, text in rows:
        p = [b"<s>"] * (order - 1) + tokens(text)
        want.append((-1 if i is None else i, len(tokens(text)), sum((w,) in model.count[1] for w in tokens(text)),
                     sum(np.log10(model.base(w)) for w in tokens(text)),
                     sum(np.log10(model.p(tuple(p[j - order + 1:j + 1]))) for j in range(order - 1, len(p)))))
    mine = sorted(zip(got["doc_id"].fillna(-1).astype(int), got["n_tokens"], got["n_known"], got["base_score"], got["score"]))
    assert np.allclose(np.array(mine, float), np.array(sorted(want), float))
    assert (got["train_tokens"] == model.n).all()
    words = [g[0] for g in model.count[1]] + [b"?"]
    for context in list(model.after)[:25]:
        assert abs(sum(model.p(context + (w,)) for w in words) - 1) < 1e-9


def test_tables_are_written_by_part(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    katz.katz_scores(docs, 2, block_tokens=50, folder=str(tmp_path)).count()
    counts = spark.read.parquet(f"{tmp_path}/counts").where("kind = 'table'").toPandas()
    model = Dictionary(corpus(), 2)
    for k in (1, 2):
        rows = counts[counts["order"] == k].sort_values("part")
        keys = np.concatenate([katz.expand_keys(x) for x in rows["keys"]])
        assert len(rows) > 1 and (np.diff(keys.astype(object)) > 0).all()
        assert sorted(np.concatenate([katz.expand(v, np.int64) for v in rows["values"]])) == sorted(model.count[k].values())


def test_no_rows_and_nothing_to_learn(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = katz.katz_scores(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, row.base_score)


def test_discounts_lie_between_zero_and_one():
    for n in ([0, 100, 50, 30, 20, 15, 12], [0] * 7, [0, 1, 0, 0, 0, 0, 0], [0, 5, 50, 500, 5000, 1, 9]):
        d = katz.discounts(np.array(n))
        assert ((0 < d[1:6]) & (d[1:6] < 1)).all() and d[6] == 1


def test_arrays_survive_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert np.array_equal(katz.expand_keys(katz.squeeze_keys(keys)), keys)
    parts = list(katz.slices(keys, 7))
    assert sum(s.stop - s.start for _, s in parts) == len(keys) and [p for p, _ in parts] == sorted(p for p, _ in parts)
    assert np.array_equal(katz.expand(katz.squeeze(keys[:0]), np.uint64), keys[:0])


def test_held_out_text_is_better_than_base(spark):
    got = queries.op7_katz(spark, SF).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 10 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and len(got) == len(pd.read_parquet(f"{SF}/documents.parquet"))


def test_registered_query_scores_by_trigrams(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    model = Dictionary(rows, 3)
    got = queries.op7_katz(spark, small).toPandas().set_index("doc_id")["score"]
    for i, text in rows[:40]:
        p = [b"<s>"] * 2 + tokens(text)
        assert np.isclose(got[i], sum(np.log10(model.p(tuple(p[j - 2:j + 1]))) for j in range(2, len(p))))


def key_of(gram):
    from xxhash import xxh3_64_intdigest

    marks = {b"<s>": katz.BEGIN, b"</s>": katz.END}
    words = np.array([marks[w] if w in marks else xxh3_64_intdigest(w) for w in gram], np.uint64)
    key = words[:1]
    for k in range(2, len(gram) + 1):
        key = katz._longer(key, words[k - 1:k], k)
    return int(key[0])


def test_backoff_table_gives_the_weights(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(3)
    katz.katz_scores(docs, 3, block_tokens=100, folder=str(tmp_path)).count()
    model = Dictionary(corpus(), 3)
    tables = spark.read.parquet(f"{tmp_path}/counts").where("kind = 'table'").toPandas()
    tables = {(r.order, r.part): katz.expand_keys(r.keys) for r in tables.itertuples()}
    backoff = spark.read.parquet(f"{tmp_path}/weights").where("kind = 'backoff'").toPandas()
    known, begin = {key_of(c): c for c in model.after if c[-1] != b"<s>"}, {2: (b"<s>",), 3: (b"<s>", b"<s>")}
    found = {}
    for r in backoff.itertuples():
        for row, value in zip(katz.expand_rows(r.keys), katz.expand(r.values, katz.BACKOFF)):
            found[known[int(tables[r.order - 1, r.part][row - 1])] if row else begin[r.order]] = value
    assert len(found) > 60 and {len(c) for c in found} == {1, 2}
    for context, value in found.items():
        seen, ratio = model.after[context], model.ratio[len(context) + 1]
        kept = sum(ratio[min(c, 6)] * c for c in seen.values())
        norm = sum(seen.values()) + (kept == sum(seen.values()))
        below = value["below"] / (found[context[1:]]["norm"] if len(context) > 1 else 1)
        want = (1 - kept / norm) / (1 - sum(model.p(context[1:] + (w,)) for w in seen))
        assert value["norm"] == norm and np.isclose((1 - value["kept"] / norm) / (1 - below), want)


def test_weights_of_all_orders_are_asked_for_once(spark, monkeypatch):
    # every round sorts all n-grams of all blocks anew
    asked, ask = [], katz.ask_weights
    monkeypatch.setattr(katz, "ask_weights", lambda *a: asked.append(a) or ask(*a))
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    assert katz.katz_scores(docs, 3, block_tokens=100).count() == len(corpus())
    assert len(asked) == 1


def test_training_counts_of_a_block(spark):
    train, held = ([i for i in range(1, 60) if (zlib.crc32(str(i).encode()) % 10 == 0) == h] for h in (False, True))
    for rows in ([(train[0], "a b a"), (held[0], "a c a b"), (train[1], "b a b a")], [(held[0], "a a")], [(train[0], None)]):
        block = katz.make_blocks(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()[0]
        for k in (1, 2, 3):
            want = dict.fromkeys((key_of(g) for i, t in rows for g in zip(*[([b"<s>"] * (k - 1) + tokens(t))[j:] for j in range(k)])), 0)
            want |= {key_of(g): n for g, n in Dictionary(rows, k).count[k].items()}
            keys, counts = katz.training_counts(katz.Text(block), k)
            assert list(zip(keys.tolist(), counts.tolist())) == sorted(want.items())


def test_texts_without_words(spark):
    got = katz.katz_scores(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id bigint, text string")).toPandas()
    assert len(got) == 3 and (got["n_tokens"] == 1).all() and np.isfinite(got["score"]).all()
