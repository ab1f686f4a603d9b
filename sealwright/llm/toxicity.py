"""Toxicity classifier: a small convolutional network over hashed word embeddings, in numpy.

A word's embedding is the sum of two hashed vectors, one for the word and one for its first letters, so rare
forms share what is known of their stem. Filters of several widths slide over the whole text, each filter keeps
its maximum, and a logistic unit reads the maxima. Because a filter is linear before its maximum, every word is
projected once through all filter positions and the projections are added along the text.

Thresholds are calibrated by language on labelled rows the network was not trained on. The language is judged
from the text itself by its function words; no column but the text enters a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .textstats import fold, label_sample

#: Labelled documents fetched of each class, at most about; documents over LEARN_BYTES are not learned from.
LEARN_PER_CLASS = 4_000
LEARN_BYTES = 40_000
THRESHOLD = 0.7

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as be on not are this from or an at by".split(),
    "fr": "le la les de des et un une est que qui dans pour pas sur du au avec plus être".split(),
    "de": "der die das und ist nicht ein eine mit den von zu auf für im dem sich auch des".split(),
    "es": "el los las de y que en un una por con no se su para como al del lo es".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_EDGE = b".,!?;:\"'()[]{}<>#*$%&|-_~"


@dataclass
class Network:
    """Parameters: ``emb`` (buckets x dim), ``kernels`` by width (width, dim, filters), ``bias`` by width,
    the output weights and the logit shift and scale by language."""

    emb: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0

    @property
    def widths(self) -> list[int]:
        return [k.shape[0] for k in self.kernels]


def new_network(buckets: int = 1 << 17, dim: int = 8, filters: int = 8, widths: Sequence[int] = (1, 2, 3),
                seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.1, (buckets, dim)).astype(np.float32),
                   [rng.normal(0, 0.5, (k, dim, filters)).astype(np.float32) for k in widths],
                   [np.zeros(filters, np.float32) for _ in widths],
                   rng.normal(0, 0.5, len(widths) * filters).astype(np.float32), 0.0)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of the whole text."""
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def features(word: bytes, buckets: int) -> tuple[int, int]:
    """Buckets of a word and of its first four bytes, without marks at its edges. Bucket 0 is padding."""
    core = word.strip(_EDGE) or word
    return 1 + zlib.crc32(core) % (buckets - 1), 1 + zlib.crc32(b"^" + core[:4]) % (buckets - 1)


class Numbering(dict):
    """Gives each new word the next number from 1; 0 is padding."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def encode(texts: Sequence[str | None], pad: int) -> tuple[np.ndarray, np.ndarray, Numbering]:
    """All texts as one stream of word numbers, ``pad`` zeros after each (so no text is empty and no filter
    sees two texts); the start of each text; the numbering."""
    known = Numbering()
    streams, starts, at = [], [], 0
    gap = np.zeros(pad, np.int32)
    for text in texts:
        ids = np.array([known[w] for w in tokens(text)], np.int32)
        starts.append(at)
        streams += [ids, gap]
        at += len(ids) + pad
    return (np.concatenate(streams) if streams else gap[:0]), np.array(starts, np.int64), known


def word_buckets(known: Numbering, buckets: int) -> np.ndarray:
    out = np.zeros((len(known) + 1, 2), np.int64)
    if known:
        out[1:] = [features(w, buckets) for w in known]
    return out


def languages_of(stream: np.ndarray, starts: np.ndarray, known: Numbering) -> np.ndarray:
    """The index in LANGUAGES whose function words are most frequent; the last where there are none."""
    hits = np.zeros((len(known) + 1, len(FUNCTION_WORDS)), np.int32)
    for j, words in enumerate(FUNCTION_WORDS.values()):
        for w in words:
            k = known.get(w.encode())
            if k:
                hits[k, j] = 1
    if not len(starts):
        return np.empty(0, np.int64)
    counts = np.stack([np.add.reduceat(hits[:, j][stream], starts) for j in range(hits.shape[1])], axis=1)
    return np.where(counts.max(1) > 0, counts.argmax(1), len(FUNCTION_WORDS))


def logits(net: Network, stream: np.ndarray, starts: np.ndarray, buckets: np.ndarray,
           piece: int = 1 << 17) -> np.ndarray:
    """Network output of every text. The stream is worked off in pieces that overlap by the widest filter,
    so memory does not grow with the length of a text. No filter reaches into the next text."""
    if not len(starts):
        return np.empty(0)
    vectors = net.emb[buckets[:, 0]] + net.emb[buckets[:, 1]]
    vectors[0] = 0
    best = [np.full((len(starts), k.shape[2]), -np.inf, np.float32) for k in net.kernels]
    projected = [[vectors @ k[j] for j in range(k.shape[0])] for k in net.kernels]
    pad = max(net.widths) - 1
    last = len(stream) - pad
    ends = np.append(starts[1:], len(stream))
    owner = np.searchsorted(starts, np.arange(0, max(last, 1), piece), side="right") - 1
    for n, low in enumerate(range(0, max(last, 1), piece)):
        high = min(low + piece, max(last, 1))
        inside = starts[(starts > low) & (starts < high)]
        cuts = np.concatenate([[low], inside]) - low
        texts = owner[n] + np.arange(len(cuts))
        for k, (kernel, tables) in enumerate(zip(net.kernels, projected)):
            total = tables[0][stream[low:high]]
            for j in range(1, kernel.shape[0]):
                total = total + tables[j][stream[low + j:high + j]]
                # as in training, a filter lies within its own text and padding
                beyond = ends - j
                total[beyond[(beyond >= low) & (beyond < high)] - low] = -np.inf
            best[k][texts] = np.maximum(best[k][texts], np.maximum.reduceat(total, cuts, axis=0))
    top = np.concatenate([np.maximum(b + bias, 0) for b, bias in zip(best, net.bias)], axis=1)
    return top @ net.out + net.out_bias


def coded(texts: Sequence[str | None], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets of every word of each text (words x 2), and the texts' languages."""
    stream, starts, known = encode(texts, 1)
    pairs = word_buckets(known, buckets).astype(np.int32)[stream]
    ends = np.append(starts[1:], len(stream)) - 1
    return [pairs[a:b] for a, b in zip(starts, ends)], languages_of(stream, starts, known)


def joined(words: Sequence[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Coded texts as one stream of bucket pairs, ``pad`` pairs of zeros after each, and the start of each text."""
    lengths = np.array([len(w) + pad for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    stream = np.zeros((int(lengths.sum()), 2), np.int32)
    for w, a in zip(words, starts):
        stream[a:a + len(w)] = w
    return stream, starts


def coded_logits(net: Network, words: Sequence[np.ndarray]) -> np.ndarray:
    """Network output of coded texts."""
    pairs, starts = joined(words, max(net.widths))
    # the padding is the smallest pair; the first place makes sure that it is there
    distinct, stream = np.unique(np.append(0, pairs[:, 0] * np.int64(len(net.emb)) + pairs[:, 1]), return_inverse=True)
    return logits(net, stream[1:], starts, np.stack(np.divmod(distinct, len(net.emb)), axis=1))


def train(net: Network, words: Sequence[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.05,
          seed: int = 11) -> Network:
    """Adagrad on class-balanced log loss over coded texts. Only the position of each maximum passes a gradient on."""
    pad = max(net.widths)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    params = [net.emb, *net.kernels, *net.bias, net.out]
    speed = [np.full(p.shape, 1e-3, np.float32) for p in params]
    bias_speed = 1e-3
    rng = np.random.default_rng(seed)
    filters = [k.shape[2] for k in net.kernels]

    def step(p: int, gradient: np.ndarray) -> None:
        speed[p] += gradient**2
        params[p] -= rate * gradient / np.sqrt(speed[p])

    for _ in range(epochs):
        order = rng.permutation(len(words))
        for low in range(0, len(order), batch):
            docs = order[low:low + batch]
            pair, offs = joined([words[d] for d in docs], pad)
            lengths = np.diff(offs, append=len(pair))
            x = net.emb[pair[:, 0]] + net.emb[pair[:, 1]]
            x[pair[:, 0] == 0] = 0
            tops, where = [], []
            for kernel, bias in zip(net.kernels, net.bias):
                width, n = kernel.shape[0], len(x) - kernel.shape[0] + 1
                total = sum(x[j:n + j] @ kernel[j] for j in range(width)) + bias
                stops = np.minimum(offs + lengths - width + 1, n)
                at = np.stack([o + total[o:e].argmax(0) for o, e in zip(offs, stops)])
                where.append(at)
                tops.append(total[at, np.arange(kernel.shape[2])])
            z = np.concatenate(tops, axis=1)
            a = np.maximum(z, 0)
            off = (1 / (1 + np.exp(-np.clip(a @ net.out + net.out_bias, -30, 30))) - y[docs]) * weight[docs] / len(docs)
            da = off[:, None] * net.out * (z > 0)
            dx: dict[str, list] = {"at": [], "g": []}
            col = 0
            for k, kernel in enumerate(net.kernels):
                g = da[:, col:col + filters[k]].astype(np.float32)
                col += filters[k]
                dk = np.empty_like(kernel)
                for j in range(kernel.shape[0]):
                    xs = x[where[k] + j]  # docs x filters x dim
                    dk[j] = np.einsum("nf,nfd->df", g, xs)
                    dx["at"].append((where[k] + j).ravel())
                    dx["g"].append((g[:, :, None] * kernel[j].T[None]).reshape(-1, kernel.shape[1]))
                step(1 + k, dk)
                step(1 + len(net.kernels) + k, g.sum(0))
            at, g = np.concatenate(dx["at"]), np.concatenate(dx["g"])
            real = pair[at, 0] > 0
            touched, inverse = np.unique(pair[at[real]].ravel(), return_inverse=True)
            de = np.zeros((len(touched), net.emb.shape[1]), np.float32)
            np.add.at(de, inverse, np.repeat(g[real], 2, axis=0))
            speed[0][touched] += de**2
            net.emb[touched] -= rate * de / np.sqrt(speed[0][touched])
            step(len(params) - 1, (a * off[:, None]).sum(0).astype(np.float32))
            bias_speed += off.sum() ** 2
            net.out_bias -= rate * off.sum() / bias_speed**0.5
    return net


def calibrate(z: np.ndarray, y: np.ndarray, language: np.ndarray) -> dict[str, float]:
    """For each language the logit that parts the classes with the best balanced accuracy (the middle of the
    best gap); languages without both classes take the threshold of all rows."""
    def cut(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        below_0 = np.concatenate([[0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)
        above_1 = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1)
        gap = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        wide = np.concatenate([[0], np.diff(z), [0]])
        good = below_0 + above_1
        best = np.flatnonzero(good >= good.max() - 1e-12)
        return float(gap[best[np.argmax(wide[best])]])

    if len(y) == 0 or y.min() == y.max():
        return {name: 0.0 for name in LANGUAGES}
    every = cut(z, y)
    out = {}
    for j, name in enumerate(LANGUAGES):
        rows = language == j
        enough = min((y[rows] == 0).sum(), (y[rows] == 1).sum()) >= 5 if rows.any() else False
        out[name] = cut(z[rows], y[rows]) if enough else every
    return out


def fit(texts: Sequence[str], y: np.ndarray, **settings) -> Network:
    """A network trained and calibrated on texts; see ``fit_coded``."""
    net = new_network(**settings)
    return fit_coded(net, *coded(texts, len(net.emb)), y)


def fit_coded(net: Network, words: Sequence[np.ndarray], language: np.ndarray, y: np.ndarray) -> Network:
    """``net`` trained and calibrated on coded texts; every fifth row is kept for calibration. Without rows of both
    classes the network is constant: every score is low (class 0, or no rows) or high (class 1)."""
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        net.out[:] = 0
        net.out_bias = 4.0 if len(y) and y[0] == 1 else -4.0
        net.shift = {name: 0.0 for name in LANGUAGES}
        return net
    apart = np.arange(len(y)) % 5 == 4
    if len(y) < 40:
        apart[:] = False
    train(net, [w for w, a in zip(words, apart) if not a], y[~apart])
    judged = np.flatnonzero(apart if apart.any() else ~apart)
    z = np.concatenate([coded_logits(net, [words[i] for i in judged[low:low + 200]]) for low in range(0, len(judged), 200)])
    net.shift = calibrate(z, y[judged], language[judged])
    return net


def scores(net: Network, texts: Sequence[str | None], chunk: int = 2_000) -> np.ndarray:
    """Calibrated scores: a logit at the language's threshold becomes THRESHOLD."""
    out = []
    base = np.log(THRESHOLD / (1 - THRESHOLD))
    shifts = np.array([net.shift[name] for name in LANGUAGES])
    for low in range(0, len(texts), chunk):
        stream, starts, known = encode(texts[low:low + chunk], max(net.widths))
        z = logits(net, stream, starts, word_buckets(known, len(net.emb)))
        z = base + net.scale * (z - shifts[languages_of(stream, starts, known)])
        out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
    return np.concatenate(out) if out else np.empty(0)


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held: int = 1,
           per_class: int = LEARN_PER_CLASS, largest: int = LEARN_BYTES) -> Network:
    """Learns from a bounded sample of labelled documents outside the fold ``held``. Tasks code the texts, so the driver
    holds no words, only numbers of bounded size."""
    net = new_network()
    buckets = len(net.emb)

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                rows = batch.iloc[low:low + 500]
                words, language = coded(rows["text"].tolist(), buckets)
                yield pd.DataFrame({"doc_id": rows["doc_id"], "y": rows["y"], "words": [w.tobytes() for w in words], "language": language})

    sample = label_sample(labels.where(fold("doc_id", parts) != held), label, per_class)
    texts = docs.where(F.octet_length("text") <= largest).join(F.broadcast(sample), "doc_id").select(
        F.col("doc_id").cast("bigint"), "y", F.col("text").cast("string")).dropDuplicates()
    table = texts.mapInPandas(per_task, "doc_id bigint, y int, words binary, language int").toArrow()
    words = [np.frombuffer(w.as_buffer(), np.int32).reshape(-1, 2) for w in table["words"]]
    ids, y, language = (table[c].to_numpy() for c in ("doc_id", "y", "language"))
    # in an order that mixes the classes whatever the ids are, and does not hang on how the rows arrived
    mixed = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], len(words[i]), zlib.crc32(words[i])))
    return fit_coded(net, [words[i] for i in mixed], language[mixed], y[mixed].astype(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1,
                    model: Network | None = None) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` and ``predicted`` (replaced where they exist).

    Null and empty texts are scored like a text without words. A null ``doc_id`` is in no fold (``held_out``
    false) and never learned from; repeated rows are scored as often as given; long texts are scored whole.
    """
    net = model or fit_on(docs, labels, parts=parts, held=held)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters, about 4 MB

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(scores(shared.value, texts.tolist()))

    out = docs.withColumn("held_out", F.coalesce(fold("doc_id", parts) == held, F.lit(False)))
    return out.withColumn("score", score(F.col("text").cast("string"))).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
