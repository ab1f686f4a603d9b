"""Language-model scores by Katz backoff.

n-gram counts with Good-Turing discounts; what the discounts set free goes to unseen continuations by backoff
weights that make every distribution sum to one exactly. Each token is scored recursively: by its discounted count
where the n-gram was seen in training, else by the backoff weight of its context times the score of order n - 1.
The lowest order is the additive unigram model, which keeps a share for one unknown word.

The corpus is held as blocks of documents: token numbers and the hashes of the block's words. A block asks for each
of its distinct n-grams once, however often they occur, so frequent words and copied documents weigh no more than
others; the requests, sorted runs of 64-bit hashes, are shuffled to the part that owns a range of hashes. The part
adds up the training counts of all blocks, writes its piece of the n-gram table, and answers. What backoff weights are
made of is asked for in the same way, but only of contexts that other blocks have, too: of a context that occurs in one
block all continuations lie there, so the block weighs it exactly by itself. A seen n-gram ends in a seen one, whose
probability is its discounted count over the norm of its context; that context is the same for all continuations, so
the sums need counts only, and all orders are asked for at once. No table passes through the driver; only counts of
counts do, a few numbers per order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, stage
from .textstats import fold

ORDER = 3
SMALL = 5  # counts up to this are discounted
ADD = 0.1  # to every count of the lowest order
LEAST_BLOCK, MOST_BLOCK = 1_000_000, 20_000_000  # tokens of a block and of a part
BEGIN, END = 0xB0B0B0B0B0B0B0B1, 0xE0E0E0E0E0E0E0E1  # hashes of the text's begin and end

BLOCKS = "block string, ids binary, flags binary, lengths binary, tokens binary, vocab binary"
REQUESTS = "order int, part int, block string, keys binary, values binary"
ANSWERS = "kind string, order int, part int, block string, keys binary, values binary"
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
          "score double")
TRAIN, HELD, NO_ID = 1, 2, 4

_A, _B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed: the empty upper bytes of small numbers cost nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def expand(raw: bytes, kind) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, np.uint64), dtype=np.uint64)


def squeeze_rows(rows: np.ndarray) -> bytes:
    """Rising row numbers."""
    return squeeze(np.diff(rows, prepend=0).astype(np.uint32))


def expand_rows(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, np.uint32), dtype=np.int64)


def _joined(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "little") + first + second


def _parted(raw: bytes) -> tuple[bytes, bytes]:
    end = 4 + int.from_bytes(raw[:4], "little")
    return raw[4:end], raw[end:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def make_blocks(docs: DataFrame, held: int = 0, parts: int = 10, block_tokens: int = LEAST_BLOCK) -> DataFrame:
    """Blocks of whole documents with at least ``block_tokens`` tokens each, but for the last of a partition."""
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"),
        (F.when(F.col("doc_id").isNull(), NO_ID).when(fold("doc_id", parts) == held, HELD).otherwise(TRAIN)).alias("flag"))

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        number = 0
        ids, flags, streams, size = [], [], [], 0

        def block() -> pd.DataFrame:
            lengths = np.array([len(s) for s in streams], np.int64)
            words = pa.concat_arrays(streams).dictionary_encode()
            vocab = np.array([END, *map(xxh3_64_intdigest, words.dictionary.to_pylist())], np.uint64)
            # frequent words get small numbers, and equally frequent ones the order of their hashes: both take little room
            tokens = np.insert(words.indices.to_numpy() + 1, np.cumsum(lengths), 0)  # 0 is the end
            often = np.lexsort((vocab, -np.bincount(tokens, minlength=len(vocab))))
            rank = np.empty(len(vocab), np.uint32)
            rank[often] = np.arange(len(vocab), dtype=np.uint32)
            return pd.DataFrame({
                "block": [f"{TaskContext.get().partitionId()}-{number}"], "ids": [squeeze(np.array(ids, np.int64))],
                "flags": [squeeze(np.array(flags, np.uint8))],
                "lengths": [squeeze(lengths + 1)], "tokens": [squeeze(rank[tokens])], "vocab": [squeeze_keys(vocab[often])]})

        for batch in batches:
            for doc_id, text, flag in zip(batch["doc_id"], batch["text"], batch["flag"]):
                found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                ids.append(0 if flag == NO_ID else int(doc_id))
                flags.append(flag)
                streams.append(pa.array(found, pa.large_binary()))
                size += len(found) + 1
                if size >= block_tokens:
                    yield block()
                    number += 1
                    ids, flags, streams, size = [], [], [], 0
        if ids:
            yield block()

    return rows.mapInPandas(per_task, BLOCKS)


@dataclass
class Grams:
    """The distinct n-grams of a block: keys (sorted) and the number of every position."""

    keys: np.ndarray
    at: np.ndarray


class Text:
    """A block's documents and the words of its tokens as hashes."""

    def __init__(self, row) -> None:
        self.name = row.block
        self.ids, self.flags = expand(row.ids, np.int64), expand(row.flags, np.uint8)
        self.lengths = expand(row.lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.vocab, self.tokens = expand_keys(row.vocab), expand(row.tokens, np.uint32)
        self.stream = self.vocab[self.tokens]
        self.training = np.repeat(self.flags == TRAIN, self.lengths)

    def hashes(self, k: int) -> np.ndarray:
        """The hash of the k-gram that ends at each token."""
        run, begin = self.stream, np.uint64(BEGIN)
        for j in range(2, k + 1):
            before = np.roll(run, 1)
            before[self.starts] = begin
            run, begin = _longer(before, self.stream, j), _longer(np.array([begin]), np.array([BEGIN], np.uint64), j)[0]
        return run


def _longer(context: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    return _mix(context * _A + word * _B + np.uint64(k))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the order of the rows, and the number of each row in that order."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new], order, np.cumsum(new) - 1


class Block(Text):
    """For every order up to ``order`` also the distinct n-grams, the keys of their contexts, of which the run of begin
    marks comes last, and by number the context and the shorter n-gram of each n-gram and the shorter context of each
    context."""

    def __init__(self, row, order: int):
        super().__init__(row)
        # words are sorted once in the vocabulary, not in the text
        keys, number = np.unique(self.vocab, return_inverse=True)
        self.grams, self.contexts = {1: Grams(keys, number[self.tokens])}, {}
        self.context, self.suffix, self.shorter = {}, {}, {}
        begin = np.array([BEGIN], np.uint64)
        for k in range(2, order + 1):
            below = self.grams[k - 1]
            context = np.roll(below.at, 1)
            context[self.starts] = len(below.keys)
            self.contexts[k] = np.append(below.keys, begin)
            keys, by_key, number = _distinct(_longer(self.contexts[k][context], self.stream, k))
            at, any_of = np.empty(len(number), np.int64), np.empty(len(keys), np.int64)
            at[by_key] = number
            any_of[number] = by_key
            self.grams[k] = Grams(keys, at)
            self.context[k], self.suffix[k] = context[any_of], below.at[any_of]
            if k > 2:
                self.shorter[k] = np.append(self.suffix[k - 1], len(self.grams[k - 2].keys))
            begin = _longer(begin, np.array([BEGIN], np.uint64), k)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True] * bool(len(keys)), keys[1:] != keys[:-1]]))
    return keys[edges], np.diff(edges, append=len(keys))


def training_counts(text: Text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-grams of a block, and how often they occur in training."""
    keys = text.hashes(k)
    seen, counts = _counted(keys[text.training])
    rest, _ = _counted(keys[~text.training])
    at = np.searchsorted(seen, rest)
    new = at == len(seen)
    new[~new] = seen[at[~new]] != rest[~new]
    at = at[new]
    return np.insert(seen, at, rest[new]), np.insert(counts, at, 0).astype(np.uint32)


def part_width(parts: int) -> int:
    """Hashes in the range of one part."""
    return (1 << 64) // parts + 1


def slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The pieces of sorted keys that fall to each of ``parts`` equal ranges of hashes."""
    width = part_width(parts)
    cuts = np.searchsorted(keys, np.array([width * p for p in range(1, parts)], np.uint64)) if parts > 1 else []
    edges = [0, *cuts, len(keys)]
    for p in range(parts):
        if edges[p + 1] > edges[p]:
            yield p, slice(edges[p], edges[p + 1])


def discounts(counts_of_counts: np.ndarray, small: int = SMALL) -> np.ndarray:
    """Good-Turing discount ratios by count, 1 beyond ``small``. Where the counts of counts give no ratio
    between 0 and 1, a count gives up half of one."""
    n = np.asarray(counts_of_counts, float)  # n[r] for r up to small + 1
    d = np.ones(small + 2)
    common = (small + 1) * n[small + 1] / n[1] if n[1] else 1.0
    for r in range(1, small + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else (r - 0.5) / r
    return d


@dataclass
class Model:
    """What the whole corpus has to say besides its tables: sizes and discounts."""

    order: int
    tokens: int
    types: int
    ratio: dict[int, np.ndarray]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.tokens + ADD * (self.types + 1)))

    def discount(self, k: int, counts: np.ndarray) -> np.ndarray:
        return self.ratio[k][np.minimum(counts, SMALL + 1)]

    def kept(self, k: int) -> np.ndarray:
        """What is left of an n-gram of order k after discounting, by its count up to SMALL, and of each further count."""
        return np.append(np.arange(1, SMALL + 1) * self.ratio[k][1:SMALL + 1], 1.0)

    def below(self, k: int) -> np.ndarray:
        """The same for what n-grams of order k end in: times the norm of its context, its probability. Those of single
        words are a share for each word and for each time it occurs."""
        if k > 2:
            return self.kept(k - 1)
        return np.array([ADD, *[0.0] * (SMALL - 1), 1.0]) / (self.tokens + ADD * (self.types + 1))


def ask_counts(blocks: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Requests of every block to the parts of the given orders."""
    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                b = Text(row)
                for k, n in parts.items():
                    keys, counts = training_counts(b, k)
                    told = [(k, p, b.name, squeeze_keys(keys[s]), squeeze(counts[s])) for p, s in slices(keys, n)]
                    yield pd.DataFrame(told, columns=["order", "part", "block", "keys", "values"])

    return blocks.mapInPandas(per_task, REQUESTS)


def rounds(pieces: dict[int, int]) -> list[dict[int, int]]:
    """What counts are asked for together, by order. Those of words and pairs go at once, others one order at a time, so
    that only the requests of one round are on disk."""
    return [{k: n for k, n in pieces.items() if k <= 2}] + [{k: n} for k, n in pieces.items() if k > 2]


def _answer_counts(whole: bool, top: int):
    """One part: the sum of all blocks' counts. Answers carry the counts with two bits: whether other blocks have the
    n-gram, too, and, of all that have it, for a single one that it is to speak for it. Counts of counts go along, and
    the part's table: ``whole``, or without the n-grams of single blocks, whose counts lie in the blocks' answers.
    Seen n-grams of several blocks that may be contexts, below the order ``top``, also get their row in the table, from
    1, as a short name."""
    def per_part(rows: pd.DataFrame) -> pd.DataFrame:
        order, part = int(rows["order"].iloc[0]), int(rows["part"].iloc[0])
        rows = rows.sort_values("block", kind="stable")
        asked = [expand_keys(k) for k in rows["keys"]]
        keys, by_key, number = _distinct(np.concatenate(asked))
        mine = np.concatenate([expand(v, np.uint32) for v in rows["values"]])
        edges = np.flatnonzero(np.diff(number, prepend=-1))
        total = np.add.reduceat(mine[by_key], edges, dtype=np.int64)
        shared = np.diff(edges, append=len(number)) > 1
        ordered = (total * 4 + 2 * shared)[number]
        ordered[edges] += 1
        reply = np.empty(len(ordered), np.int64)
        reply[by_key] = ordered
        ends = np.cumsum([len(a) for a in asked])[:-1]
        known = total > 0
        kept = known if whole else known & shared
        row = np.empty(len(ordered), np.int64)
        row[by_key] = np.where(known & shared & (order < top), np.cumsum(kept), 0)[number]
        out = [("answer", order, part, b, None, _joined(squeeze(r), squeeze_rows(w[w > 0])))
               for b, r, w in zip(rows["block"], np.split(reply, ends), np.split(row, ends))]
        few = np.bincount(np.minimum(total[known], SMALL + 2), minlength=SMALL + 3).astype(np.int64)
        few[0] = total.sum()
        out.append(("table", order, part, None, squeeze_keys(keys[kept]), squeeze(total[kept])))
        out.append(("sizes", order, part, None, None, few.astype(">i8").tobytes()))
        return pd.DataFrame(out, columns=["kind", "order", "part", "block", "keys", "values"])
    return per_part


def _told(answers: pd.DataFrame, kind: str, order: int) -> list[bytes]:
    rows = answers[(answers["kind"] == kind) & (answers["order"] == order)].sort_values("part")
    return list(rows["values"])


@dataclass
class Counts:
    """What a block was told of its n-grams of one order: counts in training, whether it speaks for them, whether
    other blocks have them, and the rows of those of several blocks that were seen, if they may be contexts."""

    n: np.ndarray
    speaks: np.ndarray
    shared: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, answers: pd.DataFrame, k: int) -> Counts:
        told = [_parted(v) for v in _told(answers, "answer", k)]
        raw = np.concatenate([expand(v, np.int64) for v, _ in told])
        found = cls(raw >> 2, raw & 1 == 1, raw & 2 == 2, np.zeros(len(raw), np.int64))
        rows = np.concatenate([expand_rows(w) for _, w in told])
        if len(rows):
            found.rows[(found.n > 0) & found.shared] = rows
        return found


SUMS = np.dtype([("few", "u4", SMALL), ("large", "i8"), ("few_below", "u4", SMALL), ("large_below", "i8"), ("wanted", "u1")])
BACKOFF = np.dtype([("kept", "f8"), ("below", "f8"), ("norm", "i8")])


def _binned(at: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n numbers how often it comes with which small count, and the sum of its larger counts."""
    small = counts <= SMALL
    few = np.bincount(at[small] * SMALL + counts[small] - 1, minlength=n * SMALL).reshape(n, SMALL)
    return few, np.bincount(at[~small], counts[~small], n).astype(np.int64)


def contributions(block: Block, k: int, counts: dict[int, Counts], own: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """SUMS of n contexts of order k over the seen n-grams ``own``, of the contexts ``at``: how many were seen how often,
    the sum of larger counts, and the same of what these n-grams end in."""
    out = np.zeros(n, SUMS)
    out["few"], out["large"] = _binned(at, counts[k].n[own], n)
    below = counts[k - 1].n[block.suffix[k][own]]
    if k > 2:
        out["few_below"], out["large_below"] = _binned(at, below, n)
    else:  # words and their counts
        out["few_below"][:, 0] = np.bincount(at, minlength=n)
        out["large_below"] = np.bincount(at, below, n)
    return out


def _weights(sums: np.ndarray, model: Model, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts of order k: the sum of discounted counts, and that of what the seen n-grams end in."""
    return tuple(sums[a] @ w[:-1] + sums[b] * w[-1] for a, b, w in
                 (("few", "large", model.kept(k)), ("few_below", "large_below", model.below(k))))


@dataclass
class Contexts:
    """How a block sees its contexts of order k: which it asks about, the run of begin marks and then the others in key
    order, which it backs off from, and which show it a discounted continuation.

    Contexts of no other block are its own, with all that follows them, so it weighs them itself. Nor does it ask about
    one that training has not, or one it neither contributes to nor backs off from, if it sees a discounted continuation:
    the norm is then the count of the context. Begin marks are everyone's.
    """

    asked: np.ndarray
    wanted: np.ndarray
    discounted: np.ndarray

    @classmethod
    def of(cls, block: Block, k: int, counts: dict[int, Counts]) -> Contexts:
        keys, context, told = block.contexts[k], block.context[k], counts[k]

        def marked(which: np.ndarray) -> np.ndarray:
            out = np.zeros(len(keys), bool)
            out[context[which]] = True
            return out

        below = counts[k - 1]
        shared = marked(slice(None)) & np.append(below.shared & (below.n > 0), False)
        wanted, discounted = marked(told.n == 0), marked((told.n > 0) & (told.n <= SMALL))
        asked = np.flatnonzero(shared & (~discounted | wanted | marked(told.speaks & (told.n > 0))))
        return cls(np.insert(asked, 0, len(keys) - 1), wanted, discounted)


def probabilities(block: Block, model: Model, counts: dict[int, Counts], answers: pd.DataFrame) -> np.ndarray:
    """log10 P of every distinct n-gram of the model's order, up from the lowest order. A context none of whose counts is
    discounted gives its unseen continuations one count; one never seen backs off in full."""
    out = model.base(counts[1].n)
    # a text has one end
    ends = counts[1].n[np.searchsorted(block.grams[1].keys, np.uint64(END))]
    shorter_norm = None
    for k in range(2, model.order + 1):
        seen_by, context, n = Contexts.of(block, k, counts), block.context[k], counts[k].n
        norm = np.append(counts[k - 1].n, ends) + ~seen_by.discounted
        asked = seen_by.asked
        told = [_parted(raw) for raw in _told(answers, "weight", k)]
        norm[asked] = np.append(counts[k - 1].n, ends)[asked] + np.concatenate([expand(raw, np.uint8) for raw, _ in told])
        # contexts the block backs off from: those of its own weighed here, others as told
        kept, below = np.zeros(len(norm)), np.zeros(len(norm))
        mine = seen_by.wanted.copy()
        mine[asked] = False
        mine = np.flatnonzero(mine)
        number = np.full(len(norm), -1)
        number[mine] = np.arange(len(mine))
        own = np.flatnonzero((n > 0) & (number[context] >= 0))
        kept[mine], below[mine] = _weights(contributions(block, k, counts, own, number[context[own]], len(mine)), model, k)
        wanted = asked[seen_by.wanted[asked]]
        kept[wanted], below[wanted] = _weights(np.concatenate([expand(raw, SUMS) for _, raw in told]), model, k)
        backed = np.flatnonzero(seen_by.wanted)
        rest = 1 - below[backed] / (shorter_norm[block.shorter[k][backed]] if k > 2 else 1.0)
        alpha = np.zeros(len(norm))
        alpha[backed] = np.log10((1 - kept[backed] / norm[backed]) / np.maximum(rest, 1e-300))
        lower, out = out, np.empty(len(n))
        known = n > 0
        unseen, seen = np.flatnonzero(~known), np.flatnonzero(known)
        out[unseen] = alpha[context[unseen]] + lower[block.suffix[k][unseen]]
        out[seen] = np.log10(model.discount(k, n[seen]) * n[seen] / norm[context[seen]])
        shorter_norm = norm
    return out


def ask_weights(blocks: DataFrame, answers: DataFrame, order: int, parts: dict[int, int]) -> DataFrame:
    """The contributions of every block to the contexts that it shares, and whether it backs off from them, for all
    orders at once. ``parts`` by the length of the context."""
    def per_block(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = Block(next(rows.itertuples(index=False)), order)
        counts = {j: Counts.of(replies, j) for j in range(1, order + 1)}
        told = []
        for k in range(2, order + 1):
            seen_by, keys = Contexts.of(b, k, counts), b.contexts[k]
            asked = seen_by.asked
            number = np.full(len(keys), -1)
            number[asked] = np.arange(len(asked))
            own = np.flatnonzero(counts[k].speaks & (counts[k].n > 0) & (number[b.context[k]] >= 0))
            sums = contributions(b, k, counts, own, number[b.context[k][own]], len(asked))
            sums["wanted"] = seen_by.wanted[asked]
            # row 0 of the first part stands for the begin marks
            keys, names = keys[asked], np.append(counts[k - 1].rows, 0)[asked]
            keys[0] = 0
            told += [(k, p, b.name, squeeze_rows(names[s]), squeeze(sums[s])) for p, s in slices(keys, parts[k - 1])]
        return pd.DataFrame(told, columns=["order", "part", "block", "keys", "values"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(per_block, REQUESTS)


def answer_weights(requests: DataFrame, model: Model) -> DataFrame:
    """One part: the sums of all blocks' contributions. Answers tell of every context whether its norm is one more than
    its count, as no count after it is discounted, and of those backed off from the sums that make the weight."""
    def per_part(rows: pd.DataFrame) -> pd.DataFrame:
        order, part = int(rows["order"].iloc[0]), int(rows["part"].iloc[0])
        rows = rows.sort_values("block", kind="stable")
        asked = [expand_rows(k) for k in rows["keys"]]
        names, by_key, number = _distinct(np.concatenate(asked))
        told = np.concatenate([expand(v, SUMS) for v in rows["values"]])
        edges = np.flatnonzero(np.diff(number, prepend=-1))
        sums = np.zeros(len(names), SUMS)
        for name in ("few", "large", "few_below", "large_below"):
            sums[name] = np.add.reduceat(told[name][by_key], edges, dtype=np.int64)
        more = ~sums["few"].any(axis=1)
        at = np.empty(len(number), np.int64)
        at[by_key] = number
        out, end = [], 0
        for name, own in zip(rows["block"], asked):
            mine, wanted = at[end:end + len(own)], told["wanted"][end:end + len(own)] > 0
            end += len(own)
            flags = squeeze(more[mine].astype(np.uint8))
            out.append(("weight", order, part, name, None, _joined(flags, squeeze(sums[mine[wanted]]))))
        table = np.empty(len(names), BACKOFF)
        table["norm"] = sums["few"] @ np.arange(1, SMALL + 1) + sums["large"] + more
        table["kept"], table["below"] = _weights(sums, model, order)
        out.append(("backoff", order, part, None, squeeze_rows(names), squeeze(table)))
        return pd.DataFrame(out, columns=["kind", "order", "part", "block", "keys", "values"])

    return requests.groupBy("order", "part").applyInPandas(per_part, ANSWERS)


def score_blocks(blocks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    order = model.order

    def per_block(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        b = Block(next(rows.itertuples(index=False)), order)
        counts = {k: Counts.of(replies, k) for k in range(1, order + 1)}
        p = probabilities(b, model, counts, replies)
        words = b.grams[1].at
        add = lambda x: np.add.reduceat(x, b.starts)
        return pd.DataFrame({
            "doc_id": pd.Series(b.ids, dtype="Int64").where(pd.Series(b.flags != NO_ID)), "held_out": b.flags == HELD,
            "n_tokens": b.lengths, "n_known": add((counts[1].n > 0).astype(np.int64)[words]),
            "train_tokens": model.tokens, "base_score": add(model.base(counts[1].n)[words]),
            "score": add(p[b.grams[order].at])})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(per_block, SCORES)


def _sizes(answers: DataFrame, order: int) -> Model:
    """Sums of the parts' counts of counts."""
    unpack = lambda i: F.conv(F.hex(F.substring("values", 8 * i + 1, 8)), 16, 10).cast("bigint")
    rows = answers.where("kind = 'sizes'").groupBy("order").agg(
        *[F.sum(unpack(i)).alias(f"n{i}") for i in range(SMALL + 3)]).collect()
    by = {r["order"]: np.array([r[f"n{i}"] for i in range(SMALL + 3)], np.int64) for r in rows}
    return Model(order, int(by[1][0]), int(by[1][1:].sum()), {k: discounts(n[:SMALL + 2]) for k, n in by.items()})


def katz_scores(docs: DataFrame, order: int = ORDER, parts: int = 10, held: int = 0, block_tokens: int | None = None,
                folder: str | None = None) -> DataFrame:
    """SCORES of every row of ``docs``, learned from the rows outside the fold ``held``.

    ``folder`` receives the tables, partitioned by kind and order: ``table`` (n-gram hashes and counts) and
    ``backoff`` (BACKOFF of contexts of several blocks, whose keys are rows, from 1, of the same part of the table one
    order lower; 0 is the begin marks). A context's weight is (1 - kept / norm) / (1 - below / the norm of the context one
    word shorter), where the norm of a context of no words is 1. Without ``folder`` the tables lie in the shared folder,
    and what one block alone has is kept in that block's answers only. Null and empty texts are a lone end. A row with a null
    id is scored but not learned from and not held out; repeated rows count and are scored as often as given. Without
    training rows every token is unknown. Blocks and parts grow with the square root of the corpus, from LEAST_BLOCK to
    MOST_BLOCK tokens, so the number of requests stays in proportion.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], SCORES)
    # each stage is written, so its shuffle files may go as soon as it is done
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        width = block_tokens or int(min(max((12 * size / 6) ** 0.5, LEAST_BLOCK), MOST_BLOCK))
        blocks = stage(make_blocks(docs, held, parts, width), "blocks")
        pieces = {k: max(1, -(-size // (6 * width * (4 if k == 1 else 1)))) for k in range(1, order + 1)}
        path = folder or scratch_path(spark, "katz")
        for number, asked in enumerate(rounds(pieces)):
            ask_counts(blocks, asked).groupBy("order", "part").applyInPandas(_answer_counts(folder is not None, order), ANSWERS).write.mode(
                "append" if number else "errorifexists").partitionBy("kind", "order").parquet(f"{path}/counts")
        told = spark.read.schema(ANSWERS).parquet(f"{path}/counts")
        model = _sizes(told, order)
        answers = told.where("kind = 'answer'").select("kind", "order", "part", "block", "values")
        if order > 1:
            answer_weights(ask_weights(blocks, answers, order, pieces), model).write.partitionBy("kind", "order").parquet(
                f"{path}/weights")
            weights = spark.read.schema(ANSWERS).parquet(f"{path}/weights")
            answers = answers.unionByName(weights.where("kind = 'weight'").select(*answers.columns))
        return stage(score_blocks(blocks, answers, model), "scores")
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
