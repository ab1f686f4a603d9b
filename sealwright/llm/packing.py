"""Packing token sequences into windows by non-negative least squares.

Every task packs the documents of its partition block by block (a bounded number of tokens), so nothing is
shuffled. Of each block, whole windows are cut from long documents; what remains of each is a piece shorter
than a window. Pieces are binned by length, shallow combinations of bins that fill a window are enumerated, and
non-negative least squares finds how often to repeat each combination so that the histogram of the block is
used up. The repeats are rounded down. Pieces that no combination takes are packed greedily: cut to fill the
gaps of the windows exactly, and laid end to end into further windows. What is left at the end of a block waits
for the next one; the last run of a partition is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

WINDOW = 2048
BINS = 64  # length bins of a window
SHALLOW = 3  # pieces of a combination
BLOCK_TOKENS = 4_000_000  # tokens packed at a time
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary
END = 1  # id that closes every document
CACHE = 500_000  # words whose ids a task keeps


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """x >= 0 with least squared error of a @ x - b, by an active set of the columns in use."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gram, ab = a.T @ a, a.T @ b
    limit = tolerance * max(1.0, float(np.abs(ab).max(initial=0.0)))
    for _ in range(3 * n):
        w = np.where(used, -np.inf, ab - gram @ x)
        j = int(np.argmax(w))
        if w[j] <= limit:
            break
        used[j] = True
        while True:
            k = np.flatnonzero(used)
            s = np.linalg.lstsq(gram[np.ix_(k, k)], ab[k], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[k] = s
                break
            low = s <= 0
            t = np.min(x[k][low] / np.maximum(x[k][low] - s[low], 1e-300))
            x[k] += t * (s - x[k])
            off = k[low & (x[k] <= 1e-12)]
            if not len(off):
                off = k[low][:1]
            x[off], used[off] = 0, False
            if not used.any():
                break
    return x


@lru_cache(maxsize=8)
def combinations(bins: int, shallow: int) -> np.ndarray:
    """Columns: how often each bin (1..bins) occurs in a combination of at most ``shallow`` pieces whose bin
    numbers add up to ``bins``, so that their lengths fit a window."""
    found: list[list[int]] = []

    def extend(parts: list[int], rest: int, most: int) -> None:
        if rest == 0:
            found.append(parts)
        elif len(parts) < shallow:
            for p in range(min(rest, most), 0, -1):
                extend([*parts, p], rest - p, p)

    extend([], bins, bins - 1)
    out = np.zeros((bins, len(found)))
    for k, parts in enumerate(found):
        np.add.at(out[:, k], np.array(parts) - 1, 1)
    return out


def repeats(histogram: np.ndarray, shallow: int = SHALLOW) -> list[tuple[list[int], int]]:
    """Combinations (as bin indices, large to small) and how often each can be used, never more than the
    histogram has."""
    columns = combinations(len(histogram), shallow)
    usable = np.flatnonzero((columns > 0)[histogram == 0].sum(0) == 0)
    if not len(usable) or not histogram.any():
        return []
    x = nnls(columns[:, usable], histogram.astype(float))
    left = histogram.astype(np.int64).copy()
    out = []
    for k in np.argsort(-x, kind="stable"):
        need = columns[:, usable[k]].astype(np.int64)
        n = min(int(x[k] + 1e-6), int((left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            out.append(([i for i in range(len(need) - 1, -1, -1) for _ in range(need[i])], n))
    return out


@dataclass
class Piece:
    """Ids ``start`` to ``start + length`` of the document at ``doc``."""

    doc: int
    start: int
    length: int


@dataclass
class Packed:
    """Sequences of pieces, and the pieces that wait for the next block."""

    sequences: list[list[Piece]] = field(default_factory=list)
    rest: list[Piece] = field(default_factory=list)


def pack(pieces: Iterable[Piece], window: int = WINDOW, bins: int = BINS) -> Packed:
    """Sequences of exactly ``window`` ids; all other pieces, fewer ids than a window, are the rest."""
    bins = min(bins, window)
    out, short = Packed(), []
    for p in pieces:
        whole = p.length // window
        out.sequences += [[Piece(p.doc, p.start + k * window, window)] for k in range(whole)]
        if p.length > whole * window:
            short.append(Piece(p.doc, p.start + whole * window, p.length - whole * window))
    unit = window / bins
    by_bin: list[list[Piece]] = [[] for _ in range(bins)]
    for p in short:
        by_bin[min(bins, int(np.ceil(p.length / unit))) - 1].append(p)
    planned: list[list[Piece]] = []
    for parts, n in repeats(np.array([len(b) for b in by_bin])):
        planned += [[by_bin[i].pop() for i in parts] for _ in range(n)]
    loose = [p for b in by_bin for p in b]
    # gaps are filled from the loose pieces; while these are too few, planned windows are taken apart
    missing = sum(window - sum(p.length for p in s) for s in planned)
    have = sum(p.length for p in loose)
    planned.sort(key=lambda s: sum(p.length for p in s))
    apart = 0
    while missing > have and apart < len(planned):
        filled = sum(p.length for p in planned[apart])
        missing -= window - filled
        have += filled
        loose += planned[apart]
        apart += 1
    stream = loose[::-1]

    def take(n: int) -> list[Piece]:
        got = []
        while n:
            p = stream.pop()
            if p.length > n:
                stream.append(Piece(p.doc, p.start + n, p.length - n))
                p = Piece(p.doc, p.start, n)
            got.append(p)
            n -= p.length
        return got

    for s in planned[apart:]:
        out.sequences.append(s + take(window - sum(p.length for p in s)))
    have = sum(p.length for p in stream)
    for _ in range(have // window):
        out.sequences.append(take(window))
    out.rest = stream[::-1]
    return out


def powers(rest: list[Piece], window: int) -> list[list[Piece]]:
    """The last run, cut into sequences whose lengths are powers of two, large to small."""
    stream, out, have = rest[::-1], [], sum(p.length for p in rest)
    while have:
        n = min(window, 1 << (have.bit_length() - 1))
        have -= n
        got: list[Piece] = []
        while n:
            p = stream.pop()
            if p.length > n:
                stream.append(Piece(p.doc, p.start + n, p.length - n))
                p = Piece(p.doc, p.start, n)
            got.append(p)
            n -= p.length
        out.append(got)
    return out


class Encoder:
    """Ids of whole texts, as the tokenizer gives them without special tokens.

    A single space between two other characters always begins a new token group, so a text is cut there and
    the ids of each part are remembered. New parts are encoded by the rank file of the same vocabulary, which
    is faster for short strings; parts that hold an added token's text go to the tokenizer itself.
    """

    #: a space beside white space or at an end, which belongs to its neighbours
    ODD = re.compile(r"\s | \s|\A | \Z")

    def __init__(self, path: str, ranks: str | None = None, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                           special_tokens={})
        self.cache = cache
        self.known: dict[str, bytes] = {}  # of parts that follow a space, without it

    def ids(self, part: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a string."""
        if self.quick is None or any(a in part for a in self.added):
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        else:
            ids = self.quick.encode_ordinary(part)
        return array("I", ids).tobytes()

    def _after_space(self, parts: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            if len(known) > self.cache:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = self.ids(" " + p)
            return b"".join([known[p] for p in parts])

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of a whole text."""
        if not text:
            return np.empty(0, np.uint32)
        if self.ODD.search(text) is None:
            first, *rest = text.split(" ")
            return np.frombuffer(self.ids(first) + self._after_space(rest), np.uint32)
        out, run, fresh = [], "", True  # fresh: the run began after a space of its own
        for n, part in enumerate(text.split(" ")):
            if n and run and not run[-1].isspace() and part and not part[0].isspace():
                out.append(self.ids(run) if fresh else self._after_space([run]))
                run, fresh = part, False
            elif n:
                run, fresh = ("" if fresh else " ") + run + " " + part, True
            else:
                run = part
        out.append(self.ids(run) if fresh else self._after_space([run]))
        return np.frombuffer(b"".join(out), np.uint32)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, window: int = WINDOW,
                   block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence; ``with_ids`` adds the ids.

    Null and empty texts are one id long. Repeated rows and null ids are packed like any other row, and
    columns other than ``doc_id`` and ``text`` are not read. ``sequence_id`` counts up within a partition,
    whose number is in its upper bits. The size of a text is only bounded by the memory of a task.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer, ranks)
        base = TaskContext.get().partitionId() << 33
        docs: dict[int, tuple] = {}
        block: list[Piece] = []
        size, number, serial = 0, 0, 0

        def rows(sequences: list[list[Piece]]) -> pd.DataFrame:
            nonlocal number
            out, slices = [], []
            for s in sequences:
                at = 0
                for p in s:
                    doc_id, ids = docs[p.doc]
                    cut = ids[p.start:p.start + p.length]
                    out.append((doc_id, p.start, p.length, zlib.crc32(cut.astype("<u4").tobytes()), len(ids),
                                base + number, at))
                    if with_ids:
                        slices.append(cut.astype(np.int64))
                    at += p.length
                number += 1
            frame = pd.DataFrame(out, columns=COLUMNS)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            if with_ids:
                frame["ids"] = pd.Series(slices, dtype=object)
            return frame

        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for doc_id, text in zip(ids, batch["text"]):
                tokens = np.append(encoder.encode(text or ""), np.uint32(END))
                docs[serial] = (None if pd.isna(doc_id) else int(doc_id), tokens)
                block.append(Piece(serial, 0, len(tokens)))
                serial += 1
                size += len(tokens)
                if size >= block_tokens:
                    packed = pack(block, window)
                    yield rows(packed.sequences)
                    block = packed.rest
                    docs = {p.doc: docs[p.doc] for p in block}
                    size = sum(p.length for p in block)
        packed = pack(block, window)
        yield rows(packed.sequences + powers(packed.rest, window))

    schema = ", ".join(f"{c} bigint" for c in COLUMNS) + (", ids array<bigint>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(per_task, schema)
