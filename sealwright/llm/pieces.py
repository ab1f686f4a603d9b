"""Sentence-piece encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. In each round every word finds its best pair (smallest rank,
leftmost) by a segmented minimum; all words merge theirs at the same time, the array is compacted, and rounds go
on until no pair is left. Only the best pair of a word merges in a round, because a merge can create a pair that
ranks before the rest. Words over LONG symbols are merged by a heap instead, whose time does not grow with the
square of their length. The model file supplies pieces and scores; encoding and decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LONG = 48
CACHE = 400_000  # words whose encoding a task keeps
NO_RANK = np.int64(1) << 40


class Vocabulary:
    """Pieces of a byte-pair model with byte fallback.

    ``rank`` orders merges: the best score first, as the library does. Symbols are piece ids, or numbers from
    ``size`` for characters that are no piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
                 for i in range(n)]
        self.number = {p: i for i, (p, ok) in enumerate(zip(self.pieces, plain)) if ok}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        scores = np.array([model.get_score(i) for i in range(n)])
        # equal scores share a rank, so that the leftmost of them merges first
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.characters: dict[str, int] = {}
        keys, into = [], []
        parts = dict(self.number)
        for piece in self.number:  # single characters that only occur inside longer pieces
            for ch in piece:
                parts.setdefault(ch, self._character(ch))
        for piece, i in self.number.items():
            for k in range(1, len(piece)):
                left, right = parts.get(piece[:k]), parts.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    into.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_key = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_into = np.append(np.array(into, np.int64)[order], 0)
        self.pair = dict(zip(keys, into))
        # where no piece joins across a break, words are independent of each other
        if any(a != SPACE and b == SPACE for p in self.number for a, b in zip(p, p[1:])):
            raise ValueError("pieces that join a word to a following space are not supported")
        self.alone = {c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.number)}

    def words(self, text: str) -> list[str]:
        """Parts of a text that are encoded independently of each other."""
        return split_words(text, "\n" in self.alone)

    def _character(self, ch: str) -> int:
        return self.characters.setdefault(ch, self.size + len(self.characters))

    def symbol(self, ch: str) -> int:
        i = self.number.get(ch)
        return self._character(ch) if i is None else i

    def spelled(self, symbol: int, characters: dict[int, str]) -> list[int]:
        """Ids of a symbol: itself, or its bytes where it is no piece."""
        if symbol < self.size:
            return [symbol]
        return [self.byte_id[b] for b in characters[symbol].encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_LINE = re.compile("\n|[^\n]+")


def split_words(text: str, lines: bool = False) -> list[str]:
    """The text with its leading mark, cut before each run of marks; joined again they are the whole.
    ``lines`` cuts around line feeds too, for models in which no longer piece has one."""
    marked = SPACE + text.replace(" ", SPACE)
    words = marked.split(SPACE)[1:]
    if all(words):
        out = [SPACE + w for w in words]
    else:
        out, run = [], ""
        for w in words:
            run += SPACE + w
            if w:
                out.append(run)
                run = ""
        if run:
            out.append(run)
    if lines and "\n" in text:
        out = [p for w in out for p in (_LINE.findall(w) if "\n" in w else (w,))]
    return out


def merge_words(vocab: Vocabulary, words: list[str]) -> list[list[int]]:
    """Ids of each word."""
    characters = {i: c for c, i in vocab.characters.items()}
    known = vocab.number
    symbols: list[int] = []
    lengths = np.empty(len(words), np.int64)
    for k, word in enumerate(words):
        symbols += [known[c] if c in known else vocab.symbol(c) for c in word]
        lengths[k] = len(word)
    if vocab.characters and len(vocab.characters) != len(characters):
        characters = {i: c for c, i in vocab.characters.items()}
    flat = np.array(symbols, np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # symbols and owners of words without a pair
    while len(flat) > 1:
        keys = flat[:-1] << 32 | flat[1:]
        at = np.searchsorted(vocab.pair_key, keys)
        hit = (vocab.pair_key[at] == keys) & (owner[:-1] == owner[1:])
        into = vocab.pair_into[at]
        rank = np.append(np.where(hit, vocab.rank[into], NO_RANK), NO_RANK)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(flat)))
        # rank and position in one number: the minimum is the best pair, the leftmost of equals
        best = np.minimum.reduceat(rank * len(rank) + np.arange(len(rank)), starts)
        live = best < NO_RANK * len(rank)
        if not live.all():
            idle = np.repeat(~live, sizes)
            done.append((flat[idle], owner[idle]))
        if not live.any():
            flat, owner = flat[:0], owner[:0]
            break
        left = best[live] % len(rank)
        flat[left] = into[left]
        keep = np.repeat(live, sizes)
        keep[left + 1] = False
        flat, owner = flat[keep], owner[keep]
    done.append((flat, owner))
    flat, owner = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(words)))[:-1] if len(words) else []
    out = [part.tolist() for part in np.split(flat[order], ends)]
    size = vocab.size
    return [ids if max(ids, default=0) < size else [i for s in ids for i in vocab.spelled(s, characters)]
            for ids in out]


def merge_long(vocab: Vocabulary, word: str) -> list[int]:
    """The same merges for one word of any length, with a heap of pairs and linked neighbours."""
    symbols = [vocab.symbol(c) for c in word]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i >= 0 and j < n:
            into = vocab.pair.get(symbols[i] << 32 | symbols[j])
            if into is not None:
                heapq.heappush(heap, (int(vocab.rank[into]), i, symbols[i], symbols[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = vocab.pair[left << 32 | right], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    characters = {i: c for c, i in vocab.characters.items()}
    return [i for s in symbols if s >= 0 for i in vocab.spelled(s, characters)]


def encode_words(vocab: Vocabulary, words: list[str]) -> list[list[int]]:
    short = [w for w in words if len(w) <= LONG]
    found = dict(zip(short, merge_words(vocab, short)))
    return [found[w] if len(w) <= LONG else merge_long(vocab, w) for w in words]


def encode(vocab: Vocabulary, text: str | None) -> list[int]:
    """Ids of a whole text; none for null and empty."""
    return [i for ids in encode_words(vocab, vocab.words(text)) for i in ids] if text else []


def decode_bytes(vocab: Vocabulary, ids: list[int]) -> bytes:
    """The marked text of some ids as UTF-8, the leading mark included."""
    out = []
    for i in ids:
        b = vocab.byte_of.get(i)
        if b is not None:
            out.append(bytes([b]))
        elif i not in vocab.silent:
            out.append((" ⁇ " if i == vocab.unknown else vocab.pieces[i].replace(SPACE, " ")).encode())
    return b"".join(out)


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """Text of ids: pieces joined, marks to spaces, without the space that leads every text. Bytes that form
    no character become U+FFFD each."""
    raw = decode_bytes(vocab, ids)
    first = next((i for i in ids if i not in vocab.silent), vocab.unknown)
    raw = raw[1:] if raw[:1] == b" " and first != vocab.unknown and first not in vocab.byte_of else raw
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode("utf-8"))
                break
            except UnicodeDecodeError as bad:
                out.append(raw[at:at + bad.start].decode("utf-8") + "�")
                at += bad.start + 1
        return "".join(out)


class Coder:
    """Encodes and decodes texts by words, remembering the words of a task."""

    def __init__(self, path: str, cache: int = CACHE):
        self.vocab = vocabulary(path)
        self.cache = cache
        self.known: dict[str, tuple[bytes, int, bytes]] = {}  # ids as text, their number, decoded bytes

    def learn(self, texts: list[str]) -> None:
        """Encodes all new words of some texts together."""
        known = self.known
        if len(known) > self.cache:
            known.clear()
        new = list({w for t in texts for w in self.vocab.words(t) if w not in known})
        for low in range(0, len(new), 50_000):
            some = new[low:low + 50_000]
            for word, ids in zip(some, encode_words(self.vocab, some)):
                known[word] = (",".join(map(str, ids)).encode(), len(ids), decode_bytes(self.vocab, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text; the words must be known."""
        rows = [self.known[w] for w in self.vocab.words(text)] if text else []
        decoded = b"".join([r[2] for r in rows])[1:]
        try:
            decoded.decode("utf-8")
        except UnicodeDecodeError:
            ids = [int(i) for r in rows for i in r[0].split(b",")]
            decoded = decode(self.vocab, ids).encode()
        return (sum([r[1] for r in rows]), hashlib.sha256(b",".join([r[0] for r in rows])).hexdigest(),
                hashlib.sha256(decoded).hexdigest())


def piece_digests(docs: DataFrame, model: str | None = None, step: int = 1 << 22, with_ids: bool = False) -> DataFrame:
    """For every row ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; ``with_ids`` adds the ids.

    Null and empty texts have no ids. Repeated rows and null ids are kept as given; columns other than
    ``doc_id`` and ``text`` are not read. Words are learned for at most about ``step`` characters at a time
    (one text, if longer).
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(model)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            sizes = np.cumsum([len(t) for t in texts]) // step
            out = []
            for k in np.unique(sizes):
                some = [texts[i] for i in np.flatnonzero(sizes == k)]
                coder.learn(some)
                out += [coder.digest(t) for t in some]
            frame = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            if with_ids:
                frame["ids"] = [encode(coder.vocab, t) for t in texts]
            yield frame

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(
        per_task, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        + (", ids array<bigint>" if with_ids else ""))
