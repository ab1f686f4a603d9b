"""Statistics of whole texts, and bounded samples of labelled rows.

A word is ``[^\\x20\\x09-\\x0D]+``. In UTF-8 those six characters are single bytes, so splitting the
bytes at ASCII white space gives exactly these words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# The six white-space characters and the symbols that count as such.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?;:\"'()[]{}~^_=+/\\@"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_rate", "dup_line_share", "repeat_share", "distinct_share", "top_share", "upper_share",
          "digit_share", "mark_rate", "letter_share", "line_words", "bar_rate", "bang_rate")
STATS = (*COUNTS, *RATIOS)

SCHEMA = ", ".join([f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in RATIOS])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more; the first counts too."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    hit = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def measure(text: str | None) -> tuple:
    """One value for each of STATS. Null and empty texts give zeros."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    doubled = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    count: dict = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    among = lambda which: len(raw) - len(raw.translate(None, which))
    letters, upper = among(_LETTERS), among(_UPPER)
    return (n, chars, symbols, doubled, repeats,
            _share(chars, n), _share(symbols, n), _share(doubled, len(lines)), _share(repeats, n),
            _share(len(count), n), _share(max(count.values(), default=0), n), _share(upper, letters),
            _share(among(_DIGITS), len(raw)), _share(among(_MARKS), n), _share(letters, len(raw)),
            _share(n, len(lines)), _share(raw.count(b"|"), n), _share(raw.count(b"!"), n))


def with_stats(docs: DataFrame) -> DataFrame:
    """``doc_id``, the MD5 of the text and STATS of every row of ``docs``; other columns are not read."""
    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measure(t) for t in batch["text"]], columns=list(STATS))
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "text_md5", [md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in batch["text"]])
            yield out

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(
        per_batch, f"doc_id bigint, text_md5 string, {SCHEMA}")


def fold(column: str = "doc_id", parts: int = 1):
    """crc32 of the id as text, modulo ``parts``; null ids belong to no fold."""
    return F.crc32(F.col(column).cast("string")) % parts


def label_sample(labels: DataFrame, label: str, per_class: int, seed: int = 17) -> DataFrame:
    """(doc_id, y): at most about ``per_class`` labelled documents of each class, chosen by a hash of the id.

    Rows with a null id or a label other than 0 and 1 are left out; a document labelled twice counts once,
    as 1 if any row says so. The class sizes are counted over all rows; the sample's size is bounded, so
    its join may be broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    wanted = F.lit(False)
    for y, n in sizes.items():
        wanted = wanted | ((F.col("y") == y) & (draw < int(1_000_000 * min(1.0, per_class / n))))
    return known.where(wanted)
