"""Conversations damaged by a fixed rule, and their cheapest repair by weighted interval parsing.

The repaired roles must read ``(s?(ua)+)?``. A span of rows is parsed by a grammar in Chomsky normal form whose
nonterminal ``X[p][q]`` stands for "the span leads from state p to state q": ``X[p][q] -> X[p][r] X[r][q]`` and, for
one row, ``X[p][q] -> edit``, closed over insertions before and after. A cell keeps the least (cost, audit) of its
nonterminal. Cells are combined bottom-up by span length. The language is regular, so every split of a span gives the
same cell; spans of 1, 2, 4, ... rows are therefore enough, and a stretch of n rows takes n - 1 combinations.

The least audit of a span may be put together from the least audits of its parts: two audits of one span and one cost
have the same letters for its rows, hence equally many insertions, so none is a proper prefix of the other.

Rows of one conversation are ordered by turn (nulls first); rows of one turn by role, then by a digest of role and
text. They are range-partitioned by that
order, so a conversation of any size spreads; only its audit and the digest of its repaired text, one value each and
the latter sequential by definition, are made in one task, streamed. Null ``conv_id`` is a conversation of its own.
Null conv_id, turn, role and text count as one space in the damage rule, role and text also afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import skew_join
from ..session import stage
from .textstats import SPACES

START, SYSTEM, USER, ASSISTANT = range(4)
#: (from, to) by the role initial that is put out.
MOVES = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
FINAL = (START, ASSISTANT)
RETYPE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
ROLE_FROM = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
#: Kinds of parsed stretches that a task remembers; only time depends on it.
REMEMBERED = 20_000

Cell = tuple[dict[int, tuple[int, str]], ...]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans: for every pair of states the least way through any state between them."""
    out = []
    for row in left:
        best: dict[int, tuple[int, str]] = {}
        for middle, (cost, audit) in row.items():
            for q, (more, rest) in right[middle].items():
                way = (cost + more, audit + rest)
                if q not in best or way < best[q]:
                    best[q] = way
        out.append(best)
    return tuple(out)


def _insertions() -> Cell:
    """What insertions alone reach, from every state."""
    step: Cell = tuple({p: (0, "")} | {q: (INSERT, "I") for initial in "ua" for a, q in MOVES[initial] if a == p}
                       for p in range(4))
    return joined(step, step)


CLOSURE = _insertions()


def row_cell(initial: str, refused: bool, cut: bool) -> Cell:
    """The cell of one row: its edits between insertions. ``refused`` rows must go, ``cut`` ones cost more if kept."""
    extra = CUT_SHORT if cut else 0
    edits: list[dict[int, tuple[int, str]]] = [{p: (DELETE, "D")} for p in range(4)]

    def offer(p: int, q: int, way: tuple[int, str]) -> None:
        if q not in edits[p] or way < edits[p][q]:
            edits[p][q] = way

    if not refused:
        for p, q in MOVES.get(initial, ()):
            offer(p, q, (extra, "K"))
        for wanted in "ua":
            for p, q in MOVES[wanted]:
                offer(p, q, (RETYPE + extra, "R"))
    return joined(joined(CLOSURE, tuple(edits)), CLOSURE)


KINDS = [(i, d, c) for i in ("s", "u", "a", "") for d in (False, True) for c in (False, True)]
ROW_CELLS = [row_cell(*kind) for kind in KINDS]


def kind_of(role: str, refused: bool, cut: bool) -> int:
    """Number in KINDS of a row; cut rows that must go are not cut."""
    return KINDS.index((role[:1] if role[:1] in ("s", "u", "a") else "", refused, cut and not refused))


_KIND = {(i, d, c): kind_of(i, d, c) for i in ("s", "u", "a", "") for d in (False, True) for c in (False, True)}


def span_cell(kinds: bytes) -> Cell | None:
    """The cell of a whole span of rows; None for no rows."""
    level = [ROW_CELLS[k] for k in kinds]
    while len(level) > 1:
        odd = [level[-1]] if len(level) % 2 else []
        level = [joined(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)] + odd
    return level[0] if level else None


def verdict(cell: Cell | None) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return (0, "") if cell is None else min(cell[START][q] for q in FINAL if q in cell[START])


class Repaired:
    """Digest of a repaired conversation, fed row by row."""

    def __init__(self, audit: str) -> None:
        self.letters, self.at, self.state, self.empty, self.sha = audit, 0, START, True, hashlib.sha256()

    def _put(self, line: str, state: int) -> None:
        if not self.empty:
            self.sha.update(b"\n")
        self.sha.update(line.encode("utf-8", "surrogatepass"))
        self.empty, self.state = False, state

    def _inserted(self) -> None:
        while self.letters[self.at:self.at + 1] == "I":
            self._role("")
            self.at += 1

    def _role(self, text: str) -> None:
        role = ROLE_FROM[self.state]
        self._put(f"{role}:{text}", USER if role == "user" else ASSISTANT)

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self._put(f"{role}:{text}", {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]])
        elif letter == "R":
            self._role(text)

    def hexdigest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


# ---- damage -----------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``alive`` of every row after damage; dropped rows stay with ``alive`` false, so
    that no conversation is lost."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fate.isin(0, 1), F.lit("")).when(fate == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return (rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                        F.when(fate == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
                        text.alias("text"), (fate != 0).alias("alive"),
                        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


# ---- stretches of sorted partitions -----------------------------------------------------------

def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple], bool]]:
    """(conv_id, rows, whether the stretch touches an end of the partition) of a partition sorted by conversation."""
    held: tuple[object, list[tuple]] | None = None
    first = True
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and held[0] == key:
                held[1].append(row)
                continue
            if held is not None:
                yield *held, first
                first = False
            held = (key, [row])
    if held is not None:
        yield *held, True


class _Faults:
    """Counts over the rows of a stretch, in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None
        self.kinds = bytearray()

    def add(self, turn: int | None, role: str, text: str, seen: Callable[[], bool]) -> None:
        body = text.rstrip(SPACES)
        blank = not body
        double = not blank and seen()
        cut = not blank and not double and body[-1] not in ".!?"
        self.blank += blank
        self.duplicate += double
        self.truncated += cut
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.kinds.append(_KIND[initial if initial in ("s", "u", "a") else "", blank or double, cut])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = f"conv_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every stretch as if it were a whole conversation, with ``edge`` where it may go on in another partition."""
    known: dict[bytes, tuple[int, str]] = {}

    def rows() -> Iterator[tuple]:
        for key, held, edge in _stretches(batches):
            faults, met, kept = _Faults(), set(), [r for r in held if r[3]]
            for turn, role, text, _ in kept:
                pair = (role, text)
                faults.add(turn, role, text, lambda: pair in met)
                met.add(pair)
            kinds = bytes(faults.kinds)
            if kinds not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[kinds] = verdict(span_cell(kinds))
            cost, audit = known[kinds]
            out = Repaired(audit)
            for _, role, text, _ in kept:
                out.row(role, text)
            gaps = faults.high - faults.low + 1 - faults.distinct if faults.distinct else 0
            yield (key, gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost, audit,
                   out.hexdigest(), edge)

    yield from _batches(rows(), _arrow(f"{RESULT}, edge boolean"))


# ---- conversations that go over several partitions -----------------------------------------------

_PART = ("conv_id bigint, place bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
         "first string, last string, low bigint, high bigint, distinct bigint, "
         + ", ".join(f"cost{p}{q} bigint, audit{p}{q} string" for p in range(4) for q in range(p and 1, 4)))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stretch: counts, ends and the cell of its span; duplicates are marked already."""
    def rows() -> Iterator[tuple]:
        for key, held, _ in _stretches(batches):
            faults, kept = _Faults(), [r for r in held if r[3]]
            for turn, role, text, _, double, _ in kept:
                faults.add(turn, role, text, lambda: double)
            cell = span_cell(bytes(faults.kinds)) or ({}, {}, {}, {})
            ways = [x for p in range(4) for q in range(p and 1, 4) for x in cell[p].get(q, (None, None))]
            yield (key, held[0][5], len(kept), faults.blank, faults.duplicate, faults.truncated, faults.illegal,
                   faults.first, faults.last, faults.low, faults.high, faults.distinct, *ways)

    yield from _batches(rows(), _arrow(_PART), 200)


def _merge(table: pa.Table) -> pa.Table:
    """The parts of one conversation in order, as one verdict without digest."""
    parts = sorted(table.to_pylist(), key=lambda r: r["place"])
    counts = {c: sum(r[c] for r in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    cell, last, low, high, distinct = None, None, None, None, 0
    for part in parts:
        if not part["n"]:
            continue
        here = tuple({q: (part[f"cost{p}{q}"], part[f"audit{p}{q}"]) for q in range(p and 1, 4)
                      if part[f"cost{p}{q}"] is not None} for p in range(4))
        # only ways from the start matter from here on
        cell = here if cell is None else joined((cell[0], {}, {}, {}), here)
        if last is not None and last + part["first"] not in ("su", "ua", "au"):
            counts["illegal"] += 1
        last = part["last"]
        distinct += part["distinct"] - (part["distinct"] > 0 and part["low"] == high)
        low = part["low"] if low is None else low
        high = part["high"] if part["high"] is not None else high
    cost, audit = verdict(cell)
    gaps = high - low + 1 - distinct if distinct else 0
    row = (parts[0]["conv_id"], gaps, *counts.values(), cost, audit, None)
    return pa.table([pa.array([v], f.type) for v, f in zip(row, _arrow(RESULT))], schema=_arrow(RESULT))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, digest): of each conversation its audit comes first, then its rows; nothing is held but the digest."""
    def rows() -> Iterator[tuple]:
        key, out = None, None
        for batch in batches:
            for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    if out is not None:
                        yield key, out.hexdigest()
                    key, out = conv, Repaired(audit)
                else:
                    out.row(role, text)
        if out is not None:
            yield key, out.hexdigest()

    yield from _batches(rows(), _arrow("conv_id bigint, repaired_sha256 string"))


def _parse_long(rows: DataFrame) -> DataFrame:
    """Verdicts of conversations whose rows lie in several partitions."""
    ranged = rows.repartitionByRange("conv_id", "turn", "role", "md5", "tie").sortWithinPartitions(
        "conv_id", "turn", "role", "md5", "tie")
    placed = stage(ranged.withColumn("place", F.monotonically_increasing_id()), "placed")
    # only texts that occur twice or more have a later row; the place of the first is one row for all its copies
    firsts = placed.where("alive").groupBy(F.coalesce("conv_id", F.lit(0)).alias("key"), F.col("conv_id").isNull().alias("none"),
                                           "md5").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keyed = placed.withColumns({"key": F.coalesce("conv_id", F.lit(0)), "none": F.col("conv_id").isNull()})
    marked = skew_join(keyed, firsts, ["key", "none", "md5"], "left").select(
        "conv_id", "turn", "role", "text", "alive", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("double"), "place")
    parts = marked.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(_summarise, _PART)
    merged = stage(parts.groupBy("conv_id").applyInArrow(_merge, RESULT), "merged")
    feed = merged.select("conv_id", F.lit(-1).cast("bigint").alias("place"), "audit", F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text")).unionByName(
        placed.where("alive").select("conv_id", "place", F.lit(None).cast("string").alias("audit"), "role", "text"))
    hashed = feed.repartition("conv_id").sortWithinPartitions("conv_id", "place").select(
        "conv_id", "audit", "role", "text").mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    return merged.drop("repaired_sha256").join(hashed.withColumnRenamed("conv_id", "same"),
                                               F.col("conv_id").eqNullSafe(F.col("same"))).drop("same")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations`` (conv_id, turn, role, text; other columns are not read): ``gaps``,
    ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` after damage.

    Repeated rows are duplicates of the first; no rows give no conversations; a conversation whose rows all went has
    zeros, an empty audit and the digest of the empty string.
    """
    rows = damaged(conversations).withColumns({
        "md5": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))),
        # rows alike in all else may still be too many for one partition
        "tie": F.monotonically_increasing_id()})
    order = ("conv_id", "turn", "role", "md5", "tie")
    judged = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "alive")
                   .mapInArrow(_judge, f"{RESULT}, edge boolean"), "judged")
    # at most two stretches of a partition touch its ends, so this list is no longer than the partitions are many
    split = judged.where("edge").groupBy(F.coalesce("conv_id", F.lit(0)).alias("key"), F.col("conv_id").isNull().alias("none")).count().where(
        "count > 1").drop("count")
    if split.isEmpty():
        return judged.drop("edge")
    split = F.broadcast(stage(split, "split"))
    alike = lambda df: (F.coalesce(df["conv_id"], F.lit(0)) == split["key"]) & (df["conv_id"].isNull() == split["none"])
    whole = judged.join(split, alike(judged), "left_anti").drop("edge")
    return whole.unionByName(_parse_long(rows.join(split, alike(rows), "left_semi")))
