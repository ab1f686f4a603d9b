"""Conversation repair against all edit scripts, a walk by states, and planted odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sealwright.llm import repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _damage(rows):
    """(conv, turn, role, text) after damage, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        role, text = say(role), say(text)
        fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out, {r[0] for r in rows}


def _in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2],
                                       hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))


def _flags(rows):
    """(refused, cut) of each row and the counts."""
    seen, flags, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        words = text.strip(SPACE)
        kind = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        flags.append((kind in (0, 1), kind == 2))
    return flags, counts


def _walk(rows, flags):
    """Least (cost, audit, lines) by walking row by row with all insertions of up to two rows."""
    def puts(states):
        for gap in range(3):
            for names in itertools.product(("user", "assistant"), repeat=gap):
                for written, best in states:
                    yield written + names, best

    def ok(initials):
        return re.fullmatch("s?(ua)*u?", initials) is not None

    states = {"": (0, "", ())}

    def closed(states):
        out = dict(states)
        for name, (cost, audit, lines) in states.items():
            for names in ("u", "a", "ua", "au"):
                if ok(name + names):
                    way = (cost + 2 * len(names), audit + "I" * len(names),
                           lines + tuple({"u": "user:", "a": "assistant:"}[x] for x in names))
                    key = _short(name + names)
                    if key not in out or way[:2] < out[key][:2]:
                        out[key] = way
        return out

    def _short(name):
        # what may follow depends on the last initial, and on whether anything was put out
        return name if len(name) < 2 else name[-1] if name[-1] != "a" else "ua"

    for (_, _, role, text), (refused, cut) in zip(rows, flags):
        nexts = {}
        for name, (cost, audit, lines) in closed(states).items():
            offers = [(name, cost + 3, audit + "D", lines)]
            if not refused:
                offers.append((name + role[:1] if role[:1] in ("s", "u", "a") else "x", cost + cut, audit + "K", lines + (f"{role}:{text}",)))
                offers += [(name + new[0], cost + 2 + cut, audit + "R", lines + (f"{new}:{text}",)) for new in ("user", "assistant")]
            for new, *way in offers:
                if ok(new):
                    key = _short(new)
                    if key not in nexts or tuple(way[:2]) < nexts[key][:2]:
                        nexts[key] = tuple(way)
        states = nexts
    return min((v for k, v in closed(states).items() if re.fullmatch("(s?(ua)+)?", k)), key=lambda v: v[:2])


def _expected(rows):
    damaged, convs = _damage(rows)
    out = {}
    for conv in convs:
        mine = _in_order([r for r in damaged if r[0] == conv])
        flags, (blank, double, cut) = _flags(mine)
        cost, audit, lines = _walk(mine, flags)
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, double, cut, illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _exhaustive(initials, flags):
    """Least (cost, audit) over every edit script with at most two insertions in a gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    for between in itertools.product(gaps, repeat=len(initials) + 1):
        for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(initials)):
            if any(e != "D" and f[0] for e, f in zip(edits, flags)):
                continue
            made, audit, cost = between[0], "I" * len(between[0]), 2 * len(between[0])
            for e, i, f, gap in zip(edits, initials, flags, between[1:]):
                made += {"K": i or "x", "D": ""}.get(e, e[-1]) + gap
                audit += e[0] + "I" * len(gap)
                cost += {"K": 0, "D": 3}.get(e, 2) + (f[1] and e != "D") + 2 * len(gap)
            if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cells_against_all_scripts():
    kinds = [("s", False, False), ("u", False, True), ("a", False, False), ("", True, False), ("u", True, False), ("x", False, True)]
    for n in (0, 1, 2, 3):
        for rows in itertools.product(kinds, repeat=n):
            cell = repair.span_cell(bytes(repair.kind_of(i, d, c) for i, d, c in rows))
            assert repair.verdict(cell) == _exhaustive([r[0] for r in rows], [r[1:] for r in rows]), rows


def test_any_split_gives_the_same_cell():
    rng = random.Random(5)
    for _ in range(60):
        kinds = bytes(rng.randrange(16) for _ in range(rng.randrange(2, 12)))
        whole = repair.span_cell(kinds)
        for cut in range(1, len(kinds)):
            assert repair.joined(repair.span_cell(kinds[:cut]), repair.span_cell(kinds[cut:])) == whole


def _check(spark, rows):
    found = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in found}
    assert len(got) == len(found)
    assert got == _expected(rows)
    return got


def _random_rows(rng, convs, n):
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "unknown"]
    texts = ["Hello.", "Hello", " ", "", None, "Why? ", "so ", "end!\n", "中文。", "x" * 3000 + ".", "Hello."]
    return [(rng.choice(convs), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_random_rows(spark):
    rng = random.Random(1)
    _check(spark, _random_rows(rng, [None, *range(40)], 400) + [(1000 + k, 0, "user", "Hi.") for k in range(60)])


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"Line {t}.", f"Cut {t}", ""])) for t in range(900)]
        rows += [(None, None, None, None)] * 300 + _random_rows(rng, [1, 2, 3], 30)
        got = _check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got[7][6]) > 800


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(empty).collect() == []
    extra = spark.createDataFrame([(1, 0, "user", "Hi.", "k", 1)], SCHEMA + ", place string, alive int")
    assert repair.repair_conversations(extra).count() == 1


def test_all_rows_dropped(spark):
    gone = next((c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = repair.repair_conversations(spark.createDataFrame([(*gone, "user", "Hi.")], SCHEMA)).collect()[0]
    assert row["audit"] == "" and row["cost"] == 0 and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("audit,lines", [("KI", ["user:Hi.", "assistant:"]), ("RK", ["user:Hi.", "assistant:Yo."]), ("DII", ["user:", "assistant:"])])
def test_digest_follows_the_audit(audit, lines):
    out = repair.Repaired(audit)
    rows = [("user", "Hi."), ("assistant", "Yo.")]
    for role, text in rows[:sum(x != "I" for x in audit)]:
        out.row(role, text)
    assert out.hexdigest() == hashlib.sha256("\n".join(lines).encode()).hexdigest()
