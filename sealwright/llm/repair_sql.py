"""The SQL twin of conversation repair: the same rule walked row by row from state to state instead of by spans."""

# CRC-32 of an ASCII text, eight shifts for each byte
_CRC = """(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}, ''), lambda c: ascii(c)::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))) )"""

_MOVES = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (3, "u", 2), (2, "a", 3)]


def _steps() -> str:
    """(p, initial, letters, put, q, cost) of every edit after up to two insertions, as SQL values. ``put`` names the
    inserted roles; initial '*' fits any row."""
    inserts = [(p, "", "", p, 0) for p in range(4)]
    for p, text, put, q, cost in list(inserts):
        for _ in range(2):
            a, name = next((b, n) for x, n, b in _MOVES if x == q and n in "ua")
            text, put, q, cost = text + "I", put + name, a, cost + 2
            inserts.append((p, text, put, q, cost))
    steps = []
    for p, text, put, q, cost in inserts:
        steps.append((p, "*", text + "D", put, "", q, cost + 3))
        steps += [(p, name, text + "K", put, "", b, cost) for a, name, b in _MOVES if a == q]
        steps += [(p, "*", text + "R", put, {"u": "user", "a": "assistant"}[name], b, cost + 2)
                  for a, name, b in _MOVES if a == q and name in "ua"]
    return ", ".join(f"({p}, '{i}', '{t}', '{put}', '{role}', {q}, {c})" for p, i, t, put, role, q, c in steps)


REPAIR_SQL = f"""
WITH RECURSIVE
filled AS (SELECT conv_id, turn, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
fated AS (SELECT *, xor({_CRC.format(x='k')}, 4294967295) % 20 AS fate FROM filled),
hit AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
        md5(length(role)::varchar || ':' || role || text)) AS i,
    substr(role, 1, 1) AS initial,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM hit),
judged AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS doubled,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
r AS (SELECT *, NOT blank AND NOT doubled AND ending NOT IN ('.', '!', '?') AS cut FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE doubled) AS duplicate,
    count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS n FROM r GROUP BY conv_id),
steps(p, initial, letters, put, role, q, cost) AS (VALUES {_steps()}),
walk(conv_id, i, state, cost, audit, lines) AS (
    SELECT conv_id, 0::bigint, 0, 0::bigint, '', []::varchar[] FROM (SELECT DISTINCT conv_id FROM r)
    UNION ALL
    SELECT conv_id, i, state, cost, audit, lines FROM (
        SELECT w.conv_id, w.i + 1 AS i, s.q AS state,
            w.cost + s.cost + CASE WHEN r.cut AND right(s.letters, 1) <> 'D' THEN 1 ELSE 0 END AS cost,
            w.audit || s.letters AS audit,
            list_concat(w.lines, list_transform(list_filter(string_split(s.put, ''), lambda x: x <> ''), lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END),
                CASE right(s.letters, 1) WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [s.role || ':' || r.text] END) AS lines,
            row_number() OVER (PARTITION BY w.conv_id, s.q ORDER BY w.cost + s.cost
                + CASE WHEN r.cut AND right(s.letters, 1) <> 'D' THEN 1 ELSE 0 END, w.audit || s.letters) AS best
        FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
        JOIN steps s ON s.p = w.state AND s.initial IN ('*', r.initial)
            AND (right(s.letters, 1) = 'D' OR NOT (r.blank OR r.doubled))) WHERE best = 1),
ended AS (SELECT w.conv_id, w.cost + e.cost AS cost, w.audit || e.letters AS audit, list_concat(w.lines, e.lines) AS lines,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.cost, w.audit || e.letters) AS best
    FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n
    JOIN (VALUES (0, 0, '', []::varchar[]), (3, 0, '', []), (2, 2, 'I', ['assistant:']), (1, 4, 'II', ['user:', 'assistant:']))
        e(state, cost, letters, lines) ON e.state = w.state)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
    coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost,
    coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.best = 1
"""
