"""The SQL twin of the personal-data query."""

from __future__ import annotations

from .pii import CONTEXT, KINDS, NEAR, THRESHOLD, iban_pattern

#: The same spans in plain form; DuckDB's engine needs no possessive quantifiers.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
DIGITS = "regexp_replace(match, '[^0-9]', '', 'g')"
HOLDS = {
    "email": "true",
    "ip": "list_bool_and([length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(p, '0')[:3] AS INT), 0) <= 255"
    " FOR p IN string_split(match, '.')])",
    "card": f"length({DIGITS}) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN reverse({DIGITS})[i]::INT"
    f" ELSE (reverse({DIGITS})[i]::INT * 2) // 10 + (reverse({DIGITS})[i]::INT * 2) % 10 END"
    f" FOR i IN range(1, length({DIGITS}) + 1)]) % 10 = 0",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
    "iban": "list_reduce(list_prepend(0, [CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    " FOR c IN string_split(replace(match, ' ', '')[5:] || replace(match, ' ', '')[:4], '')]),"
    " lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
    "ssn": "true",
}


def _kind(rank: int) -> str:
    k = KINDS[rank]
    named = " OR ".join(f"contains(near, '{w}')" for w in k.context)
    return f"""
SELECT rn, {rank} AS rank, '{k.name}' AS kind, stop - length(match) AS start, stop FROM (
  SELECT *, lower(right(gap, {NEAR})) AS near,
    sum(length(gap) + length(match)) OVER (PARTITION BY rn ORDER BY nth) AS stop FROM (
    SELECT rn, unnest(matches) AS match, unnest(gaps[:len(matches)]) AS gap, unnest(range(len(matches))) AS nth FROM (
      SELECT rn, regexp_extract_all(text, '{PLAIN[k.name]}') AS matches,
        string_split_regex(text, '{PLAIN[k.name]}') AS gaps FROM d)))
WHERE {HOLDS[k.name]} AND {k.sure} + CASE WHEN {named} THEN {CONTEXT} ELSE 0.0 END >= {THRESHOLD}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_kind(r) for r in range(len(KINDS)))}),
said AS (SELECT rn,
  {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS[:4])},
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM (SELECT rn, rank, kind, start::BIGINT AS start, stop::BIGINT AS stop FROM found) GROUP BY rn)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS[:4])},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (rn)
"""
