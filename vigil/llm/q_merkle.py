"""op12: Merkle manifest of all documents."""

from vigil.llm.common import table
from vigil.llm.merkle import audited
from vigil.llm.registry import query

#: The SQL unrolls so many levels in a source and over the sources (16 ** 6 rows, 16 ** 4 sources).
LEVELS, SOURCE_LEVELS = 6, 4


def _coded(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_coded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, rows: str, group: str, levels: int) -> str:
    """CTEs name0..nameL: one row per node (group, i, m nodes of its level, h); a level leaves a lone node as it is."""
    out = [f"{name}0 AS ({rows})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS (SELECT {group}, i // 16 AS i, (max(m) + 15) // 16 AS m,
  CASE WHEN max(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k} GROUP BY {group}, i // 16)""")
    return ",\n".join(out)


def _proofs(name: str, group: str, levels: int) -> str:
    """CTE name_p: per node of level 0 what stands left and right of its way, level by level."""
    parts = []
    for k in range(levels):
        parts.append(f"""{name}_s{k} AS (SELECT a.{group}, a.i, CASE WHEN max(a.m) = 1 THEN NULL ELSE
  [coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), ''), coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '')] END AS s
  FROM {name}{k} a JOIN {name}{k} b ON a.{group} = b.{group} AND a.i // 16 = b.i // 16 GROUP BY a.{group}, a.i)""")
    joins = " ".join(f"JOIN {name}_s{k} s{k} ON s{k}.{group} = n.{group} AND s{k}.i = n.i // {16 ** k}" for k in range(levels))
    steps = ", ".join(f"s{k}.s" for k in range(levels))
    parts.append(f"{name}_p AS (SELECT n.{group}, n.i, list_filter([{steps}], lambda x: x IS NOT NULL) AS path FROM {name}0 n {joins})")
    return ",\n".join(parts)


#: crc32 over the digits of the id, bit by bit (fixed value: the polynomial).
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ascii(x) AS UBIGINT) FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '') IF x <> '']),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS UBIGINT[])), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, CAST(3988292384 AS UBIGINT)) ELSE r // 2 END)), CAST(4294967295 AS UBIGINT))"""

SQL = f"""
WITH d AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed_text FROM documents),
l AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {_leaf('text')} AS h, {_leaf('changed_text')} AS changed FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM l),
{_levels('a', 'SELECT g, i, m, h FROM r', 'g', LEVELS)},
{_proofs('a', 'g', LEVELS)},
{_levels('b', f"SELECT 0 AS z, g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m, h FROM a{LEVELS}", 'z', SOURCE_LEVELS)},
{_proofs('b', 'z', SOURCE_LEVELS)},
f AS (SELECT r.doc_id, r.h AS leaf, b0.h AS subroot, t.h AS root, list_concat(a_p.path, b_p.path) AS path, r.changed
  FROM r JOIN a_p ON a_p.g = r.g AND a_p.i = r.i JOIN b0 ON b0.g = r.g JOIN b_p ON b_p.i = b0.i CROSS JOIN b{SOURCE_LEVELS} t),
o AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x[1] || x[2] FOR x IN path], '')) AS proof_sha256,
  list_reduce(list_prepend([changed, ''], path), lambda h, x: [sha256(x[1] || h[1] || x[2]), ''])[1] AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM o
"""


@query("op12_merkle", SQL)
def op12_merkle(spark, sf_dir):
    """Leaf, subroot, root and proof digests of every document, and proofs folded from partly changed texts."""
    return audited(table(spark, sf_dir, "documents"))
