"""Expected results of the queries that SQL can express, as DuckDB SQL over the sample tables."""

from __future__ import annotations

# The checksum of a string of ASCII characters: a table of 256 entries by the rule, then a byte at a time.
CRC_TABLE = """
crc_table AS (
    SELECT list(entry ORDER BY i) AS crc_of
    FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
        FROM range(256) AS r(i)
    )
)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string; ``crc_table`` must be in scope."""
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), {step}), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes of trees: two neighbours become one until a single node remains."""
    return f"""
{name} AS (
    SELECT tree, 0 AS level, pos, digest, n FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
    FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n
)"""


def _walk(name: str, start: str, tree: str) -> str:
    """From leaves up: the digest folded so far, and each level's sibling."""
    return f"""
{name} AS (
    SELECT row, tree, 0 AS level, pos, n, folded, NULL::VARCHAR AS sibling FROM {start}
    UNION ALL
    SELECT w.row, w.tree, w.level + 1, w.pos // 2, (w.n + 1) // 2,
        CASE WHEN s.digest IS NULL THEN sha256(w.folded)
             WHEN w.pos % 2 = 1 THEN sha256(s.digest || w.folded)
             ELSE sha256(w.folded || s.digest) END,
        s.digest
    FROM {name} w LEFT JOIN {tree} s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1)
    WHERE w.n > 1
)"""


OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
read AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
        CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} ELSE {_leaf("n_chars")} END AS claimed
    FROM documents, crc_table
),
leaves AS (
    SELECT *, leaf AS digest, claimed AS folded, count(*) OVER (PARTITION BY tree) AS n,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos
    FROM read
),
{_tree("nodes", "leaves")},
tops AS (
    SELECT '' AS tree, tree AS key, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos
    FROM nodes WHERE n = 1
),
{_tree("top_nodes", "tops")},
{_walk("walk", "leaves", "nodes")},
arrived AS (SELECT w.row, '' AS tree, t.pos, t.n, w.folded FROM walk w JOIN tops t ON t.key = w.tree WHERE w.n = 1),
{_walk("top_walk", "arrived", "top_nodes")},
siblings AS (
    SELECT row, 0 AS part, level, sibling FROM walk
    UNION ALL SELECT row, 1, level, sibling FROM top_walk
),
proofs AS (SELECT row, sha256(coalesce(string_agg(sibling, '' ORDER BY part, level), '')) AS proof FROM siblings GROUP BY row)
SELECT l.doc_id, l.leaf, t.digest AS subroot, r.digest AS root, p.proof AS proof_sha256, w.folded AS folded_root,
    w.folded = r.digest AS verified
FROM leaves l JOIN tops t ON t.key = l.tree JOIN top_walk w ON w.row = l.row AND w.n = 1 JOIN proofs p ON p.row = l.row,
    (SELECT digest FROM top_nodes WHERE n = 1) r
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS words FROM documents),
sizes AS (SELECT row, doc_id, len(words)::BIGINT AS n FROM docs WHERE len(words) > 0),
totals AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS total FROM sizes),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(words) AS term FROM docs) GROUP BY row, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tf, totals GROUP BY term, documents
),
asked AS (
    SELECT item, item_id, term, count(*)::BIGINT AS times
    FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark)
    GROUP BY item, item_id, term
),
scored AS (
    SELECT item, item_id, s.row, s.doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes s USING (row), totals
    GROUP BY item, item_id, s.row, s.doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""

OP13 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
),
placed AS (SELECT row, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
windows AS (
    SELECT row, n, place, word, string_agg(word, ' ') OVER (PARTITION BY row ORDER BY place ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win
    FROM placed
),
counted AS (
    SELECT row, place, word, place <= n - 34 AND count(*) OVER (PARTITION BY win, place <= n - 34) > 1 AS repeated FROM windows
),
marked AS (
    SELECT row, place, word, max(repeated::INT) OVER (PARTITION BY row ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM counted
),
left_over AS (
    SELECT row, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone = 0) AS kept
    FROM marked GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (row)
"""

ORACLE_SQL = {"op11_manifest": OP11, "op12_search": OP12, "op13_windows": OP13}
