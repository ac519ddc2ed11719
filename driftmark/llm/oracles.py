"""SQL for the registered queries whose SQL is put together from repeated pieces."""

from __future__ import annotations

#: crc32 of a short decimal string, by bytes: the table row of a byte comes from eight shifts of the reversed polynomial.
_CRC_TABLE = "(SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) FROM range(256) t(b))"
_CRC32 = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"

CONVERSATION_TRIE = f"""
    WITH table_of AS (SELECT {_CRC_TABLE} AS crc),
    placed AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    ids AS (SELECT conv_id, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM placed), table_of),
    rebuilt AS (
        SELECT i.conv_id, 0 AS part, p.pos, p.role, p.text FROM ids i JOIN placed p ON p.conv_id = i.conv_id - i.conv_id % 5 AND p.pos <= i.h
        UNION ALL
        SELECT i.conv_id, 1, p.pos, p.role, p.text FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND p.pos > i.h
    ),
    paths AS (
        SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS n_bytes,
            string_agg(strlen(role)::VARCHAR || ':' || strlen(text)::VARCHAR || ':' || role || text, '') OVER w AS path
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
        UNION ALL
        SELECT conv_id, 0, 0, '' FROM ids
    ),
    steps AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(n_bytes) AS n_bytes,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM steps GROUP BY path, depth
    ),
    counted AS (
        SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
        FROM nodes n LEFT JOIN nodes p ON p.path = n.parent AND p.depth = n.depth - 1
        LEFT JOIN (SELECT parent, depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent, depth) c ON c.parent = n.path AND c.depth = n.depth + 1
    ),
    below AS (
        SELECT a.path, a.depth, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * c.n_bytes) AS saved_tokens
        FROM counted c JOIN paths a ON a.conv_id = c.conv_id AND a.depth <= c.depth GROUP BY a.path, a.depth
    )
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
    FROM counted JOIN below USING (path, depth)
"""


def part_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Codes of embeddings: rounds of assigning distinct parts to entries and moving the entries."""

    def assigned(i: int) -> str:
        distance = "list_inner_product(d.part, d.part) - 2 * list_inner_product(d.part, b.part) + list_inner_product(b.part, b.part)"
        return f"""assigned_{i} AS MATERIALIZED (
            SELECT pos, part, any_value(n) AS n, min((distance, entry)) AS best
            FROM (SELECT d.pos, d.part, d.n, b.entry, {distance} AS distance FROM distinct_parts d JOIN book_{i} b USING (pos))
            GROUP BY pos, part
        )"""

    def moved(i: int) -> str:
        return f"""book_{i + 1} AS MATERIALIZED (
            SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part
            FROM book_{i} b LEFT JOIN (
                SELECT pos, entry, list(floor(total / n) ORDER BY place) AS part
                FROM (
                    SELECT pos, best[2] AS entry, place, sum(n * part[place]) AS total, sum(n) AS n
                    FROM (SELECT *, unnest(range(1, len(part) + 1)) AS place FROM assigned_{i}) GROUP BY pos, entry, place
                ) GROUP BY pos, entry
            ) m USING (pos, entry)
        )"""

    steps = ", ".join(x for i in range(rounds) for x in (assigned(i), moved(i)))
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS ints
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    each AS (
        SELECT vec_id, label, pos, ints[pos * len(ints) // {parts} + 1 : (pos + 1) * len(ints) // {parts}] AS part
        FROM (SELECT *, unnest(range({parts})) AS pos FROM kept)
    ),
    distinct_parts AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM each GROUP BY pos, part),
    book_0 AS MATERIALIZED (
        SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part
        FROM each WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
    ),
    {steps}, {assigned(rounds)},
    codes AS (
        SELECT vec_id, label, string_agg(lower(printf('%02x', best[2])), '' ORDER BY pos) AS code, sum(best[1])::BIGINT AS error
        FROM each JOIN assigned_{rounds} USING (pos, part) GROUP BY vec_id, label
    )
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(list_transform(part, lambda x: x::BIGINT), ','), ',' ORDER BY pos, entry)) FROM book_{rounds}) AS codebooks_sha256
    FROM codes
    """
