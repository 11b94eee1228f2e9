"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
     l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line,
                  unnest(range(len(string_split(body, chr(10))))) AS pos FROM d),
     k AS (SELECT doc_id, pos, line,
                  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
     m AS (SELECT k.*, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages),
     v AS (SELECT *, [CAST('0x' || substr(hexed, 1 + 5 * g, 5) AS INT) FOR g IN range(8)] AS vs,
                  min(page_id) OVER (PARTITION BY hexed) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((vs[CAST((i - i % 4) / 4 AS INT) + 1] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1) FOR i IN range(32)],
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""

OP3 = """
WITH RECURSIVE v AS (
       SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
           WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98e0),
     r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
     c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, vec_id = c.m AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


OP12 = """
WITH RECURSIVE t AS (
       SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
       FROM conversations WHERE conv_id IS NOT NULL),
     s AS (SELECT c, count(*) AS k, CAST(c AS VARCHAR) AS digits FROM t GROUP BY c),
     x(c, digits, i, r) AS (
       SELECT c, digits, 1, CAST(4294967295 AS BIGINT) FROM s
       UNION ALL
       SELECT c, digits, i + 1, list_reduce([xor(r, CAST(ascii(substr(digits, i, 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)
       FROM x WHERE i <= length(digits)),
     h AS (SELECT x.c, xor(r, CAST(4294967295 AS BIGINT)) % 9 AS h, x.c - x.c % 5 AS base FROM x WHERE i > length(digits)),
     g AS (SELECT h.c, h.h, h.base, least(h.h, coalesce(s.k, 0)) AS taken FROM h LEFT JOIN s ON s.c = h.base),
     w AS (SELECT g.c, t.pos, t.role, t.body FROM g JOIN t ON t.c = g.base WHERE t.pos < g.h
           UNION ALL
           SELECT g.c, t.pos - g.h + g.taken, t.role, t.body FROM g JOIN t ON t.c = g.c WHERE t.pos >= g.h),
     p AS (SELECT c, pos + 1 AS d, octet_length(encode(body)) AS b,
                  string_agg(md5(role) || md5(body), '') OVER (PARTITION BY c ORDER BY pos) AS path FROM w
           UNION ALL SELECT c, 0, 0, '' FROM s),
     n AS (SELECT d, path, min(c) AS m, count(*) AS n, any_value(b) AS b FROM p GROUP BY d, path),
     e AS (SELECT c, max(d) AS last FROM p GROUP BY c),
     f AS (SELECT p.path, p.d, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids
           FROM p JOIN e ON e.c = p.c AND e.last = p.d GROUP BY p.path, p.d),
     k AS (SELECT substr(path, 1, 64 * (d - 1)) AS path, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
     v AS (SELECT n.*, coalesce(k.kids, 0) AS kids FROM n LEFT JOIN k ON k.path = n.path),
     u AS (SELECT p.path, count(*) FILTER (v.kids = 0) AS leaves, sum((v.n - 1) * v.b) AS saved
           FROM p JOIN v ON v.m = p.c AND v.d >= p.d GROUP BY p.path)
SELECT v.m AS conv_id, v.d AS depth, a.m AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, u.leaves AS n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM v JOIN u ON u.path = v.path LEFT JOIN f ON f.path = v.path
LEFT JOIN n a ON v.d > 0 AND a.path = substr(v.path, 1, 64 * (v.d - 1))
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embeddings": OP3, "op5_line_dedup": OP5, "op9_warc": OP9, "op12_prefix_trie": OP12}
