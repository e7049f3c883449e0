"""SQL (DuckDB) of the queries that it can express over whole tables in reasonable time."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first, array_to_string(list_transform(string_split(sha1(h), ''), lambda x: lpad(bin(('0x' || x)::INT), 4, '0')), '') AS bits FROM p GROUP BY h)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform([0, 1, 2, 3, 4], lambda k: CASE WHEN substr(bits, (i * 5 + k + 1)::INT, 1) = '1' THEN 2 ** (4 - k) ELSE 0 END)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN g USING (h)
"""

OP2_SQL = rf"""
WITH w AS (SELECT doc_id, COALESCE({_WORDS}, []) AS ws FROM documents),
n AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i : i + 34], ' ')) END AS h FROM n),
c AS (SELECT h FROM h WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
d AS (SELECT h.doc_id, i, word, max(CASE WHEN c.h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h LEFT JOIN c ON h.h = c.h),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM d GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, COALESCE(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, COALESCE(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
