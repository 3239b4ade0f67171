"""SQL (of DuckDB) for the queries that SQL can express."""

#: Words as sets, classes of equal sets by their first occurrence, pairs over rare words first, verified on all words.
LINE_DEDUP = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line FROM cut),
sets AS (SELECT doc_id, i, list_sort(list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> ''))) AS ws FROM lines),
firsts AS (SELECT ws, min({'d': doc_id, 'i': i}) AS first FROM sets WHERE len(ws) >= 5 GROUP BY ws),
classes AS (SELECT ws, first, len(ws) AS n, row_number() OVER (ORDER BY first) AS c FROM firsts),
words AS (SELECT c, n, unnest(ws) AS w FROM classes),
counts AS (SELECT w, count(*) AS f FROM words GROUP BY w),
ranked AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY f, w) AS r FROM words JOIN counts USING (w)),
prefixes AS (SELECT c, n, w FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
met AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefixes a JOIN prefixes b ON a.w = b.w AND a.c < b.c WHERE a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
later AS (SELECT DISTINCT m.b AS c FROM met m JOIN classes x ON x.c = m.a JOIN classes y ON y.c = m.b WHERE len(list_intersect(x.ws, y.ws)) * 9 >= (x.n + y.n) * 4),
judged AS (SELECT s.doc_id, s.i, k.c IS NOT NULL AND (l.c IS NOT NULL OR k.first <> {'d': s.doc_id, 'i': s.i}) AS gone, l.c IS NOT NULL AS linked FROM sets s LEFT JOIN classes k ON k.ws = s.ws LEFT JOIN later l ON l.c = k.c),
told AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (linked) AS n_links, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (gone) AS removed FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_links, 0) AS n_links, coalesce(removed, '') AS removed_lines FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""

#: Leaves by language, parents of two in a recursion, a second tree over the subroots, and every leaf climbing both with the hashes beside its way.
MERKLE = r"""
WITH RECURSIVE
bits(b, i, v) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, i + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
sums(id, i, c) AS (
  SELECT id, 0, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id::VARCHAR AS id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT s.id, s.i + 1, xor(s.c >> 8, k.v) FROM sums s JOIN bits k ON k.i = 8 AND k.b = xor(s.c & 255, ascii(substr(s.id, s.i + 1, 1))) WHERE s.i < length(s.id)),
hit AS (SELECT id FROM sums WHERE i = length(id) AND xor(c, 4294967295) % 7 = 0),
fields AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS h,
  CASE WHEN h.id IS NOT NULL THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM fields f LEFT JOIN hit h ON h.id = f.doc_id::VARCHAR),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang IS NOT NULL, lang::BLOB) - 1 AS g, count(*) OVER () AS gs FROM (SELECT DISTINCT lang FROM documents)),
placed AS (SELECT l.*, g, gs, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves l JOIN langs x ON x.lang IS NOT DISTINCT FROM l.lang),
tree(g, d, i, n, h) AS (SELECT g, 0, i, n, h FROM placed UNION ALL SELECT g, d + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, d, i // 2, n),
top(d, i, n, h) AS (SELECT 0, g, (SELECT count(*) FROM langs), h FROM tree WHERE n = 1 UNION ALL SELECT d + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY d, i // 2, n),
climb(g, k, d, i, n, h, s) AS (
  SELECT g, i, 0, i, n, coalesce(changed, h), '' FROM placed
  UNION ALL SELECT c.g, k, c.d + 1, c.i // 2, (c.n + 1) // 2, sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(t.h, '') || c.h ELSE c.h || coalesce(t.h, '') END), s || coalesce(t.h, '')
  FROM climb c LEFT JOIN tree t ON t.g = c.g AND t.d = c.d AND t.i = xor(c.i, 1) WHERE c.n > 1),
upper_climb(g, k, d, i, n, h, s) AS (
  SELECT c.g, k, 0, c.g, (SELECT count(*) FROM langs), h, s FROM climb c WHERE c.n = 1
  UNION ALL SELECT c.g, k, c.d + 1, c.i // 2, (c.n + 1) // 2, sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(t.h, '') || c.h ELSE c.h || coalesce(t.h, '') END), s || coalesce(t.h, '')
  FROM upper_climb c LEFT JOIN top t ON t.d = c.d AND t.i = xor(c.i, 1) WHERE c.n > 1)
SELECT doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(u.s) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM placed p JOIN tree s ON s.g = p.g AND s.n = 1 JOIN upper_climb u ON u.g = p.g AND u.k = p.i AND u.n = 1 CROSS JOIN (SELECT h FROM top WHERE n = 1) r
"""
