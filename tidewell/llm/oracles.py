"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_W = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source, text IS NULL AS none FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_W}') AS ws FROM d),
win AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest([0, 1, 2]) AS t(k) GROUP BY r),
line AS (SELECT r, j, string_split(text, chr(10))[j] AS line FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(j)),
norm AS (SELECT r, j, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS n FROM line),
texts AS (SELECT source, count(DISTINCT text) AS host_docs FROM d WHERE NOT none GROUP BY source),
freq AS (SELECT d.source, n, count(DISTINCT text) AS docs FROM norm JOIN d USING (r) WHERE n <> '' GROUP BY d.source, n),
over AS (SELECT f.source, f.n FROM freq f JOIN texts t ON f.source IS NOT DISTINCT FROM t.source
         WHERE f.docs > 10 AND f.docs > 0.1 * t.host_docs),
kept_words AS (SELECT x.r, sum(len(regexp_extract_all(x.line, '{_W}'))) AS n FROM norm x JOIN d USING (r)
               WHERE NOT EXISTS (SELECT 1 FROM over o WHERE o.source IS NOT DISTINCT FROM d.source AND o.n = x.n) GROUP BY x.r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM norm WHERE n <> '' GROUP BY r),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             coalesce(kept_words.n, 0)::BIGINT AS left_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN kept_words USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND left_words >= 50 AND 100 * left_words >= 30 * n_words AS kept FROM f
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
c AS (SELECT *, [3, 1, 2][(k - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
o AS (SELECT *, row_number() OVER u AS pos,
             (total - coalesce(sum(cap) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM c WINDOW u AS (ORDER BY cap / w, k)),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM o WHERE level <= cap / w ORDER BY pos LIMIT 1)) AS target FROM o),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
             ('0x' || substr(md5('7 ' || coalesce(d.doc_id::VARCHAR, 'text ' || md5(d.text), 'none')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM p
"""

OP6 = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u,
                  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
site(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
pat(pos, pattern) AS (VALUES (0, '^[a-z]+://([^/?#]*\.)?spam-farm\.'), (1, '://[^/?#]*\bcasino\b'), (2, '[?&]utm_source=feed(&|#|$)'),
    (3, '/ads?/banner\b'), (4, '://[^/?#]*\bbuy-(pills|followers)\b'), (5, '/(trackback|xmlrpc)\.php(\?|#|$)'),
    (6, '[?&]sessionid=[0-9a-f]{16,}'), (7, '/free-download/.*\.exe(\?|#|$)')),
j AS (SELECT *, (SELECT h || s.p FROM site s WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, s.p) ORDER BY len(h || s.p) DESC LIMIT 1) AS rule,
             (SELECT pattern FROM pat WHERE regexp_matches(u, pattern) ORDER BY pos LIMIT 1) AS hit FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN hit END AS pattern,
       CASE WHEN rule IS NOT NULL THEN (SELECT verdict FROM site s WHERE h || s.p = rule) WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM j
"""

OP12 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES = {"op1_line_quality": OP1, "op5_mixing": OP5, "op6_url_rules": OP6, "op12_chunk_recipes": OP12}
