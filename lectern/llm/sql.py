"""DuckDB SQL for the queries that SQL expresses over whole tables."""

from __future__ import annotations

_OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1 AS place FROM sources),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, (3 * source_size)::DOUBLE AS cap FROM ranked),
ratios AS (SELECT *, cap / weight AS ratio FROM weighed),
filled AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0.0) AS remaining,
         ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS shares
  FROM ratios WINDOW before AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, ratio < remaining / shares AS capped FROM filled),
level AS (SELECT arg_min(remaining / shares, (ratio, place)) AS level FROM levels WHERE NOT capped),
shared AS (SELECT source, source_size, place, CASE WHEN capped THEN cap ELSE weight * (SELECT level FROM level) END AS target FROM levels),
placed AS (
  SELECT s.*, source_size, target, place, sum(size) OVER (PARTITION BY place ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
  FROM sized s JOIN shared h ON s.source IS NOT DISTINCT FROM h.source),
copies AS (
  SELECT doc_id, ord, place, size, (e * source_size + ends)::BIGINT AS fin, (e * source_size + ends)::DOUBLE / target AS vft
  FROM placed, range(3) r(e) WHERE size > 0 AND target > 0),
summed AS (SELECT *, sum(size) OVER (ORDER BY vft, place, ord, fin ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY vft, place, ord, fin) AS no FROM copies),
taken AS (SELECT doc_id, ord, place, count(*) AS n, min(no)::BIGINT AS position FROM summed WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(t.n, 0))::BIGINT AS taken, t.position
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id
"""

_OP10 = r"""
WITH parsed AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fitting AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS no
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fitting f ON p.page_id = f.page_id AND f.no = 1
"""

_OP1 = r"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) || '00' AS h FROM pages),
spelt AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, ((i * 5) // 8 * 2 + 1)::INT, 4))::BIGINT >> (11 - (i * 5) % 8)) & 31)::INT), 1)), '') AS digest FROM hashed),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM spelt)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM grouped
"""

# All pairs, which SQL can afford at the small scales that it is run at.
_OP3 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(low, m.vec_id)) AS component_id, m.vec_id = least(m.vec_id, coalesce(low, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN counted c ON c.a = m.vec_id LEFT JOIN lowest l ON l.a = m.vec_id
"""

_OP4 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# Every string of 100 bytes, as 200 digits, against all others; the first by document and start stays.
_OP2 = r"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
strings AS (SELECT doc_id, s, substr(x, (2 * s + 1)::BIGINT, 200) AS w FROM (SELECT doc_id, x, unnest(range(n - 99)) AS s FROM raw WHERE n >= 100)),
numbered AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS no FROM strings),
again AS (SELECT doc_id, s, s - 100 > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) AS opens FROM numbered WHERE no > 1),
islands AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM again),
spans AS (SELECT doc_id, island, min(s) AS a, max(s) + 100 AS b FROM islands GROUP BY ALL),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM spans),
summed AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, max(b) AS last FROM spans GROUP BY doc_id),
before AS (SELECT g.doc_id, string_agg(substr(x, (2 * upto + 1)::BIGINT, (2 * (a - upto))::BIGINT), '' ORDER BY a) AS kept FROM gaps g JOIN raw r ON g.doc_id = r.doc_id GROUP BY g.doc_id)
SELECT r.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(from_hex(coalesce(kept, '') || substr(x, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM raw r LEFT JOIN summed s ON r.doc_id = s.doc_id LEFT JOIN before b ON r.doc_id = b.doc_id
"""

# All pairs that share a shingle, on full sets.
_OP7 = r"""
WITH RECURSIVE spelt AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM spelt),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, list(doc_id) AS ids, len(any_value(s))::BIGINT AS n FROM sets GROUP BY list_sort(s)),
items AS (SELECT rep, n, md5_number(unnest(s)) AS g FROM classes WHERE n > 0),
both_ AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ WHERE 100 * k >= 85 * (na + nb - k) UNION ALL SELECT b, a FROM both_ WHERE 100 * k >= 85 * (na + nb - k)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
placed AS (SELECT unnest(ids) AS doc_id, n, least(rep, coalesce(low, rep)) AS component FROM classes LEFT JOIN lowest ON a = rep)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component END AS component_id, doc_id = CASE WHEN n = 0 THEN doc_id ELSE component END AS kept FROM placed
"""

SQL: dict[str, str] = {"op2_suffix_array": _OP2, "op7_minhash": _OP7, "op1_warc": _OP1, "op3_covertree": _OP3, "op4_top_k": _OP4, "op8_mixing": _OP8, "op10_url_filters": _OP10}
