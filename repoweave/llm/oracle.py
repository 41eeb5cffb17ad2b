"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_OP2 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s
  FROM words WHERE len(w) > 0),
distinct_sets AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets GROUP BY list_sort(s)),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS x FROM distinct_sets),
links AS (
  SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.id <> b.id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM distinct_sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
member AS (SELECT s.doc_id, len(s.s) AS n, l.component_id FROM sets s JOIN distinct_sets d ON list_sort(s.s) = d.s JOIN least_of l ON l.a = d.id)
SELECT w.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN member m USING (doc_id)
"""

_OP9 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
words AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows)),
found AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN windows x ON x.n = p.n AND x.p = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_OP6 = r"""
WITH parsed AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(said, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(said, length(h || p)) AS ruling
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
ruled AS (
  SELECT parsed.*, rule, ruling, substr(md5(url), 1, 1) IN ('0', '1', '2') AS held,
    regexp_replace(translate(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '123456789', '000000000'), '(?s)[^a-z0/.-]', '_', 'g') || '^' AS plain
  FROM parsed LEFT JOIN fits USING (r)),
chars AS (SELECT r, ruling, held, i, instr('abcdefghijklmnopqrstuvwxyz0/.-_^', substr(plain, i, 1)) - 1 AS c
  FROM (SELECT r, ruling, held, plain, unnest(range(1, length(plain) + 1)) AS i FROM ruled)),
fours AS (SELECT r, ruling, held, coalesce(lag(c, 3) OVER w, 31) AS o, coalesce(lag(c, 2) OVER w, 31) AS p, coalesce(lag(c, 1) OVER w, 31) AS q, c FROM chars WINDOW w AS (PARTITION BY r ORDER BY i)),
seen AS (SELECT o, p, q, c, count(*) FILTER (ruling = 'allow') AS a, count(*) FILTER (ruling = 'block') AS b FROM fours WHERE ruling IS NOT NULL AND NOT held GROUP BY ALL),
both_ AS (SELECT coalesce(sum(a), 0) > 0 AND coalesce(sum(b), 0) > 0 AS trained FROM seen),
cells AS (SELECT o.i AS o, p.i AS p, q.i AS q, c.i AS c FROM range(32) o(i), range(32) p(i), range(32) q(i), range(32) c(i)),
counted AS (SELECT o, p, q, c, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM cells LEFT JOIN seen USING (o, p, q, c)),
sums AS (SELECT *,
  sum(a) OVER () AS a_all, sum(a) OVER (PARTITION BY c) AS a_c, sum(a) OVER (PARTITION BY q, c) AS a_qc, sum(a) OVER (PARTITION BY p, q, c) AS a_pqc,
  sum(a) OVER (PARTITION BY q) AS a_q, sum(a) OVER (PARTITION BY p, q) AS a_pq, sum(a) OVER (PARTITION BY o, p, q) AS a_opq,
  sum(b) OVER () AS b_all, sum(b) OVER (PARTITION BY c) AS b_c, sum(b) OVER (PARTITION BY q, c) AS b_qc, sum(b) OVER (PARTITION BY p, q, c) AS b_pqc,
  sum(b) OVER (PARTITION BY q) AS b_q, sum(b) OVER (PARTITION BY p, q) AS b_pq, sum(b) OVER (PARTITION BY o, p, q) AS b_opq FROM counted),
p0 AS (SELECT *, (a_c + 0.125e0) / (a_all + 4e0) AS a0, (b_c + 0.125e0) / (b_all + 4e0) AS b0 FROM sums),
p1 AS (SELECT *, CASE WHEN a_q + b_q >= 8 THEN (a_qc + 4e0 * a0) / (a_q + 4e0) ELSE a0 END AS a1, CASE WHEN a_q + b_q >= 8 THEN (b_qc + 4e0 * b0) / (b_q + 4e0) ELSE b0 END AS b1 FROM p0),
p2 AS (SELECT *, CASE WHEN a_pq + b_pq >= 8 THEN (a_pqc + 4e0 * a1) / (a_pq + 4e0) ELSE a1 END AS a2, CASE WHEN a_pq + b_pq >= 8 THEN (b_pqc + 4e0 * b1) / (b_pq + 4e0) ELSE b1 END AS b2 FROM p1),
p3 AS (SELECT *, CASE WHEN a_opq + b_opq >= 8 THEN (a + 4e0 * a2) / (a_opq + 4e0) ELSE a2 END AS a3, CASE WHEN a_opq + b_opq >= 8 THEN (b + 4e0 * b2) / (b_opq + 4e0) ELSE b2 END AS b3 FROM p2),
model AS (SELECT o, p, q, c, round((ln(a3) - ln(b3)) * 1000000)::BIGINT AS ratio FROM p3),
scored AS (SELECT r, any_value(ruling) AS ruling, any_value(held) AS held, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM fours JOIN model USING (o, p, q, c) GROUP BY r),
stepped AS (SELECT *, greatest(-1000, least(1000, floor(score / 10000.0)::BIGINT)) AS step FROM scored),
steps AS (SELECT step, count(*) FILTER (ruling = 'allow') AS a, count(*) FILTER (ruling = 'block') AS b FROM stepped WHERE ruling IS NOT NULL AND held GROUP BY step),
good AS (SELECT step, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b,
  (all_a - coalesce(sum(a) OVER w, 0)) * all_b + coalesce(sum(b) OVER w, 0) * all_a AS good
  FROM steps WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
least_step AS (SELECT (SELECT step FROM good WHERE all_a > 0 AND all_b > 0 ORDER BY good DESC, abs(step), step LIMIT 1) AS t)
SELECT page_id, host, path, rule, coalesce(ruled.ruling, CASE WHEN NOT trained OR step >= coalesce(t, 0) THEN 'allow' ELSE 'block' END) AS verdict, score
FROM ruled JOIN stepped USING (r), least_step, both_
"""


_OP7 = """
WITH sizes AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
levels AS (SELECT DISTINCT h, depth, h >> (60 - depth) AS bucket FROM sizes, (SELECT unnest(range(0, 61))::INT AS depth)),
buckets AS (
  SELECT depth, h >> (60 - depth) AS bucket, sum(n_bytes)::BIGINT AS shard_bytes FROM sizes, (SELECT unnest(range(0, 61))::INT AS depth)
  GROUP BY ALL HAVING sum(n_bytes) <= 1048576 OR min(h) = max(h)),
fit AS (SELECT h, min(depth) AS depth FROM levels JOIN buckets USING (depth, bucket) GROUP BY h)
SELECT doc_id, n_bytes, fit.depth::BIGINT AS depth, substr(lpad(bin(h), 60, '0'), 1, fit.depth) AS shard, shard_bytes, shard_bytes <= 1048576 AS fits,
  max(fit.depth) OVER ()::BIGINT AS global_depth, h >> (60 - max(fit.depth) OVER ()) AS entry
FROM sizes JOIN fit USING (h) JOIN buckets ON buckets.depth = fit.depth AND buckets.bucket = h >> (60 - fit.depth)
"""


_OP12 = r"""
WITH ids AS (
  SELECT conv_id, (4294967295 - list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: i::UBIGINT)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (
  SELECT conv_id, list_concat(CASE WHEN h = 0 OR b.t IS NULL THEN [] ELSE list_slice(b.t, 1, h::BIGINT) END, list_slice(own.t, h::BIGINT + 1, len(own.t))) AS t
  FROM own JOIN ids USING (conv_id) LEFT JOIN (SELECT conv_id AS base, t FROM own) b ON b.base = conv_id - conv_id % 20),
prefixes AS (SELECT conv_id, len(t) AS n, d, list_slice(t, 1, d) AS p FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM built)),
made AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY p, d),
children AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM made WHERE d > 0 GROUP BY ALL),
tops AS (SELECT made.*, coalesce(c.n, 0) AS n_children FROM made LEFT JOIN children c ON c.p = made.p),
up AS (SELECT list_slice(p, 1, a) AS p, n_children = 0 AS leaf, saved FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS a FROM tops)),
under AS (SELECT p, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM up GROUP BY p)
SELECT t.conv_id, t.d::BIGINT AS depth, q.conv_id AS parent_conv_id, t.n_convs, t.n_children, u.n_leaves, u.saved::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM tops t JOIN under u ON u.p = t.p LEFT JOIN made q ON t.d > 0 AND q.p = list_slice(t.p, 1, t.d - 1)
"""

_OP13 = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word,
    unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 19 <= len(w) THEN array_to_string(list_slice(w, i, i + 19), ' ') END)) AS win FROM split),
repeats AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM places),
covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM repeats),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS words FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)
"""

def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": _OP2, "op6_url_filter": _OP6, "op7_sharding": _OP7, "op9_benchmark_decontamination": _OP9, "op12_conversation_trie": _OP12, "op13_substring_dedup": _OP13}
