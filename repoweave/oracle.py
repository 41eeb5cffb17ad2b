"""DuckDB SQL with the same rows as the queries."""

from __future__ import annotations

_PATH = r"regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)?', 1)"
_PARTS = """parts AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_brand AS language, p_partkey,
  CASE WHEN p_partkey % 5 = 0 THEN 'class' WHEN p_partkey % 17 = 0 THEN 'artifact' ELSE 'function' END AS component_type FROM part)"""
_CALLS = """calls AS (SELECT 'p' || a.l_partkey AS caller, 'p' || b.l_partkey AS callee, b.l_linenumber::BIGINT AS line
  FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber > 1)"""
_POLICY = """policy AS (SELECT count(*) FILTER (component_type = 'class') AS oop, count(*) FILTER (component_type = 'function') AS functions FROM parts),
decided AS (SELECT *, oop = 0 OR (oop < 20 AND functions > oop) OR coalesce(functions > 0 AND oop / (oop + functions) < 0.2, false) AS include_functions FROM policy)"""
_TREE = """tree AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, [r_name] AS path, 1 AS depth FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, [r_name, n_name], 2 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, [r_name, n_name, c_name], 3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_OWNED = """owned AS (
  SELECT DISTINCT l_partkey AS id, m.path AS module, m.depth AS depth FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
  unnest([{'depth': 1, 'path': r_name}, {'depth': 2, 'path': r_name || '/' || n_name}]) AS u(m))"""
_NATION_EDGES = """edges AS (
  SELECT DISTINCT c_nationkey::BIGINT AS caller, arg_max(s_nationkey, (l_extendedprice, s_nationkey))::BIGINT AS callee
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, o_orderpriority)"""
_SNAPSHOTS = """old AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS b, o_custkey AS e FROM orders WHERE o_orderkey % 10 <> 0),
new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority || '+' ELSE o_orderpriority END AS b,
  CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS e FROM orders WHERE o_orderkey % 10 <> 1),
both_ AS (SELECT old.id AS a, new.id AS z, old.s AS s0, new.s AS s1, old.b AS b0, new.b AS b1, old.e AS e0, new.e AS e1 FROM old FULL JOIN new ON old.id = new.id),
changes AS (
  SELECT 'added' AS kind, z AS id FROM both_ WHERE a IS NULL UNION ALL SELECT 'deleted', a FROM both_ WHERE z IS NULL
  UNION ALL SELECT 'modified_interface', a FROM both_ WHERE s0 <> s1 UNION ALL SELECT 'modified_body', a FROM both_ WHERE s0 = s1 AND b0 <> b1
  UNION ALL SELECT 'edge_changes', a FROM both_ WHERE e0 <> e1)"""
_HREF = """unnest(regexp_extract_all(html, '(?i)href=["'']([^"''#]*)', 1))"""
_EXPECTED = """expected AS (SELECT DISTINCT '/' || regexp_extract(html, '<a href="/([^"]*)"', 1) AS page FROM pages)"""
#: documents as pages: what a line becomes by its length
_WIKI = r"""lines AS (
  SELECT doc_id, source, unnest(string_split(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N} \n]', ' ', 'g'), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N} \n]', ' ', 'g'), chr(10)), 1) AS i FROM documents),
kinds AS (SELECT doc_id, source, i, trim(raw, ' ') AS x, CASE WHEN trim(raw, ' ') = '' THEN NULL ELSE length(trim(raw, ' ')) % 11 END AS kind FROM lines),
spoken AS (SELECT *, len(regexp_extract_all(x, '[\p{L}\p{N}]+'))::BIGINT AS n FROM kinds),
prose AS (SELECT doc_id, sum(CASE WHEN kind = 5 THEN n + 3 WHEN kind = 6 THEN 1 WHEN kind >= 8 THEN n ELSE 0 END)::BIGINT AS words, (3 * count(*) FILTER (kind = 5))::BIGINT AS cjk FROM spoken GROUP BY doc_id)"""
_SCORED = rf"""{_WIKI},
areas AS (SELECT doc_id, string_agg(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '|') FILTER (kind = 0) AS h, count(*) FILTER (kind = 5) AS links, count(*) FILTER (kind = 6) AS drawn,
  coalesce(bool_or(contains(x, 'design')), false) AS a_design, coalesce(bool_or(contains(x, 'zz')), false) AS a_zz, bool_and(x = '') AS blank FROM kinds GROUP BY doc_id),
d AS (SELECT doc_id AS k, source, text FROM documents),
joined AS (SELECT k AS page, k % 2 = 0 AS leaf, k % 10 = 1 AS overview, k % 4 = 0 AS tail, links, a_design OR a_zz AS second, blank AND k % 3 = 2 AND k % 4 <> 0 AS is_empty,
  coalesce(h, '') || '|' || CASE k % 3 WHEN 0 THEN 'purpose and scope' WHEN 1 THEN 'design|error handling' ELSE '' END AS h, drawn + (k % 4 = 0)::INT AS blocks, cjk,
  words + CASE WHEN k % 4 = 0 THEN len(regexp_extract_all('see ' || source || '/a.py and Main', '[\p{{L}}\p{{N}}_]+')) ELSE 0 END AS words
  FROM d JOIN areas ON areas.doc_id = k JOIN prose ON prose.doc_id = k),
marked AS (SELECT *, cjk > words AS is_cjk, greatest(cjk, words)::BIGINT AS prose,
  (regexp_matches(h, 'purpose|scope|role|目的|职责|作用|范围|简介')::INT + regexp_matches(h, 'architecture|design|data flow|dataflow|dependencies|execution|lifecycle|component interaction|behavior|behaviour|架构|设计|数据流|流程|执行|生命周期|依赖|组件交互|行为|运行')::INT
  + regexp_matches(h, 'responsibilities|interfaces|usage|error|responsibility|职责|接口|使用|错误|异常|状态|能力|实现')::INT)::BIGINT AS areas, (tail::INT + second::INT)::BIGINT AS grounded FROM joined),
floors AS (SELECT *, CASE WHEN leaf THEN CASE WHEN is_cjk THEN 500 ELSE 150 END ELSE CASE WHEN is_cjk THEN 700 ELSE 200 END END::BIGINT AS floor FROM marked),
errs AS (SELECT *, list_filter([CASE WHEN is_empty THEN 'empty' END, CASE WHEN prose < floor THEN 'short' END, CASE WHEN grounded < 2 THEN 'ungrounded' END, CASE WHEN areas < 2 THEN 'few areas' END,
  CASE WHEN NOT leaf AND blocks = 0 THEN 'no diagram' END, CASE WHEN NOT leaf THEN 'few nodes' END, CASE WHEN NOT leaf THEN 'few edges' END, CASE WHEN NOT leaf THEN 'no path' END, CASE WHEN NOT leaf THEN 'ungrounded diagram' END,
  CASE WHEN page % 6 = 0 AND links = 0 THEN 'no link to b' END], lambda x: x IS NOT NULL) AS e FROM floors),
scored AS (SELECT page, CASE WHEN overview THEN 'repository_overview' WHEN leaf THEN 'leaf' ELSE 'module_overview' END AS role, CASE WHEN is_cjk THEN 'cjk' ELSE 'words' END AS mode, prose, floor, areas, prose >= floor AND areas >= 2 AS explanatory,
  grounded, 2::BIGINT AS anchors, blocks::BIGINT AS blocks, false AS template, false AS boilerplate, array_to_string(e, ',') AS errors, len(e) AS n, len(e) = 0 AS valid FROM errs)"""
_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_TITLE = "trim(regexp_extract(html, '<title>([^<\\n]*)', 1), ' =')"

SQL = {
    "module_edges": """
WITH edges AS (SELECT DISTINCT 'c' || o_custkey AS caller, 's' || l_suppkey AS callee, o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pairs AS (SELECT caller, callee, a.n_name AS src, b.n_name AS dst FROM edges JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_name <> b.n_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY caller, callee) AS n FROM pairs)
SELECT src, dst, count(*) AS weight, string_agg(caller || ' -> ' || callee, '; ' ORDER BY caller, callee) FILTER (n <= 4) AS evidence FROM ranked GROUP BY src, dst""",
    "first_references": f"WITH {_CALLS} SELECT caller, callee, min(line) AS line FROM calls WHERE caller <> callee GROUP BY caller, callee",
    "unique_name_resolution": f"""
WITH {_PARTS}, k AS (SELECT id, language, split_part(name, ' ', 1) AS key FROM parts)
SELECT a.id AS ref, min(b.id) AS target FROM k a JOIN k b ON a.language = b.language AND a.key = b.key AND a.id <> b.id GROUP BY a.id HAVING count(DISTINCT b.id) = 1""",
    "resolved_references": f"""
WITH parts AS (SELECT 'p' || p_partkey AS id, string_split(p_name, ' ')[1] || (p_partkey % 300) AS name,
  CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_filter([p_type, string_split(p_name, ' ')[2], CASE WHEN p_partkey % 3 > 0 THEN p_partkey::VARCHAR END], lambda x: x IS NOT NULL), '::') ELSE array_to_string(list_filter([p_type, string_split(p_name, ' ')[2], CASE WHEN p_partkey % 3 > 0 THEN p_partkey::VARCHAR END], lambda x: x IS NOT NULL), '.') END AS qualified, p_brand AS language FROM part),
made AS (SELECT DISTINCT 'p' || l_suppkey AS owner, 'p' || l_partkey AS id, l_orderkey % 6 AS form FROM lineitem),
refs AS (SELECT DISTINCT owner, o.language, CASE form WHEN 0 THEN p.id WHEN 1 THEN p.name WHEN 2 THEN p.qualified WHEN 3 THEN 'a.b.c.d.' || p.name WHEN 4 THEN 'x::y::' || p.name ELSE 'q::' || p.qualified END AS name
  FROM made JOIN parts p ON p.id = made.id JOIN parts o ON o.id = owner),
keys AS (SELECT id, language, unnest([id, name, qualified]) AS key FROM parts),
named AS (SELECT id, language, key, regexp_extract(key, '[^.:]*$') AS simple FROM keys WHERE key <> ''),
exact AS (SELECT DISTINCT id, NULL::VARCHAR AS language, key FROM named), simple AS (SELECT DISTINCT id, NULL::VARCHAR AS language, simple AS key FROM named WHERE simple <> ''),
spoken AS (SELECT id, language, key FROM named UNION SELECT id, language, simple FROM named WHERE simple <> ''),
tries AS (SELECT owner || '|' || name AS ref, owner, language, 0 AS cut, name AS key FROM refs
  UNION ALL SELECT owner || '|' || name, owner, language, 1, list_last(string_split(name, '::')) FROM refs UNION ALL SELECT owner || '|' || name, owner, language, 2, list_last(string_split(name, '.')) FROM refs),
hits AS (
  SELECT ref, cut, 0 AS rank, min(x.id) AS target FROM tries t JOIN spoken x ON x.language = t.language AND x.key = t.key WHERE x.id <> owner GROUP BY ref, cut HAVING count(DISTINCT x.id) = 1
  UNION ALL SELECT ref, cut, 1, min(x.id) FROM tries t JOIN simple x ON x.key = t.key WHERE x.id <> owner AND cut > 0 GROUP BY ref, cut HAVING count(DISTINCT x.id) = 1
  UNION ALL SELECT ref, cut, 2, min(x.id) FROM tries t JOIN exact x ON x.key = t.key WHERE x.id <> owner GROUP BY ref, cut HAVING count(DISTINCT x.id) = 1)
SELECT ref, arg_min(target, cut * 10 + rank) AS target FROM hits GROUP BY ref""",
    "depends_on": f"""WITH {_CALLS} SELECT caller AS id, count(DISTINCT callee) AS n, string_agg(DISTINCT callee, ',' ORDER BY callee) AS depends_on FROM calls WHERE caller <> callee GROUP BY caller""",
    "candidate_policy": f"WITH {_PARTS}, {_POLICY} SELECT * FROM decided",
    "leaf_demotion": f"""
WITH {_PARTS}, {_POLICY}, wanted AS (SELECT id FROM parts, decided WHERE component_type IN ('artifact', 'class') OR include_functions),
used AS (SELECT 'p' || o_orderkey AS callee FROM orders JOIN parts ON parts.id = 'p' || o_custkey WHERE component_type <> 'artifact')
SELECT id FROM wanted WHERE (SELECT count(*) FROM wanted) < 400 OR id NOT IN (SELECT callee FROM used)""",
    "builtin_filter": """
WITH r AS (SELECT l_orderkey, l_linenumber, ['python', 'go', 'rust', 'c', 'java', 'ruby', 'kotlin'][l_suppkey % 7 + 1] AS language, ['len', 'list', 'Vec', 'rune', 'size_t', 'Int', 'run', 'Box', 'to_s', 'error', 'Boolean', 'main'][l_partkey % 12 + 1] AS last, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, language, CASE WHEN l_suppkey % 2 = 0 THEN 'pkg.' ELSE 'm::' END || last AS name FROM r
WHERE last NOT IN ('len', 'to_s', 'Boolean') AND NOT (language = 'python' AND last = 'list') AND NOT (language = 'go' AND last IN ('rune', 'error')) AND NOT (language = 'rust' AND last IN ('Vec', 'Box'))
  AND NOT (language = 'c' AND last = 'size_t') AND NOT (language IN ('java', 'kotlin') AND last = 'Int')""",
    "id_checks": r"""
WITH p AS (SELECT page_id, url, sha1(url) AS a, sha1(html) AS b, sha256(url) AS c FROM pages),
t AS (SELECT page_id, unnest(range(0, 11)) AS i, unnest([url, a || '..' || b, a || '..' || c, regexp_extract(url, '^[^:]+://([^/]*)', 1), regexp_replace(url, '^[^:]+://', ''), substr(a, 1, 7), '_' || a, c, c || '-x', 'wiki:' || substr(a, 1, 3), 'x/../' || a]) AS value FROM p)
SELECT *, regexp_full_match(value, '[A-Za-z0-9_-]+') AND regexp_full_match(lower(value), '[a-z0-9]|[a-z0-9][a-z0-9_-]*[a-z0-9]') AND NOT contains(value, '__') AS module,
  len(list_filter(string_split(value, ':'), lambda x: NOT (regexp_full_match(x, '[a-z0-9]|[a-z0-9][a-z0-9_-]*[a-z0-9]') AND NOT contains(x, '__')))) = 0 AS wiki,
  regexp_full_match(value, '[A-Za-z0-9_-]{1,64}') AS session, regexp_full_match(value, '[0-9A-Fa-f]{40}\.\.[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}\.\.[0-9A-Fa-f]{64}') AS change,
  NOT starts_with(value, '/') AND NOT list_contains(string_split(value, '/'), '..') AS path FROM t""",
    "referrers": f"WITH {_PARTS}, {_CALLS} SELECT DISTINCT callee AS id, caller AS referrer FROM calls JOIN parts ON parts.id = callee WHERE component_type = 'artifact'",
    "artifact_units": "SELECT 'c' || conv_id || '/Makefile' AS path, role || '_' || turn AS unit FROM conversations",
    "path_glob_filter": rf"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, path FROM p WHERE path <> '' AND (path LIKE '/en/%' OR regexp_matches(path, '^.*/fr/[1-5].*$')) AND path NOT LIKE '%.html' AND NOT regexp_matches(path, '/.7')
AND len(list_intersect(string_split(path, '/'), ['.git', '.state', 'target', 'node_modules', '.venv', 'venv', '.tox', 'dist', 'build', 'vendor', 'coverage', '__pycache__'])) = 0""",
    "artifact_classes": f"""
WITH ends AS (SELECT ['.py', '.sql', '.sh', '.rs', '/package.json', '/Makefile', '.env.example', '/scripts/a', '/test/b.go', '/yarn.lock', '/CONFIG.json', '.kts', '.h++', ''] AS e),
paths AS (SELECT p_partkey, unnest([replace(p_type, ' ', '/') || '/' || replace(p_name, ' ', '-'), 'src/' || replace(p_type, ' ', '/') || '/Dockerfile.' || p_partkey, p_brand || '/.github/workflows/' || replace(p_name, ' ', '-') || '.yml',
  'db/' || replace(p_type, ' ', '/') || '/migrations/' || p_partkey || '.txt']) || e[p_partkey % 14 + 1] AS path FROM part, ends),
low AS (SELECT *, lower(path) AS l, regexp_extract(lower(path), '[^/]*$') AS f FROM paths)
SELECT p_partkey, path, CASE
  WHEN f = 'dockerfile' OR starts_with(f, 'dockerfile.') OR contains(l, '/docker/') THEN 'container'
  WHEN contains(l, '.github/workflows/') OR ends_with(l, '.github/workflows') OR contains(l, 'gitlab-ci') THEN 'ci'
  WHEN f IN ('cargo.toml', 'go.mod', 'pyproject.toml', 'package.json', 'pom.xml', 'build.gradle', 'setup.py') THEN 'manifest'
  WHEN f IN ('makefile', 'justfile', 'rakefile', 'gradlew', 'setup.cfg') THEN 'build'
  WHEN ends_with(l, '.sql') OR contains(l, '/schema') OR contains(l, '/migrations/') THEN 'schema'
  WHEN starts_with(f, 'config.') OR ends_with(l, '.env.example') OR contains(l, '/config') THEN 'config'
  WHEN ends_with(l, '.sh') OR contains(l, '/scripts/') OR contains(l, '/bin/') THEN 'script'
  WHEN contains(l, '/test') OR contains(l, '/fixtures/') THEN 'test_infra'
  WHEN f IN ('cargo.lock', 'go.sum', 'requirements.txt', 'poetry.lock', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml') THEN 'packaging' END AS class,
  CASE WHEN contains(f, '.') THEN CASE regexp_extract(f, '[^.]*$') WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'kts' THEN 'kotlin' WHEN 'h++' THEN 'cpp' END END AS language FROM low""",
    "language_counts": f"""SELECT lang AS language, count(*) AS n, sum((length(text) + 3) // 4)::BIGINT AS tokens FROM documents GROUP BY lang""",
    "cluster_responses": """
WITH line AS (SELECT l_orderkey AS response, l_returnflag AS flag, l_linestatus AS status, l_linenumber AS n, l_quantity AS q, 'p' || l_partkey AS id FROM lineitem),
asked AS (SELECT response, id FROM line WHERE q > 25 UNION SELECT o_orderkey, 'o' || o_orderkey FROM orders WHERE o_custkey % 5 <> 0),
unknown AS (SELECT DISTINCT response FROM asked WHERE starts_with(id, 'o') AND response % 7 = 0),
claimed AS (SELECT response, id, min(flag) AS flag FROM line SEMI JOIN asked USING (response, id) GROUP BY ALL),
kept AS (SELECT response, count(*) AS selected, count(DISTINCT flag) AS groups FROM claimed GROUP BY response),
o AS (
  SELECT o_orderkey AS response, o_custkey % 2 = 1 AS module, o_orderpriority AS top, CASE o_orderstatus WHEN 'F' THEN 'split' WHEN 'O' THEN 'retain_leaf' END AS decision,
    (SELECT count(*) FROM asked a WHERE a.response = o_orderkey) AS n, o_orderkey IN (FROM unknown) AS unknown, coalesce(selected, 0) AS selected, coalesce(groups, 0) AS groups
  FROM orders LEFT JOIN kept ON kept.response = o_orderkey),
judged AS (SELECT *, CASE WHEN n = 0 THEN 'no component was asked for' WHEN unknown THEN 'an unknown component was asked for' WHEN module AND groups = 0 AND decision IS NULL THEN 'no groups and no review'
  WHEN module AND groups = 0 AND decision <> 'retain_leaf' THEN 'no groups, but the leaf isn''t retained' WHEN groups = 0 AND NOT module THEN 'no groups' WHEN module AND decision <> 'split' AND groups > 0 THEN 'groups, but the decision isn''t split' END AS error FROM o),
good AS (SELECT response, module, top FROM judged WHERE error IS NULL),
made AS (
  SELECT response, CASE WHEN module THEN [top, 'x', flag] ELSE [flag] END AS path, id FROM claimed JOIN good USING (response)
  UNION SELECT response, CASE WHEN module THEN [top, 'x', flag, status] ELSE [flag, status] END, id FROM line JOIN good USING (response) SEMI JOIN (SELECT DISTINCT response, flag FROM claimed) USING (response, flag) WHERE n % 2 = 0
  UNION SELECT response, p, id FROM claimed JOIN good USING (response), unnest([[top], [top, 'x']]) AS u(p) WHERE module),
counted AS (SELECT response, count(*) AS members, max(len(path)) AS deepest FROM made GROUP BY response)
SELECT response, error, CASE WHEN error IS NULL AND module THEN decision END AS decision, CASE WHEN error IS NULL THEN selected ELSE 0 END AS selected, CASE WHEN error IS NULL AND groups > 0 THEN n - selected ELSE 0 END AS omitted,
  CASE WHEN error IS NULL THEN groups ELSE 0 END AS groups, members, deepest FROM judged LEFT JOIN counted USING (response)""",
    "source_components": """
SELECT 'D' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.java' END AS relative_path, n + 1 AS n, n AS methods, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END * n AS parameters, 'Base' AS bases,
  CASE WHEN doc_id % 2 = 0 THEN 1 + 9 * n + 2 * n * (n - 1) ELSE 2 + 5 * n + n * (n - 1) END AS end_lines
FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)""",
    "source_references": """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
SELECT 'f_' || coalesce(nullif(regexp_extract(x, '([A-Za-z]+)', 1), ''), 'none') AS name, count(*) AS callers, count(*) AS methods, sum(CASE WHEN doc_id % 2 = 0 THEN 5 + 4 * i ELSE 3 + 2 * i END)::BIGINT AS lines FROM lines GROUP BY ALL""",
    "class_cap_and_budget": """
WITH RECURSIVE classes AS (SELECT source, row_number() OVER (ORDER BY source) AS c FROM (SELECT DISTINCT source FROM documents)),
files AS (SELECT doc_id, source, n_chars, c, row_number() OVER (ORDER BY doc_id) AS i FROM documents JOIN classes USING (source)),
walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, [0 FOR x IN range((SELECT count(*) FROM classes))] AS counts, false AS included
  UNION ALL SELECT f.i, used + CASE WHEN counts[c] < 40 AND used + n_chars <= 1000000 THEN n_chars ELSE 0 END,
    CASE WHEN counts[c] < 40 AND used + n_chars <= 1000000 THEN list_transform(counts, lambda x, k: CASE WHEN k = c THEN x + 1 ELSE x END) ELSE counts END,
    counts[c] < 40 AND used + n_chars <= 1000000 FROM walk JOIN files f ON f.i = walk.i + 1)
SELECT doc_id AS path, source AS class, n_chars AS size, included FROM walk JOIN files USING (i)""",
    "safe_ids": r"""
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe_name, regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS safe_id,
  regexp_replace(substr(url, 1, 180), '[^A-Za-z0-9_.-]', '__', 'g') || '_' || substr(sha256(url), 1, 8) || '.src' AS source_file,
  'change_' || sha256(sha1(url) || '..' || sha1(html)) AS edition, regexp_extract(url, '/([a-z]+)/', 1) <> '' AS segment FROM pages""",
    "page_ids": f"""
WITH {_TREE}, p AS (SELECT id, CASE WHEN regexp_matches(array_to_string(path, ''), '^[A-Za-z0-9_-]+$') THEN 'wiki:' || lower(array_to_string(path, ':')) || ':start' END AS page FROM tree)
SELECT *, replace(page, ':', '/') || '.txt' AS file FROM p""",
    "role_labels": f"""
WITH m AS (SELECT doc_id, lower(concat_ws('_', 'm', array_to_string(string_split(text, ' ')[1:3], ' '), CASE WHEN doc_id % 7 = 0 THEN 'Runtime' WHEN doc_id % 5 = 0 THEN 'HttpClient' WHEN doc_id % 11 = 0 THEN 'Database' END)) AS m FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(m, 'storage|database|state') THEN 'state' WHEN regexp_matches(m, 'protocol|api|client|server') THEN 'interface' WHEN regexp_matches(m, 'execution|runtime|pipeline|interpreter') THEN 'execution'
  WHEN regexp_matches(m, 'build|test|release|packag') THEN 'support' WHEN regexp_matches(m, 'network|integration') THEN 'integration' ELSE 'subsystem' END AS role FROM m""",
    "tree_paths": f"WITH {_TREE} SELECT id, array_to_string(path, '/') AS path, depth::BIGINT AS depth, parent FROM tree",
    "post_order": f"""WITH {_TREE} SELECT id, array_to_string(path, chr(1)) || chr(1) || chr(65535) AS position FROM tree""",
    "ancestors": f"""
WITH {_TREE}, up AS (SELECT path, depth, unnest(range(1, depth + 1)) AS n FROM tree)
SELECT array_to_string(path[1:n], '/') AS ancestor, count(*) AS n, max(depth - n)::BIGINT AS deepest FROM up GROUP BY array_to_string(path[1:n], '/')""",
    "deepest_owner": f"WITH {_OWNED} SELECT id, arg_min(module, ((9 - depth)::VARCHAR || module)) AS module, max(module) AS last_module FROM owned GROUP BY id",
    "boundary_owner": rf"""
WITH files AS (SELECT DISTINCT substr({_PATH}, 2) AS file FROM pages WHERE {_PATH} NOT IN ('', '/')),
modules AS (SELECT DISTINCT regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)', 1) AS prefix, 1 AS depth FROM pages
  UNION SELECT regexp_extract(url, '^[^:]+://[^/]+/([a-z]+/[0-9]+)', 1), 2 FROM pages)
SELECT file, 'm:' || arg_max(prefix, length(prefix) * 10 + depth) AS module FROM files JOIN modules ON prefix <> '' AND (file = prefix OR starts_with(file, prefix || '/') OR starts_with(file, prefix || '.')) GROUP BY file""",
    "initial_modules": rf"""
WITH c AS (SELECT substr({_PATH}, 2) AS p FROM pages)
SELECT regexp_replace(split_part(p, '/', 1), '[^A-Za-z0-9_-]', '_', 'g') AS module, CASE WHEN contains(min(p), '/') THEN regexp_replace(min(p), '/[^/]*$', '') ELSE '' END AS path, count(*) AS n FROM c WHERE p <> '' GROUP BY 1""",
    "claims": f"""SELECT min('s' || l_suppkey) AS module, l_partkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey""",
    "super_groups": f"""
WITH m AS (SELECT DISTINCT o_orderpriority || '/' || l_linestatus || '/' || (o_custkey % 9) AS parent, p_brand AS module FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
f AS (SELECT min(parent) AS parent, module FROM m WHERE parent IN (SELECT parent FROM m GROUP BY parent HAVING count(*) >= 2) GROUP BY module),
made AS (SELECT * FROM f WHERE parent IN (SELECT parent FROM f GROUP BY parent HAVING count(*) >= 2)),
kept AS (SELECT DISTINCT p_brand AS x FROM part WHERE p_brand NOT IN (SELECT module FROM f) UNION SELECT parent FROM made)
SELECT parent, module FROM made WHERE (SELECT count(*) FROM kept) < (SELECT count(DISTINCT p_brand) FROM part)""",
    "tree_quality": """
WITH owned AS (SELECT DISTINCT l_partkey AS id, 'leaf' || (l_suppkey % 50) AS leaf, l_suppkey % 5 + 1 AS depth FROM lineitem),
shared AS (SELECT id, count(DISTINCT leaf) AS leaves FROM owned GROUP BY id),
sums AS (SELECT leaf, max(depth)::BIGINT AS depth, count(*) AS components, sum((length(p_name) + 3) // 4)::BIGINT AS tokens, count(*) FILTER (leaves > 1) AS shared FROM owned JOIN shared USING (id) JOIN part ON p_partkey = id GROUP BY leaf)
SELECT *, CASE WHEN depth > 4 OR (tokens > 100 AND components > 1) THEN 'error' WHEN tokens > 100 THEN 'warning' ELSE 'ok' END AS verdict FROM sums""",
    "review_check": f"""
SELECT * FROM (SELECT o_orderkey AS leaf, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 4 = 0 OR trim(o_orderpriority) = '' THEN 'empty reason'
  WHEN (o_orderkey % 2 = 1) <> (o_custkey % 3 > 0) THEN 'mismatched decision' WHEN o_custkey % 3 > 0 AND o_orderkey % 5 = 0 THEN 'high-risk leaf' END AS problem FROM orders) WHERE problem IS NOT NULL""",
    "khop_upstream": f"""
WITH {_PARTS}, {_CALLS}, e AS (SELECT DISTINCT caller, callee FROM calls), one AS (SELECT caller AS start, callee AS id FROM e JOIN parts ON parts.id = caller WHERE component_type = 'artifact'),
two AS (SELECT start, callee AS id FROM one JOIN e ON caller = one.id)
SELECT start, id, min(hop)::BIGINT AS hop FROM (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY start, id""",
    "diagram_paths": """
WITH e AS (SELECT DISTINCT a.l_orderkey AS page, a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT DISTINCT x.page FROM e x JOIN e y ON x.page = y.page AND x.b = y.a JOIN e z ON y.page = z.page AND y.b = z.a WHERE x.a <> x.b AND y.b NOT IN (x.a, x.b) AND z.b NOT IN (x.a, x.b, y.b)""",
    "target_subtree": f"""
WITH RECURSIVE {_NATION_EDGES}, m AS (SELECT n_nationkey::BIGINT AS n, r_name, r_name || ' / ' || n_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey),
ranked AS (SELECT a.module AS src, b.module AS dst, row_number() OVER (ORDER BY a.module, b.module) AS k FROM edges JOIN m a ON a.n = caller JOIN m b ON b.n = callee WHERE a.module <> b.module),
modules AS (SELECT module FROM m UNION SELECT r_name FROM m),
entered AS (SELECT t.module AS target, x.module, 0::BIGINT AS k FROM modules t JOIN modules x ON x.module = t.module OR starts_with(x.module, t.module || ' / ')
  UNION SELECT e.target, CASE WHEN r.src = e.module THEN r.dst ELSE r.src END, r.k FROM entered e JOIN ranked r ON e.module IN (r.src, r.dst) AND r.k > e.k)
SELECT DISTINCT target, module FROM entered""",
    "snapshot_diff": f"WITH {_SNAPSHOTS} SELECT kind, id FROM changes",
    "change_ratios": f"""
WITH {_SNAPSHOTS}, c AS (SELECT count(DISTINCT id) FILTER (kind <> 'deleted') AS active, count(DISTINCT (kind, id)) FILTER (kind IN ('added', 'deleted', 'edge_changes')) AS structural, count(*) FILTER (kind = 'added') AS added, (SELECT greatest(count(*), 1) FROM new) AS total FROM changes),
r AS (SELECT active, structural, total, round(active / total, 6) AS active_ratio, round(structural / total, 6) AS structural_ratio, added, round(added / total, 6) AS growth_ratio FROM c),
f AS (SELECT *, CASE WHEN structural_ratio >= 0.3 THEN 'structural-threshold' WHEN active_ratio >= 0.5 THEN 'active-leaf-threshold' END AS fallback FROM r)
SELECT *, fallback IS NOT NULL OR (added > 0 AND growth_ratio >= 0.33) AS reclustered, CASE WHEN fallback IS NOT NULL OR NOT EXISTS (FROM old) THEN 'full_fallback' WHEN NOT EXISTS (FROM changes) THEN 'no_change' ELSE 'incremental' END AS outcome FROM f""",
    "active_set": f"WITH {_SNAPSHOTS} SELECT DISTINCT id FROM changes WHERE kind <> 'deleted'",
    "neighbour_majority": """
WITH e AS (SELECT DISTINCT l_partkey AS id, l_suppkey FROM lineitem), n AS (SELECT id, n_name AS page, count(*) AS n FROM e JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY id, n_name),
r AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY n DESC, page) AS k FROM n)
SELECT id, CASE WHEN n / total >= 0.25 THEN page ELSE 'overview' END AS page FROM r WHERE k = 1""",
    "write_sets": f"""
WITH {_OWNED}, own AS (SELECT id, arg_min(module, ((9 - depth)::VARCHAR || module)) AS page FROM owned GROUP BY id), a AS (SELECT l_partkey AS id FROM lineitem UNION SELECT c_custkey FROM customer)
SELECT id, page FROM a JOIN own USING (id) UNION SELECT id, 'overview' FROM a""",
    "verdicts": f"""
WITH v AS (SELECT event_id AS page, CASE event_type WHEN 'click' THEN ' Patch ' WHEN 'view' THEN 'no-op' WHEN 'purchase' THEN 'REWRITE' WHEN 'signup' THEN 'create: new' WHEN 'logout' THEN 'perhaps' ELSE event_type END AS said,
  CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN 'r' || user_id END AS own, event_id % 2 = 0 AS bare FROM events),
w AS (SELECT *, lower(trim(said)) AS s, trim(split_part(lower(trim(said)), ':', 1)) AS name FROM v), ok AS (SELECT *, name IN ('no-op', 'patch', 'rewrite', 'create', 'delete') AS good FROM w)
SELECT page, CASE WHEN good THEN name END AS verdict, coalesce(own, CASE WHEN bare AND contains(s, ':') THEN trim(split_part(s, ':', 2)) END) AS reason, CASE WHEN good THEN s || coalesce(': ' || own, '') END AS record FROM ok""",
    "hunk_overlap": """
WITH e AS (SELECT event_id, user_id, event_id % 5000 AS at FROM events)
SELECT h.event_id AS hunk, c.event_id AS id FROM e h JOIN e c ON h.user_id = c.user_id AND h.at <= c.at + c.event_id % 700 AND c.at <= h.at + h.event_id % 400 WHERE h.event_id % 3 = 0 AND c.event_id % 3 <> 0""",
    "edge_set_operations": f"""
WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' ELSE 'kept' END AS side FROM a FULL JOIN b ON a.id = b.id""",
    "prose_counts": f"""WITH {_WIKI} SELECT doc_id, words, cjk FROM prose""",
    "opaque_blocks": r"""WITH t AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(coalesce(text, ''), ' a', ' <code>a'), ' d', ' </code>d'), ' e', ' <file>e'), ' i', ' </file>i'), ' n', ' <nowiki>n'), ' s', ' </nowiki>s') AS t FROM documents),
        m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<code>.*?(?:</code>|\z)', chr(2) || '\0' || chr(3), 'g'), '(?s)<file>.*?(?:</file>|\z)', chr(2) || '\0' || chr(3), 'g'), '(?s)<nowiki>.*?(?:</nowiki>|\z)', chr(2) || '\0' || chr(3), 'g') AS t FROM t),
        p AS (SELECT doc_id, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS piece, unnest([0] || marks) AS mark FROM (SELECT doc_id, regexp_split_to_array(t, '[\x02\x03]') AS pieces, list_transform(regexp_extract_all(t, '[\x02\x03]'), lambda x: CASE x WHEN chr(2) THEN 1 ELSE -1 END) AS marks FROM m)),
        d AS (SELECT *, sum(mark) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM p),
        shown AS (SELECT doc_id, replace(coalesce(string_agg(piece, '' ORDER BY i) FILTER (depth = 0), ''), chr(10), '') AS t FROM d GROUP BY doc_id)
        SELECT doc_id, length(t) AS n_shown, md5(t) AS shown_md5 FROM shown""",
    "headings": f"""
WITH {_WIKI}, h AS (SELECT doc_id, string_agg(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '|' ORDER BY i) FILTER (kind = 0) AS headings, arg_min(x, i) FILTER (kind = 0) AS title FROM kinds GROUP BY doc_id)
SELECT doc_id, coalesce(headings, '') AS headings, coalesce(title, '-') AS title FROM h""",
    "truncation": """
WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 187) || chr(10) || '... [diff truncated] ...' || chr(10) || right(text, 187) END AS t FROM documents)
SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM c""",
    "token_estimate_oversized": "SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents WHERE (length(text) + 3) // 4 > 1000",
    "link_extract": f"SELECT target, count(*) AS n FROM (SELECT {_HREF} AS target FROM pages) GROUP BY target",
    "broken_links": f"WITH {_EXPECTED} SELECT DISTINCT page, target FROM (SELECT page_id AS page, {_HREF} AS target FROM pages) WHERE target NOT IN (SELECT page FROM expected)",
    "page_differences": f"""
WITH {_EXPECTED}, present AS (SELECT DISTINCT page FROM (SELECT {_HREF} AS page FROM pages) WHERE page LIKE '/%e%')
SELECT page, 'missing' AS problem FROM expected WHERE page NOT IN (SELECT page FROM present) UNION ALL SELECT page, 'extra' FROM present WHERE page NOT IN (SELECT page FROM expected)""",
    "unlinked_children": "SELECT n_regionkey AS parent, n_nationkey AS page FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "page_id_collisions": "SELECT regexp_replace(lower(p_name), '[^A-Za-z0-9]', '_', 'g') AS page, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1",
    "grounding": r"""
WITH w AS (SELECT doc_id AS page, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS content, source || '::' || doc_id AS id, regexp_split_to_array(text, '\s+') AS w FROM documents)
SELECT page, id, contains(content, id) OR len(list_filter(string_split(content, chr(10) || chr(10)), lambda p: contains(p, w[1]) AND contains(p, coalesce(w[41], 'none')))) > 0 AS grounded FROM w""",
    "scoped_search": r"""
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda t: lower(t)), lambda t: t IN ('the', 'with')) AS h FROM documents WHERE lang = 'en')
SELECT doc_id AS page, len(h) AS hits FROM w WHERE len(list_distinct(h)) = 2""",
    "search_index": rf"""
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda t: lower(t))) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS pages, count(*) AS n FROM t GROUP BY term""",
    "html_export": rf"""
WITH p AS (SELECT page_id, url, {_TITLE} AS t FROM pages), q AS (SELECT page_id, url AS u, {_ESCAPE.format("CASE WHEN t = '' THEN url ELSE t END")} AS e FROM p)
SELECT 'wiki:p' || page_id AS page, 'wiki/' || u AS position, '  <a href="#page-wiki-p' || page_id || '">' || e || '</a>' AS nav,
  '<section id="page-wiki-p' || page_id || '"><h1>' || e || '</h1><p>' || {_ESCAPE.format("regexp_replace('=== ' || regexp_extract(html, '<title>([^<\\n]*)', 1) || ' ===', '%%.*?%%|''''.*?''''|\\*\\*|//|__|~~|<[A-Za-z/][^>\\n]*>', '', 'g') || chr(10) || 'b & c ' || chr(10) || trim(regexp_replace(html, '[^\\pL\\pN ]+', ' ', 'g'), ' ')")} || '</p></section>' AS section FROM q JOIN pages USING (page_id)""",
    "prompt_render": f"""
WITH p AS (SELECT c_custkey, 'Document ' || c_name || ' in ' || n_name || '/' || c_mktsegment || '. ' || c_name || ' is a leaf.' AS prompt FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT *, sha256(prompt) AS sha, length(prompt) AS chars FROM p""",
    "session_prune": """
SELECT id, owner, ts FROM (SELECT event_id AS id, user_id AS owner, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 1728000 SECOND) WHERE n <= 10""",
    "orphan_locks": f"""SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)""",
    "graph_load": "SELECT s_nationkey AS graph, 's' || s_suppkey AS id, s_name AS name, 'n' || s_nationkey AS depends_on FROM supplier",
    "tree_load": f"""
WITH c AS (SELECT r_regionkey AS tree, r_name, n_name, c_mktsegment, string_agg(c_name, ',' ORDER BY c_name) AS ids FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT DISTINCT tree, r_name AS path, 1::BIGINT AS depth, NULL::VARCHAR AS parent, false AS is_leaf, '' AS components FROM c
UNION ALL SELECT DISTINCT tree, r_name || '/' || n_name, 2, r_name, false, '' FROM c
UNION ALL SELECT tree, r_name || '/' || n_name || '/' || c_mktsegment, 3, r_name || '/' || n_name, true, ids FROM c""",
    "tree_save": """
WITH leaf AS (SELECT c_nationkey AS n, c_mktsegment AS seg, string_agg(DISTINCT '"' || c_name || '"', ',' ORDER BY '"' || c_name || '"') AS ids FROM customer GROUP BY c_nationkey, c_mktsegment),
below AS (SELECT n, string_agg('"' || seg || '":{"components":[' || ids || '],"children":{}}', ',' ORDER BY seg) AS children FROM leaf GROUP BY n),
own AS (SELECT s_nationkey AS n, string_agg(DISTINCT '"' || s_name || '"', ',' ORDER BY '"' || s_name || '"') AS ids FROM supplier GROUP BY s_nationkey),
nat AS (
  SELECT n_regionkey, n_name, '"' || n_name || '":{"components":[' || coalesce(ids, '') || '],"children":{' || coalesce(children, '') || '}}' AS v
  FROM nation LEFT JOIN below ON below.n = n_nationkey LEFT JOIN own ON own.n = n_nationkey WHERE ids IS NOT NULL OR children IS NOT NULL)
SELECT r_regionkey AS tree, '{"' || r_name || '":{"components":[],"children":{' || string_agg(v, ',' ORDER BY n_name) || '}}}' AS value FROM nat JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""",
    "cluster_groups": "SELECT o_orderkey AS response, o_orderpriority AS module, unnest(['c' || o_custkey, 'o' || o_orderkey]) AS id FROM orders",
    "patch_hunks": """
SELECT o_orderkey AS patch, 'f' || (o_orderkey % 7) || '.py' AS path, o_custkey AS first, o_custkey + greatest(o_orderkey % 4 - 1, 0) AS last FROM orders
UNION ALL SELECT o_orderkey, 'f' || (o_orderkey % 7) || '.py', o_orderkey, o_orderkey FROM orders UNION ALL SELECT o_orderkey, 'q.go', 4, 5 FROM orders""",
    "id_lists": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a,' || event_type WHEN 1 THEN event_type || ',b' END AS ids FROM events",
    "page_creation": """
SELECT o_orderkey AS page, o_orderstatus AS content, CASE WHEN o_orderkey % 3 = 0 THEN 'created' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'same' END AS outcome FROM orders""",
    "edition_merge": """
SELECT c_mktsegment AS edition, c_nationkey AS page, CASE WHEN c_nationkey % 2 = 0 THEN max(c_name) ELSE max(n_name) END AS content FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment, c_nationkey
UNION ALL SELECT 'repository', n_nationkey, n_name FROM nation""",
    "edition_catalog": "SELECT source AS edition, count(*) AS pages, min(doc_id) AS first_page, arg_min(text, doc_id) AS title FROM documents GROUP BY source",
    "history_scan": """
SELECT user_id AS path, date_trunc('day', ts)::TIMESTAMP AS ts, value AS mtime, event_id AS file FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, value DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "overview_context": f"""
WITH {_TREE}
SELECT array_to_string(path, '/') AS module, depth::BIGINT AS depth, array_to_string(path, '/') = 'ASIA/CHINA' AS is_target,
  CASE WHEN depth = 3 AND array_to_string(path[1:2], '/') = 'ASIA/CHINA' THEN 'wiki:asia:china:' || replace(lower(path[3]), '#', '-') || ':start' END AS child_page FROM tree""",
    "id_differences": f"""
SELECT DISTINCT l_suppkey AS id, 'unknown' AS problem FROM lineitem WHERE l_suppkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT DISTINCT p_partkey, 'omitted' FROM part WHERE p_partkey NOT IN (SELECT l_suppkey FROM lineitem)""",
    "component_listing": f"""SELECT c_nationkey AS relative_path, count(*) AS n, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS ids FROM customer GROUP BY c_nationkey""",
    "claim_problems": f"""
WITH g AS (SELECT DISTINCT 's' || l_suppkey AS module, l_partkey AS id FROM lineitem), f AS (SELECT id, min(module) AS module FROM g WHERE id IN (SELECT c_custkey FROM customer) GROUP BY id)
SELECT module, id, 'outside its input' AS problem FROM g WHERE id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT g.module, g.id, 'claimed before' FROM g JOIN f USING (id) WHERE g.module <> f.module
UNION ALL SELECT DISTINCT module, NULL, 'keeps no component' FROM g WHERE module NOT IN (SELECT module FROM f)""",
    "applied_clusters": f"""
WITH c AS (SELECT c_custkey AS id, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT id, r_name, n_name, min(o_orderpriority) AS m FROM c JOIN orders ON o_custkey = id GROUP BY ALL)
SELECT r_name AS path, id FROM c UNION SELECT r_name, id FROM f UNION SELECT r_name || '/' || n_name, id FROM f UNION SELECT r_name || '/' || n_name || '/' || m, id FROM f""",
    "ancestor_sets": f"""
WITH hit AS (SELECT DISTINCT r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS module FROM hit UNION SELECT r_name || '/' || n_name FROM hit""",
    "stale_scan": f"""
WITH p AS (SELECT {_PATH} AS page, html FROM pages), l AS (SELECT page, {_HREF} AS target FROM p WHERE page <> ''), present AS (SELECT DISTINCT target AS page FROM l), expected AS (SELECT DISTINCT page FROM p WHERE page <> ''),
a AS (SELECT page, target FROM l UNION SELECT page, target || 'x' FROM l)
SELECT page, 'missing' AS problem, NULL::VARCHAR AS target FROM expected WHERE page NOT IN (SELECT page FROM present)
UNION ALL SELECT page, 'extra', NULL FROM present WHERE page NOT IN (SELECT page FROM expected) UNION ALL SELECT page, 'broken link', target FROM a WHERE target NOT IN (SELECT page FROM present)""",
    "tree_outline": f"""
WITH f AS (SELECT n_regionkey AS tree, n_name, c_mktsegment, string_agg(c_name, ', ' ORDER BY c_name) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
n AS (SELECT tree, n_name, '    ' || n_name || chr(10) || string_agg('      ' || c_mktsegment || ': ' || names, chr(10) ORDER BY c_mktsegment) AS t FROM f GROUP BY tree, n_name)
SELECT tree, 'top (current module)' || chr(10) || '  Children:' || chr(10) || string_agg(t, chr(10) ORDER BY n_name) AS outline FROM n GROUP BY tree""",
    "page_scores": f"WITH {_SCORED} SELECT * EXCLUDE (n) FROM scored",
    "report_rollup": f"""WITH {_SCORED} SELECT count(*) AS pages, count(*) FILTER (valid) AS valid_pages, count(*) FILTER (explanatory) AS explanatory, count(*) FILTER (blocks > 0) AS with_diagram, count(*) FILTER (grounded > 0) AS grounded, sum(prose)::BIGINT AS prose, sum(n)::BIGINT AS errors, bool_and(valid) AS all_valid FROM scored""",
    "report_contexts": f"""
WITH {_CALLS}, e AS (SELECT DISTINCT caller, callee FROM calls WHERE caller <> callee), k AS (SELECT 'p' || p_partkey AS id, repeat(p_name, 4) AS t, length(repeat(p_name, 4)) % 3 AS m FROM part),
up AS (SELECT caller AS id, string_agg(callee, ',' ORDER BY callee) AS up FROM e GROUP BY caller), used AS (SELECT callee AS id, string_agg(caller, ',' ORDER BY caller) AS referrers FROM e GROUP BY callee)
SELECT k.id, CASE m WHEN 0 THEN 'create' ELSE 'edit' END AS mode, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 27) || chr(10) || '... [diff truncated] ...' || chr(10) || right(t, 27) END AS own, coalesce(up, '') AS up, coalesce(referrers, '') AS referrers
FROM k LEFT JOIN up USING (id) LEFT JOIN used USING (id) WHERE m <> 2""",
    "diagram_quality": """
WITH l AS (SELECT l_orderkey AS page, l_linenumber AS n, 's' || l_suppkey AS a, CASE l_partkey % 9 WHEN 0 THEN 'Module' WHEN 1 THEN 'Release it' ELSE p_brand END AS label, p_brand, CASE WHEN l_returnflag = 'R' THEN '==>' ELSE '-->' END AS arrow FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT x.page, row_number() OVER (PARTITION BY x.page ORDER BY x.n, x.a || '[' || x.label || '] ' || x.arrow || ' ' || y.a) AS n, x.a, x.label, y.a AS b FROM l x JOIN l y ON x.page = y.page AND y.n = x.n + 1),
node AS (SELECT page, id, arg_min(label, w) AS label FROM (SELECT page, a AS id, label, n * 2 AS w FROM e UNION ALL SELECT page, b, b, n * 2 + 1 FROM e) GROUP BY page, id),
t AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9 ]', '', 'g')) AS text FROM node),
allowed AS (SELECT DISTINCT page, trim(regexp_replace(lower(p_brand), '[^a-z0-9 ]', '', 'g')) AS x FROM l WHERE n = 1),
near AS (SELECT page, id, text, coalesce(bool_or(contains(text, x) OR contains(x, text)), false) AS near, bool_or(x IS NOT NULL) AS known FROM t LEFT JOIN allowed USING (page) GROUP BY page, id, text),
ns AS (SELECT page, count(*) AS nodes, count(*) FILTER (near) AS grounded_nodes, count(*) FILTER (text = 'module') AS generic, count(*) FILTER (contains(text, 'release')) AS support, bool_or(known) AS known FROM near GROUP BY page),
es AS (SELECT e.page, count(*) AS edges, count(*) FILTER (p.near OR q.near) AS grounded_edges FROM e JOIN near p ON p.page = e.page AND p.id = e.a JOIN near q ON q.page = e.page AND q.id = e.b GROUP BY e.page),
long AS (SELECT DISTINCT x.page FROM e x JOIN e y ON x.page = y.page AND y.a = x.b AND x.a <> x.b JOIN e z ON z.page = y.page AND z.a = y.b AND y.b NOT IN (x.a, x.b)),
r AS (SELECT *, page % 3 = 0 AS leaf, page % 3 = 1 AS overview, CASE WHEN page % 3 = 1 AND nodes > 2 THEN page IN (SELECT page FROM long) ELSE true END AS has_path FROM ns JOIN es USING (page)),
i AS (SELECT *, list_filter([CASE WHEN NOT leaf AND nodes < 2 THEN 'few nodes' END, CASE WHEN NOT leaf AND NOT has_path THEN 'no path' END, CASE WHEN NOT leaf AND generic * 2 > greatest(nodes, 1) THEN 'generic' END,
  CASE WHEN NOT leaf AND known AND grounded_nodes < CASE WHEN nodes <= 2 THEN 1 ELSE greatest(nodes // 2, 2) END THEN 'ungrounded diagram' END, CASE WHEN overview AND support > 0 THEN 'support nodes' END], lambda x: x IS NOT NULL) AS list FROM r)
SELECT page, 1::BIGINT AS blocks, true AS balanced, nodes, edges, grounded_nodes, grounded_edges, generic, support, 0::BIGINT AS disconnected, has_path, array_to_string(list, ',') AS issues, CASE WHEN len(list) = 0 THEN 'pass' WHEN leaf THEN 'warning' ELSE 'fail' END AS verdict FROM i""",
    "metadata": """
SELECT count(*) AS pages, sum(length(text))::BIGINT AS characters, sum(('0x' || substr(md5(doc_id::VARCHAR || chr(1) || coalesce(text, '')), 1, 15))::BIGINT)::VARCHAR AS digest FROM documents""",
    "primary_paths": f"""
WITH RECURSIVE {_NATION_EDGES}, m AS (SELECT n_nationkey::BIGINT AS n, r_name, r_name || ' / ' || n_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey),
ranked AS (SELECT a.module AS src, b.module AS dst, row_number() OVER (ORDER BY a.module, b.module) AS k FROM edges JOIN m a ON a.n = caller JOIN m b ON b.n = callee WHERE a.module <> b.module),
modules AS (SELECT module FROM m UNION SELECT r_name FROM m),
entered AS (SELECT t.module AS target, x.module, 0::BIGINT AS k FROM modules t JOIN modules x ON x.module = t.module OR starts_with(x.module, t.module || ' / ')
  UNION SELECT e.target, CASE WHEN r.src = e.module THEN r.dst ELSE r.src END, r.k FROM entered e JOIN ranked r ON e.module IN (r.src, r.dst) AND r.k > e.k),
chosen AS (SELECT DISTINCT target, module FROM entered),
inside AS (SELECT a.target, src, dst FROM ranked JOIN chosen a ON a.module = src JOIN chosen b ON b.module = dst AND b.target = a.target),
walk AS (SELECT target, [min(module)] AS path FROM chosen c WHERE NOT EXISTS (FROM inside i WHERE i.target = c.target AND i.dst = c.module) GROUP BY target
  UNION ALL SELECT w.target, list_append(w.path, min(i.dst)) FROM walk w JOIN inside i ON i.target = w.target AND i.src = w.path[len(w.path)] AND NOT list_contains(w.path, i.dst) GROUP BY w.target, w.path),
longest AS (SELECT target, arg_max(path, len(path)) AS path FROM walk GROUP BY target),
nth AS (SELECT t.module AS target, x.module, row_number() OVER (PARTITION BY t.module ORDER BY string_split(x.module, ' / ')) AS n FROM modules t JOIN modules x ON x.module = t.module OR starts_with(x.module, t.module || ' / ')),
listed AS (SELECT target, list(module ORDER BY n) AS path FROM nth WHERE n <= 8 GROUP BY target)
SELECT l.target, array_to_string(CASE WHEN len(w.path) >= 2 THEN w.path ELSE l.path END, ' > ') AS path FROM listed l LEFT JOIN longest w USING (target)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
