"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, item, w FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL)),
bw AS (SELECT b, item, i AS o, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
       FROM (SELECT b, item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.b, bw.item, bw.o FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
runs AS (SELECT DISTINCT r, item, min(i) AS s, max(i + n) - min(i) AS len, min(o) AS o
         FROM (SELECT *, i - row_number() OVER (PARTITION BY r, b, i - o ORDER BY i) AS island FROM hits) GROUP BY r, b, item, i - o, island),
longest AS (SELECT r, max(len) AS longest, count(*) AS n_matches FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
"""

OP3 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, host, path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (SELECT p.*, (SELECT max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) FROM r
      WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict
  WHEN regexp_matches(host || path, '(^|[./_-])(spam-farm|casino|porn|xxx|viagra|warez)([./_-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

OP4 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""

_SHINGLED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

OP7 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_SHINGLED} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (SELECT a.r AS u, b.r AS v FROM s a JOIN s b ON a.sh = b.sh GROUP BY a.r, b.r
      HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.r = a.r) + (SELECT n FROM n WHERE n.r = b.r) - count(*))),
reach(u, v) AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v),
c AS (SELECT reach.u AS r, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.r = reach.v GROUP BY reach.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE c.component_id END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""

ORACLES = {"op1_decontamination": OP1, "op3_url_filter": OP3, "op4_topk_search": OP4, "op7_jaccard_join": OP7}
