"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM t JOIN g USING (h)
"""

OP7 = r"""
WITH cut AS (
  SELECT doc_id, text, unnest(regexp_extract_all(text,
    '(?:[^\n.!?]|[.!?]+[^\n.!?\x20\x09\x0B-\x0D])*(?:[.!?]+[\x20\x09\x0B-\x0D]|[.!?]*\n|[.!?]+$|$)')) AS unit,
    generate_subscripts(regexp_extract_all(text,
    '(?:[^\n.!?]|[.!?]+[^\n.!?\x20\x09\x0B-\x0D])*(?:[.!?]+[\x20\x09\x0B-\x0D]|[.!?]*\n|[.!?]+$|$)'), 1) AS no
  FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, no, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY no)::BIGINT AS stop, length(unit) AS size,
    list_filter(regexp_split_to_array(lower(unit), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM cut
), unit AS (
  SELECT doc_id, stop - size AS start, stop, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY no)::BIGINT AS upto, len(words) AS n, words
  FROM placed WHERE len(words) > 0
), whole AS (SELECT doc_id, flatten(list(words ORDER BY start)) AS words, max(stop) AS stop, sum(n)::BIGINT AS total FROM unit GROUP BY doc_id),
block AS (
  SELECT a.doc_id, a.start, b.stop, a.upto - a.n AS before, b.upto
  FROM (SELECT *, upto - n + 20 AS need FROM unit) a ASOF JOIN unit b ON a.doc_id = b.doc_id AND a.need <= b.upto
  UNION
  SELECT doc_id, max(u.start), any_value(w.stop), max(u.upto - u.n), any_value(total)
  FROM unit u JOIN whole w USING (doc_id) WHERE u.upto - u.n <= total - 20 GROUP BY doc_id
), hashed AS (
  SELECT doc_id, start, b.stop, sha256(array_to_string(words[before + 1:upto], ' ')) AS h FROM block b JOIN whole USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS place, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id, start) AS first_id
  FROM hashed
), later AS (
  SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM ranked WHERE place > 1
), island AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS no FROM later
), span AS (SELECT doc_id, no, min(start) AS start, max(stop) AS stop FROM island GROUP BY ALL),
kept AS (
  SELECT doc_id, no, start, stop, substr(text, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY no) + 1,
    start - lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY no)) AS piece FROM span JOIN documents USING (doc_id)
), told AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(start || ':' || stop, ',' ORDER BY no) AS removed,
    string_agg(piece, '' ORDER BY no) AS front, max(stop) AS done FROM kept GROUP BY doc_id
), origin AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(first_id))), ',') AS copied_from FROM later GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(copied_from, '') AS copied_from,
  sha256(coalesce(front || substr(text, done + 1), text, '')) AS clean_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN origin USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b, n = c AND m = c AS same FROM shared WHERE 100 * c >= 85 * (n + m - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
classes AS (SELECT b AS doc_id, min(a) AS class_id FROM links WHERE same GROUP BY b)
SELECT doc_id, len(s) AS n_shingles, coalesce(class_id, doc_id) AS class_id, component_id, doc_id = component_id AS kept
FROM sets JOIN roots USING (doc_id) LEFT JOIN classes USING (doc_id)
"""

OP9 = rf"""
WITH rules(rule_host, rule_path, own) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, own,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(own, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""

OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > least, false)::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM judged GROUP BY ALL),
letter(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letter p, letter q, letter r, letter s, letter t WHERE p.b | q.b | r.b | s.b | t.b = 31
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) r(step)
), found AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    sum(n) FILTER (fails & (before | own) = 0) AS kept, sum(n) FILTER (fails & own > 0 AND fails & before = 0) AS removed,
    sum(n) FILTER (fails & own > 0 AND fails & before > 0) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
    sum(g) FILTER (fails & own > 0 AND fails & before = 0) AS good_lost, sum(x) FILTER (fails & own > 0 AND fails & before = 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found
"""

ORACLE_SQL = {"op3_exact_dedup": OP3, "op7_line_dedup": OP7, "op8_minhash": OP8, "op9_url_filter": OP9, "op11_filter_audit": OP11}
