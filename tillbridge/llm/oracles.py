"""SQL for the corpus queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BLANKED = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

OP11 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {BLANKED} AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), classes AS (SELECT list_sort(s) AS s, min(doc_id) AS id, list(doc_id) AS ids FROM s WHERE len(s) > 0 GROUP BY 1
), e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM classes
), pairs AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT id, unnest(ids) AS doc_id FROM classes) c ON c.doc_id = s.doc_id LEFT JOIN least ON least.id = c.id
"""

OP12 = f"""
WITH d AS (
  SELECT doc_id, {TERMS} AS words FROM documents
), s AS (SELECT doc_id, words, len(words)::BIGINT AS n, count(*) OVER () AS docs, (sum(len(words)) OVER ())::BIGINT AS length FROM d WHERE len(words) > 0
), t AS (SELECT doc_id, docs, 25 + (75 * n * docs) // length AS m, unnest(words) AS term FROM s
), p AS (SELECT doc_id, docs, m, term, count(*) AS tf FROM t GROUP BY ALL
), i AS (
  SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

OP13 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))
), ids AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1
), h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda k: ascii(k)::BIGINT), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) % 6 AS h
  FROM ids, bytes
), r AS (
  SELECT h.conv_id, t.pos AS d, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL
  SELECT h.conv_id, t.pos - h.h + least(h.h, coalesce(ids.n, 0)), role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h LEFT JOIN ids ON ids.conv_id = h.base
), m AS (
  SELECT conv_id, d, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path, text FROM r
  UNION ALL
  SELECT conv_id, 0, CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]), '' FROM ids
), nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(length(text)) AS shared FROM m GROUP BY path, d
), kids AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1
), flat AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (path)
), below AS (SELECT list_slice(path, 1, u) AS path, sum(shared) AS saved, sum((k = 0)::INT) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM flat) GROUP BY 1
), ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(path, d) AS path FROM m GROUP BY 1) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM flat f JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON f.d > 0 AND p.path = list_slice(f.path, 1, f.d - 1)
"""

SQL: dict[str, str] = {"op11_jaccard_join": OP11, "op12_ranked_search": OP12, "op13_prefix_trie": OP13}
