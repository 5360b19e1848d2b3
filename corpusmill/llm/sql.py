"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: The words of a text: longest runs of letters and digits, in lower case.
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

SQL["p3_found"] = f"""
WITH w AS (SELECT row_seq, {_WORDS.format('article_text')} AS w FROM cleaned_articles WHERE article_text IS NOT NULL),
s AS (SELECT DISTINCT row_seq, hash(w[i], w[i + 1], w[i + 2]) AS h FROM w, unnest(range(1, len(w) - 1)) AS t(i)),
n AS (SELECT row_seq, count(*) AS n FROM s GROUP BY row_seq),
p AS (SELECT a.row_seq AS a, b.row_seq AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.row_seq < b.row_seq GROUP BY ALL)
SELECT a AS row_seq_a, b AS row_seq_b FROM p JOIN n x ON x.row_seq = a JOIN n y ON y.row_seq = b WHERE c >= 0.5 * (x.n + y.n - c)
"""

_URI = r"nullif(nullif(nullif(nullif(lower(regexp_replace(uri, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), ''), 'nan'), 'none'), '<na>')"

SQL["p1_found"] = f"""
WITH e AS (SELECT bench_row_id AS id, {_URI} AS u, {_WORDS.format('article_text')} AS w FROM human_benchmark_split),
t AS (SELECT silver_row_id AS id, {_URI} AS u, {_WORDS.format('article_text')} AS w FROM silver),
es AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM e, unnest(range(1, len(w) - 1)) AS x(i)),
ts AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM t, unnest(range(1, len(w) - 1)) AS x(i)),
en AS (SELECT id, count(*) AS n FROM es GROUP BY id),
tn AS (SELECT id, count(*) AS n FROM ts GROUP BY id),
p AS (SELECT es.id AS a, ts.id AS b, count(*) AS c FROM es JOIN ts USING (h) GROUP BY ALL)
SELECT a AS bench_row_id, b AS silver_row_id FROM p JOIN en ON en.id = a JOIN tn ON tn.id = b WHERE c >= 0.5 * (en.n + tn.n - c)
UNION
SELECT e.id, t.id FROM e JOIN t USING (u)
"""

SQL["p8_found"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS x(k)),
h AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS x(k))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g)
"""

SQL["p1_report"] = f"""
WITH e AS (SELECT bench_row_id AS id, evaluation_split AS split, source_uri AS source, {_URI} AS u, {_WORDS.format('article_text')} AS w FROM human_benchmark_split),
t AS (SELECT silver_row_id AS id, {_URI} AS u, {_WORDS.format('article_text')} AS w FROM silver),
es AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM e, unnest(range(1, len(w) - 1)) AS x(i)),
ts AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM t, unnest(range(1, len(w) - 1)) AS x(i)),
en AS (SELECT id, count(*) AS n FROM es GROUP BY id),
tn AS (SELECT id, count(*) AS n FROM ts GROUP BY id),
p AS (SELECT es.id AS a, ts.id AS b, count(*) AS c FROM es JOIN ts USING (h) GROUP BY ALL),
alike AS (SELECT a, b, false AS by_uri, c / (en.n + tn.n - c) AS s FROM p JOIN en ON en.id = a JOIN tn ON tn.id = b WHERE c >= 0.5 * (en.n + tn.n - c)),
met AS (SELECT a, b, bool_or(by_uri) AS by_uri, max(s) AS s FROM (SELECT * FROM alike UNION ALL SELECT DISTINCT e.id, t.id, true, NULL FROM e JOIN t USING (u)) GROUP BY a, b)
SELECT split, source, count(*) AS pairs, count(DISTINCT a) AS eval_records, count(DISTINCT b) AS train_records, count(*) FILTER (by_uri) AS same_uri,
  count(*) FILTER (s = 1) AS same_text, count(*) FILTER (s < 1) AS near_text
FROM met JOIN e ON e.id = a GROUP BY split, source
"""

SQL["p8_spans"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS x(k)),
h AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS x(k)),
met AS (SELECT doc_id, item_id, k FROM g JOIN h USING (g))
SELECT doc_id, item_id, CAST(min(k) - 1 AS INTEGER) AS first_word, CAST(count(DISTINCT k + o) AS INTEGER) AS words FROM met, unnest(range(12)) AS y(o) GROUP BY doc_id, item_id
"""

SQL["p3_groups"] = f"""
WITH RECURSIVE w AS (SELECT row_seq, {_WORDS.format('article_text')} AS w FROM cleaned_articles WHERE article_text IS NOT NULL),
s AS (SELECT DISTINCT row_seq, hash(w[i], w[i + 1], w[i + 2]) AS h FROM w, unnest(range(1, len(w) - 1)) AS t(i)),
sets AS (SELECT row_seq, list(h ORDER BY h) AS k FROM s GROUP BY row_seq),
keyed AS (SELECT row_seq, sets.k, CASE WHEN sets.k IS NULL THEN w END AS short FROM w LEFT JOIN sets USING (row_seq) WHERE len(w) > 0),
named AS (SELECT row_seq, min(row_seq) OVER (PARTITION BY k, short) AS class_id, count(*) OVER (PARTITION BY k, short) AS class_size FROM keyed),
c AS (SELECT DISTINCT class_id FROM named),
cs AS (SELECT s.row_seq AS id, h FROM s JOIN c ON c.class_id = s.row_seq),
n AS (SELECT id, count(*) AS n FROM cs GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM cs a JOIN cs b ON a.h = b.h AND a.id <> b.id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.5 * (x.n + y.n - c)),
reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT row_seq, class_id, class_size, coalesce(l.n, 0) AS links, g.group_id FROM named
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = class_id JOIN (SELECT a, min(b) AS group_id FROM reach GROUP BY a) g ON g.a = class_id
"""

SQL["p8_clean"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('item_text')} AS w FROM eval_items),
g AS (SELECT DISTINCT array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS x(k)),
h AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS x(k)),
gone AS (SELECT DISTINCT doc_id, k + o AS i FROM g JOIN h USING (g), unnest(range(12)) AS y(o)),
hit AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
parts AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS p FROM documents JOIN hit USING (doc_id)),
piece AS (SELECT doc_id, n, p[n] AS p, regexp_matches(p[n], '^[\\p{{L}}\\p{{N}}]') AS w FROM parts, unnest(range(1, len(p) + 1)) AS x(n)),
numbered AS (SELECT *, sum(w::INT) OVER (PARTITION BY doc_id ORDER BY n) AS i FROM piece),
marked AS (SELECT x.*, a.i IS NOT NULL AND (w OR b.i IS NOT NULL) AS out FROM numbered x LEFT JOIN gone a ON a.doc_id = x.doc_id AND a.i = x.i LEFT JOIN gone b ON b.doc_id = x.doc_id AND b.i = x.i + 1),
left_over AS (SELECT doc_id, coalesce(string_agg(p, '' ORDER BY n) FILTER (NOT out), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN hit.n IS NULL THEN text ELSE t END AS text, CAST(coalesce(hit.n, 0) AS INTEGER) AS removed_words
FROM documents LEFT JOIN hit USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
