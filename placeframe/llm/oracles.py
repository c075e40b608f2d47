"""DuckDB SQL for the queries of this subpackage that SQL can express; plain and slow, meant for small tables."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, (2 * p + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
f AS (SELECT DISTINCT doc_id, p FROM w JOIN m USING (s) WHERE least < doc_id),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS begins FROM f),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT r.doc_id, a, b, substr(h, (2 * lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) + 1)::BIGINT, (2 * (a - lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a)))::BIGINT) AS piece FROM r JOIN d USING (doc_id)),
j AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*)::BIGINT AS runs, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM k GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE coalesce(head, '') || substr(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM t"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""


#: Exact quantiles; the sketches hold every value of up to ``quality_rules.SKETCH_K`` rows, so on such tables both agree.
QUALITY_RULES = """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
e AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM g JOIN e USING (doc_id, g), range(5) r(k) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
m AS (SELECT doc_id, lang, source, 1 AS r, n_symbols AS a, word_chars AS b, 1.0::DOUBLE AS grain FROM b UNION ALL SELECT doc_id, lang, source, 2, n_dup_lines, n_lines, 1.0 FROM b UNION ALL SELECT doc_id, lang, source, 3, n_repeat_words, n_words, 10.0 FROM b UNION ALL SELECT doc_id, lang, source, 4, word_chars, n_words, NULL FROM b),
v AS (SELECT *, a::DOUBLE / greatest(b, 1) AS v FROM m),
s1 AS (SELECT lang, source, r, count(*) AS n, quantile_disc(v, [0.25, 0.4, 0.5, 0.6, 0.75]) AS q, quantile_disc(b, 0.5)::DOUBLE AS long FROM v GROUP BY ALL),
s2 AS (SELECT lang, r, count(*) AS n, quantile_disc(v, [0.25, 0.4, 0.5, 0.6, 0.75]) AS q, quantile_disc(b, 0.5)::DOUBLE AS long FROM v GROUP BY ALL),
s3 AS (SELECT r, quantile_disc(v, [0.25, 0.4, 0.5, 0.6, 0.75]) AS q, quantile_disc(b, 0.5)::DOUBLE AS long FROM v GROUP BY ALL),
f AS (SELECT s1.lang, s1.source, s1.r, CASE WHEN s1.n >= 200 THEN s1.q WHEN s2.n >= 200 THEN s2.q ELSE s3.q END AS q, CASE WHEN s1.n >= 200 THEN s1.long WHEN s2.n >= 200 THEN s2.long ELSE s3.long END AS long FROM s1 JOIN s2 ON s1.lang IS NOT DISTINCT FROM s2.lang AND s1.r = s2.r JOIN s3 ON s1.r = s3.r),
k AS (SELECT v.*, q[3] AS mid, least(q[5] - q[3], (q[4] - q[3]) * 2.662::DOUBLE) AS up, least(q[3] - q[1], (q[3] - q[2]) * 2.662::DOUBLE) AS down, long FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.r = f.r),
x AS (SELECT doc_id, r, CASE WHEN grain IS NULL THEN v > mid + 8 * (up * greatest(1.0, sqrt(long / greatest(b, 1)))) OR v < mid - 8 * (down * greatest(1.0, sqrt(long / greatest(b, 1)))) ELSE v > mid + 8 * greatest(up, grain / greatest(least(long, b::DOUBLE), 1.0)) END AS broken FROM k),
y AS (SELECT doc_id, min(r) AS r FROM x WHERE broken GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND y.r IS NULL AS kept,
CASE WHEN n_words < 10 OR 100 * n_repeat_words > 20 * n_words THEN 'base' WHEN y.r = 1 THEN 'symbol_ratio' WHEN y.r = 2 THEN 'dup_line_ratio' WHEN y.r = 3 THEN 'repeat_ratio' WHEN y.r = 4 THEN 'word_length' END AS rule FROM b LEFT JOIN y ON y.doc_id = b.doc_id"""

FILTER_AUDIT = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
e AS (SELECT t, min(doc_id) AS least FROM t GROUP BY t),
w AS (SELECT doc_id, part, t, least, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM t JOIN e USING (t)),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id OR (doc_id IS NULL AND least IS NOT NULL), false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS gone, 1 << (ascii(filter_order[step]) - 65) AS bit
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
g AS (SELECT part, filter_order, step, f, n, good, toxic, mask = bit AS alone, (mask & bit) > 0 AS fails, (mask & coalesce(gone, 0)::BIGINT) > 0 AS before FROM h, s),
c AS (SELECT part, filter_order, step, f AS filter, sum(CASE WHEN NOT fails AND NOT before THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND before THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM c"""

TOPK_SEARCH = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, b.r AS other, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS t FROM documents), i AS (SELECT row_number() OVER () AS i, item_id, {_LOW} AS t FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d) GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r), c AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM n),
m AS (SELECT r, 75 + (25 * n * total) // length AS m FROM n, c),
f AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT i, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM i),
s AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank, doc_id, score FROM s JOIN d USING (r) JOIN i USING (i) WHERE score > 0 QUALIFY rank <= 20"""
