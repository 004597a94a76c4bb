"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"""list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_COPIES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
q AS (SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g
      FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, md5_number_lower(g) AS g FROM q WHERE i <= greatest(1, n - 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, min(c) = d.doc_id AS kept
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN k ON k.a = vec_id
"""

LINES = f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM p),
l AS (SELECT doc_id, i, line, list_sort(list_distinct({WORDS.format(text="lower(line)")})) AS k FROM q),
s AS (SELECT k, len(k) AS n, min((doc_id, i)) AS first FROM l WHERE len(k) > 0 GROUP BY k),
u AS (SELECT row_number() OVER (ORDER BY first) AS id, * FROM s),
t AS (SELECT id, n, unnest(k) AS tok FROM u),
f AS (SELECT tok, count(*) AS f FROM t GROUP BY 1),
x AS (SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY f, tok) AS pos FROM t JOIN f USING (tok)),
y AS (SELECT id, n, tok FROM x WHERE pos <= n - ceil(n * 80 / 100.0 - 1e-9) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM y a JOIN y b USING (tok) WHERE a.id < b.id AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.8 - 1e-9),
z AS (SELECT a, b, len(list_intersect(ua.k, ub.k)) AS m, ua.n + ub.n AS total FROM c JOIN u ua ON ua.id = a JOIN u ub ON ub.id = b),
g AS (SELECT DISTINCT b AS id FROM z WHERE 100 * m >= 80 * (total - m)),
o AS (SELECT l.*, len(l.k) = 0 OR ((l.doc_id, l.i) = u.first AND g.id IS NULL) AS stays FROM l LEFT JOIN u ON u.k = l.k LEFT JOIN g ON g.id = u.id)
SELECT d.doc_id, any_value(CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END) AS text,
       coalesce(any_value(j.n_lines), 0) AS n_lines, coalesce(any_value(j.n_removed), 0) AS n_removed
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (stays) AS text, count(*) FILTER (len(k) > 0) AS n_lines,
       count(*) FILTER (NOT stays) AS n_removed FROM o GROUP BY 1) j USING (doc_id) GROUP BY d.doc_id
"""

PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS n FROM w WHERE len(w) > 0),
i AS (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s WHERE len(w) >= n),
f AS (SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase, count(*) AS a FROM i GROUP BY ALL),
t AS (SELECT lang, sum(a) AS total FROM f WHERE n = 1 GROUP BY 1),
c AS (SELECT lang, n, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND a >= 30),
k AS (SELECT *, unnest(range(1, n)) AS k FROM c),
u AS (SELECT k.lang, k.n, k.phrase, k.a, k.k, x.a AS l, y.a AS r, (2000000::HUGEINT * k.a) // (x.a::HUGEINT + y.a) AS score FROM k
      JOIN f x ON x.lang = k.lang AND x.n = k.k AND x.phrase = array_to_string(k.w[1:k.k], ' ')
      JOIN f y ON y.lang = k.lang AND y.n = k.n - k.k AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, n, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, w, n, a, unnest(range(2, n)) AS m FROM c WHERE n > 2),
h AS (SELECT lang, w, m, a, unnest(range(1, n - m + 2)) AS i FROM g),
o AS (SELECT lang, m AS n, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM h GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, n, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z JOIN t USING (lang) QUALIFY rank <= 2000
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
