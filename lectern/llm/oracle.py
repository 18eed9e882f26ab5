"""DuckDB SQL of the training-data queries that SQL can express in reasonable time on the small tables."""

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

PHRASES = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
earliest AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN earliest USING (s) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1)::BIGINT AS i FROM w),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

LINKS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
earliest AS (SELECT s, min((doc_id, i)) AS m FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win JOIN earliest USING (s) WHERE m <> (doc_id, i)),
run AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM hit),
grp AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run),
span AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM grp GROUP BY doc_id, g),
cut AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, sum(e - s)::BIGINT AS gone, count(*) AS spans FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, h, gone, spans, CASE WHEN gone IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(ss) + 2), lambda k: substr(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE es[k - 1] END) + 1,
  2 * ((CASE WHEN k > len(ss) THEN length(h) // 2 ELSE ss[k] END) - (CASE WHEN k = 1 THEN 0 ELSE es[k - 1] END)))), '') END AS rest FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

SQL = {"op3_suffix_dedup": BYTES, "op6_exact_dedup": EXACT, "op7_phrase_dedup": PHRASES, "op8_jaccard_join": LINKS}
