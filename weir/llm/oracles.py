"""DuckDB SQL for the operators that SQL can express at the small scale, over whole tables."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS x FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM i WHERE len(ws) > 0)),
place AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT doc_id, item_id, k, place.n FROM place JOIN win ON win.n = place.n AND x = array_to_string(ws[k:k + place.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
place AS (SELECT doc_id, k, sha256(array_to_string(ws[k:k + 49], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS k FROM d WHERE len(ws) >= 50)),
first AS (SELECT x, min(doc_id) AS f FROM place GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM place JOIN first USING (x) WHERE doc_id > f),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_PLAIN} AS ws FROM documents),
line AS (SELECT doc_id, source, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS p FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE len(p) > 0 GROUP BY 1),
mine AS (SELECT doc_id, source, array_to_string(p, ' ') AS x, sum(len(p)) AS n FROM line WHERE len(p) > 0 GROUP BY ALL),
often AS (SELECT source, x FROM (SELECT source, x, count(DISTINCT doc_id) AS c FROM mine GROUP BY 1, 2) JOIN (SELECT source, count(DISTINCT doc_id) AS h FROM d GROUP BY 1) USING (source) WHERE c > 10 AND c > 0.01 * h),
gone AS (SELECT doc_id, sum(n) AS n FROM mine JOIN often USING (source, x) GROUP BY 1),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 2], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM d WHERE len(ws) > 2)),
twice AS (SELECT doc_id, x FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM win JOIN twice USING (doc_id, x)) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_frequent_words
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words > 0 AND 2 * n_frequent_words > n_words AS depleted,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words > 0 AND 2 * n_frequent_words > n_words) AS kept FROM m""",
}
