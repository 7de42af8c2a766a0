"""DuckDB SQL for the queries that SQL can express in full, written from their definitions.

The others learn models, tokenise, pack or compare by edit distance; tests hold them against plain versions.
"""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda x: x <> '')"


OP2 = rf"""
WITH d AS (SELECT doc_id, {words(LOWER, r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT item_id, {words(LOWER, r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.n, dw.k, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.x = win.x),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM hits)) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER, SPACE)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT meet.a, meet.b FROM meet JOIN size x ON x.doc_id = meet.a JOIN size y ON y.doc_id = meet.b WHERE 100 * m >= 90 * (x.n + y.n - m)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, {words("coalesce(text, '')", SPACE)} AS w FROM documents),
m AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, k, w[k : k + 7] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS k FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(k, k + 7)) AS p FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(lines) AS x FROM m),
norm AS (SELECT doc_id, host, len({words("x", SPACE)}) AS n, regexp_replace(regexp_replace(lower(trim(x)), '\s+', ' ', 'g'), '[0-9]+', '0', 'g') AS x FROM l),
often AS (SELECT host, x FROM (SELECT DISTINCT doc_id, host, x FROM norm) GROUP BY host, x HAVING count(*) > 50),
left_ AS (SELECT norm.doc_id, sum(norm.n) FILTER (WHERE often.x IS NULL) AS n FROM norm LEFT JOIN often ON norm.host = often.host AND norm.x = often.x GROUP BY norm.doc_id),
o AS (
  SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(left_.n, 0) AS BIGINT) AS n_kept_words
  FROM m LEFT JOIN rep USING (doc_id) LEFT JOIN left_ USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_kept_words >= 0.5 * n_words AND n_kept_words >= 20 AS kept
FROM o
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS x FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS k FROM d WHERE length(h) >= 100)),
hit AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY x) AS first FROM s) WHERE first < doc_id),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY doc_id, run),
r AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN r USING (doc_id)
"""

#: The checksum is the usual one of 32 bits (reflected polynomial EDB88320), by its table, over the bytes of `<id>:<run>`.
OP11 = rf"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
runs AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 5 GROUP BY doc_id, r),
bytes AS (SELECT doc_id, r, n, hex(encode(concat(CAST(doc_id AS VARCHAR), ':', r))) AS h FROM runs),
sums AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST(concat('0x', substr(h, CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS crc FROM bytes, crc_table),
slips AS (SELECT CASE WHEN crc % 97 = 0 THEN concat(substr(r, 1, crc % length(r)), substr(r, crc % length(r) + 2)) ELSE r END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, length(word) AS len, k, concat(substr(word, 1, k), substr(word, k + 2)) AS less FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (
  SELECT DISTINCT c.word, c.n, w.word AS near, w.n AS near_n FROM cuts c JOIN words w ON w.word = c.less
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.less
  UNION SELECT c.word, c.n, e.word, e.n FROM cuts c JOIN cuts e ON c.less = e.less AND c.k = e.k AND c.word <> e.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near COLLATE "C") AS near, max(near_n) AS near_n FROM near GROUP BY word),
o AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps(word, here) AS (SELECT word, form FROM o WHERE form IS NOT NULL UNION SELECT steps.word, o.form FROM steps JOIN o ON o.word = steps.here WHERE o.form IS NOT NULL),
ends AS (SELECT steps.word, steps.here AS root FROM steps JOIN o ON o.word = steps.here WHERE o.form IS NULL)
SELECT o.word, form, coalesce(root, o.word) AS root, n, n_near, form_n FROM o LEFT JOIN ends USING (word)
"""

OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER, SPACE)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT x, count(*) AS c FROM s GROUP BY x),
ranked AS (SELECT s.doc_id, s.x, row_number() OVER (PARTITION BY s.doc_id ORDER BY c, s.x) AS k, n FROM s JOIN often USING (x) JOIN size USING (doc_id)),
lead_ AS (SELECT doc_id, x FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM lead_ a JOIN lead_ b ON a.x = b.x AND a.doc_id < b.doc_id),
meet AS (SELECT a, b, count(*) AS m FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.x = x.x GROUP BY a, b),
half AS (SELECT meet.a, meet.b FROM meet JOIN size x ON x.doc_id = meet.a JOIN size y ON y.doc_id = meet.b WHERE 100 * m >= 80 * (x.n + y.n - m)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, c IS NULL OR c >= d.doc_id AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_decontamination": OP2, "op5_suffix_dedup": OP5, "op9_jaccard_join": OP9, "op10_quality_rules": OP10, "op11_spelling_variants": OP11, "op13_minhash": OP13}
