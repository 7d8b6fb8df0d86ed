"""SQL twins of the queries that SQL can express (DuckDB dialect)."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_BLANKS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 85 * (x.n + y.n - p.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

_FOLDED = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = f"""
WITH d AS (SELECT doc_id, {_FOLDED.format("coalesce(" + _LOWER.format('text') + ", '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLDED.format(_LOWER.format('text'))} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, least(13, len(w)) AS k, w FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM q),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
m AS (SELECT dw.doc_id, dw.i, dw.k, q.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw) dw JOIN q ON q.k = dw.k AND q.g = dw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP8 = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim({_LOWER.format('line')}, {_BLANKS}) AS norm FROM l),
b AS (SELECT norm, min(doc_id) AS first_doc FROM k WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT source) > 8),
f AS (SELECT k.*, b.norm IS NOT NULL AND k.doc_id <> b.first_doc AS gone FROM k LEFT JOIN b ON b.norm = k.norm)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, trim({_LOWER.format('line')}, {_BLANKS}) AS norm, len({_WORDS.format('line')}) AS words FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k GROUP BY doc_id),
common AS (SELECT source, norm FROM k GROUP BY source, norm HAVING count(DISTINCT doc_id) > 50),
gone AS (SELECT doc_id, sum(words) AS n FROM k JOIN common c ON c.norm = k.norm AND c.source IS NOT DISTINCT FROM k.source GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
t AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS common
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * (n_words - common) < 30 * n_words AS kept
FROM f
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
t AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM t) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) FILTER (gone.p IS NULL) AS kept, count(gone.p) AS n_removed
      FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.p = u.p GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES = {
    "op3_near_copies": OP3,
    "op6_benchmark_matches": OP6,
    "op8_site_boilerplate": OP8,
    "op9_quality_rules": OP9,
    "op10_repeated_passages": OP10,
}
