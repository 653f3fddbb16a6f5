"""SQL that checks the queries that SQL can express."""

from .topk import TOP_K_SQL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"

DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

LINE_DEDUP_SQL = r"""
WITH e AS (SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')),
f AS (SELECT *, list_filter(regexp_split_to_array(lower(line), '\s+'), lambda x: x <> '') AS words FROM e), g AS (SELECT doc_id, no, line, array_to_string(words, ' ') AS form, len(words) >= 1 AS counts FROM f),
firsts AS (SELECT form, min(row(doc_id, no)) AS first FROM g WHERE counts GROUP BY form),
m AS (SELECT g.*, counts AND first <> row(doc_id, no) AS gone, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g LEFT JOIN firsts USING (form)),
r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone) AS left_, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, string_agg(concat(start, '-', start + length(line)), ',' ORDER BY no) FILTER (WHERE gone) AS removed FROM m GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(left_, '') END AS text, coalesce(n_units, 0)::INT AS n_units, coalesce(n_removed, 0)::INT AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN r USING (doc_id)
"""

SUFFIX_DEDUP_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT *, length(h) // 2 AS n FROM d),
s AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)),
f AS (SELECT w, min(doc_id) AS least_doc FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
g AS (SELECT s.doc_id, i, lag(i) OVER (PARTITION BY s.doc_id ORDER BY i) AS p FROM s JOIN f USING (w) WHERE least_doc < s.doc_id),
k AS (SELECT *, sum(CASE WHEN i - p <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run), q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, concat(string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a), substring(any_value(h), 2 * max(b) + 1)) AS kept FROM q JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN t USING (doc_id)
"""

ORACLES = {"op4_decontamination": DECONTAMINATION_SQL, "op6_topk": TOP_K_SQL, "op7_line_dedup": LINE_DEDUP_SQL, "op10_suffix_dedup": SUFFIX_DEDUP_SQL}
