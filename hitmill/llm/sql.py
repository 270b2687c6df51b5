"""DuckDB SQL with the results expected of the queries."""

from hitmill.llm import licenses, lines

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END
    ) AS g FROM words
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
    SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
    WHERE 100 * c >= 90 * (s.n + t.n - c)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

_BARE = "trim({}, ' ' || chr(9) || chr(13))"

LINE_DEDUP = rf"""
WITH pages_text AS MATERIALIZED (
    SELECT page_id, nullif(lower(regexp_replace(regexp_extract(url, '{lines.HOST}', 1), '\.$', '')), '') AS host,
        regexp_replace(regexp_replace(regexp_replace(html, '{lines.HIDDEN}', '', 'g'), '{lines.BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g') AS text
    FROM pages
), line AS (
    SELECT DISTINCT host, page_id, {_BARE.format("l")} AS l FROM (SELECT host, page_id, unnest(string_split(text, chr(10))) AS l FROM pages_text)
), totals AS (
    SELECT host, count(*) AS pages FROM pages_text WHERE host IS NOT NULL GROUP BY host
), boilerplate AS (
    SELECT host, list(l) AS dropped FROM (
        SELECT host, l, count(*) AS n FROM line WHERE l <> '' GROUP BY host, l
    ) JOIN totals USING (host) WHERE n > 1 AND n > {lines.RATIO} * pages GROUP BY host
), cut AS (
    SELECT page_id, p.host, string_split(text, chr(10)) AS every, coalesce(dropped, []) AS dropped
    FROM pages_text p LEFT JOIN boilerplate b ON p.host = b.host
), kept AS (
    SELECT page_id, host, every, list_filter(every, lambda l: {_BARE.format("l")} = '' OR NOT list_contains(dropped, {_BARE.format("l")})) AS rest FROM cut
)
SELECT page_id, host, len(every)::BIGINT AS n_lines, greatest(len(rest), 1)::BIGINT AS n_kept, array_to_string(rest, chr(10)) AS text FROM kept
"""

_PHRASES = ", ".join(f"('{label}', {phrase.split()})" for label, phrase in licenses.PHRASES.items())
_TEMPLATES = ", ".join(
    f"('{label}', {licenses.template_words(text)}, {licenses.template_words(must)}, {licenses.span(text)})" for label, text, must in licenses.TEMPLATES
)
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LICENSES = rf"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS t FROM documents
), cut AS MATERIALIZED (
    SELECT r, doc_id, {_WORDS.format("t")} AS w FROM docs
), place AS (
    SELECT r, label, spot FROM (
        SELECT r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS spot
        FROM cut, (VALUES {_PHRASES}) v(label, p) WHERE list_has_all(w, p)
    )
), base AS (
    SELECT r, count(*) AS n, min(spot) AS lo, max(spot) AS hi, list(DISTINCT label) AS labels FROM place GROUP BY r
), paragraphs AS MATERIALIZED (
    SELECT r, {_WORDS.format("l")} AS w FROM (SELECT r, unnest(string_split_regex(t, '{licenses.BLANK}')) AS l FROM docs)
), blocks AS (
    -- Every stretch of the template's length that begins at one of its words.
    SELECT r, label, p, must, len(list_intersect(w[i : i + size - 1], p)) AS held, len(list_intersect(w[i : i + size - 1], must)) AS kept
    FROM (
        SELECT r, w, label, p, must, size, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(p, w[i]))) AS i
        FROM paragraphs, (VALUES {_TEMPLATES}) v(label, p, must, size)
        WHERE {licenses.CONTAINMENT[1]} * len(list_intersect(w, p)) >= {licenses.CONTAINMENT[0]} * len(p)
    )
), met AS (
    SELECT r, list(DISTINCT label) AS labels, max(held / len(p)) AS c
    FROM blocks WHERE {licenses.CONTAINMENT[1]} * held >= {licenses.CONTAINMENT[0]} * len(p) AND kept = len(must) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
    array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
    CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM cut LEFT JOIN base b USING (r) LEFT JOIN met m USING (r)
"""
