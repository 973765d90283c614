"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINE_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS tri FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, tri) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) x(k) GROUP BY r),
base AS (SELECT w.r, doc_id, host, text, ls, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover ON cover.r = w.r),
texts AS (SELECT DISTINCT host, text FROM documents_ ),
lines AS (SELECT host, text, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h FROM (SELECT host, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS l FROM texts WHERE text IS NOT NULL)),
freq AS (SELECT f.host, h FROM (SELECT host, h, count(DISTINCT text) AS n FROM lines GROUP BY ALL) f WHERE n > 10),
lost AS (SELECT host, text, sum(len({_WORDS.format('l')}))::BIGINT AS removed_words, count(*) AS removed_lines FROM lines x WHERE EXISTS (SELECT 1 FROM freq f WHERE f.h = x.h AND f.host IS NOT DISTINCT FROM x.host) GROUP BY ALL),
out AS (SELECT base.*, coalesce(removed_words, 0) AS removed_words, coalesce(removed_lines, 0) AS removed_lines FROM base LEFT JOIN lost ON lost.host IS NOT DISTINCT FROM base.host AND lost.text IS NOT DISTINCT FROM base.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < n_words * 0.3) AS kept, removed_lines, removed_words FROM out
""".replace("documents_ ", "(SELECT source AS host, text FROM documents)")

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i : i + least(5, len(ws)) - 1], chr(1)) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-6),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a, min(doc_id) AS class_id FROM reach JOIN w ON w.r = reach.b GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM w JOIN class ON class.a = w.r LEFT JOIN links ON links.a = w.r
"""

ORACLES = {"op3_jaccard_join": JACCARD_JOIN, "op5_line_quality": LINE_QUALITY}
