"""SQL of the queries that SQL can express on whole tables, run by DuckDB."""

from __future__ import annotations

import re

from siftwork.llm.quality import BULLET, CUT, RATIOS, RULES, STOP_WORDS

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OF = {k: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END" for k, (a, b) in RATIOS.items()} | {"n_words": "n_words"}
_FAILS = ",\n    ".join(f"CASE WHEN NOT ({_OF[r.measure]} {r.keep} {r.threshold}) THEN '{r.name}' END" for r in RULES)
_STOP = r"\A(?:" + "|".join(STOP_WORDS) + r")(?:\z|[.,;:!?])"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RE2 = lambda rule: re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", rule)

ORACLES["op8_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '{_RE2(BULLET)}'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '{_RE2(CUT)}'))) AS n_cut_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches({_LOWER.format("x")}, '{_STOP}'))) AS n_stop_words
  FROM d LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, list_filter([{_FAILS}], lambda x: x IS NOT NULL) AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  len(failures) = 0 AND NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS kept,
  array_to_string(failures, ',') AS failed
FROM f
"""

ORACLES["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), hosts AS (
  SELECT host, NOT bool_or(lower(substr(url, 1, 8)) = 'https://') AS listed FROM p WHERE host <> '' GROUP BY host
), r AS (
  SELECT page_id, p.host, path, coalesce(listed, false) AS listed, CASE
    WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN hosts ON p.host = hosts.host
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

ORACLES["op7_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT doc_id, i, x[i] || chr(10) || x[i + 1] || chr(10) || x[i + 2] AS g
  FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) - 2)) AS i FROM d)
), o AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM p WHERE regexp_matches(g, '[^\x20\x09-\x0D]')) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, i + k AS i FROM o, (VALUES (0), (1), (2)) AS t(k)
), k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept, count(*) AS n
  FROM (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(generate_series(1, len(x))) AS i FROM d)) AS l
  ANTI JOIN c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id
)
SELECT t.doc_id, coalesce(len(x), 0)::BIGINT AS n_lines, (coalesce(len(x), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents t LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""

ORACLES["op1_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)
), o AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM p) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, i + k AS i FROM o, (SELECT unnest(generate_series(0, 19)) AS k) AS t
), k AS (
  SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.i) AS kept, count(*) AS n
  FROM (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)) AS e
  ANTI JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLES["op6_chat_tree"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    length(regexp_replace(role, '(\\|###|</turn>|:)', '_\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '_\1', 'g')) + 14 AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES["op10_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), bi AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT reach.id, bi.y FROM reach JOIN bi ON bi.x = reach.r
), comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Running sums over whole hashes in place of buckets; equal hashes go in or stay out together.
ORACLES["op9_source_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER full_before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER full_before, 0)) AS reach, most / w AS level
  FROM weighed WINDOW full_before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN common IS NULL OR level <= common THEN most ELSE common * w END AS target
  FROM (SELECT *, max(CASE WHEN reach <= level THEN reach END) OVER () AS common FROM levels)
), repeated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12)::BIGINT ELSE 0 END AS whole FROM goals
), steps AS (
  SELECT source, h, sum(size)::BIGINT AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d WHERE size > 0 GROUP BY source, h
), judged AS (
  SELECT steps.source, h, target - whole * source_size AS rest, upto, steps.size AS size FROM steps JOIN repeated ON steps.source IS NOT DISTINCT FROM repeated.source
), added AS (
  -- all before the budget's end, and the one in which it ends if that comes nearer
  SELECT source, h FROM judged WHERE upto <= rest OR (upto - size <= rest AND 2 * (rest - (upto - size)) > size)
)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN least(2, whole + CASE WHEN added.h IS NULL THEN 0 ELSE 1 END) ELSE 0 END * size)::BIGINT AS taken
FROM d JOIN repeated ON d.source IS NOT DISTINCT FROM repeated.source LEFT JOIN added ON d.source IS NOT DISTINCT FROM added.source AND d.h = added.h"""
