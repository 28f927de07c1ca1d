"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from recallgrid.llm.line_dedup import MAX_RATIO, MIN_PAGES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLACK = r"[^\x20\x09-\x0D]"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT DISTINCT source, text, ls FROM d),
t AS (SELECT source, count(*) AS total FROM p GROUP BY source),
l AS (SELECT source, unnest(list_distinct(ls)) AS line FROM p),
bad AS (
  SELECT l.source, l.line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  WHERE regexp_matches(l.line, '{BLACK}')
  GROUP BY l.source, l.line, t.total
  HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO} * t.total),
b AS (SELECT source, list(line) AS bs FROM bad GROUP BY source),
k AS (
  SELECT d.doc_id, d.source, d.text, ls,
         list_filter(ls, lambda x: NOT regexp_matches(x, '{BLACK}') OR NOT list_contains(coalesce(bs, []), x)) AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
       CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped
FROM k
"""

QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{BLACK}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{BLACK}')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, CAST(len(ws) - 3 AS BIGINT))) AS i, ws FROM d WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS win FROM g),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM h),
covered AS (SELECT DISTINCT doc_id, i + unnest(range(0, 5)) AS p FROM twice WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
s AS (
  SELECT d.doc_id, d.text, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_symbols > n_words
            OR 10 * (n_lines - n_dup_lines) < 3 * n_lines OR NOT regexp_matches(coalesce(text, ''), '\\pL')) AS kept
FROM v
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace(
    "{u}", UPPER
).replace("{l}", LOWER)

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(ws), 13) AS size, array_to_string(ws[i : i + 12], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, CAST(greatest(len(ws) - 12, 1) + 1 AS BIGINT))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM w),
g AS (
  SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, CAST(len(ws) - size + 2 AS BIGINT))) AS i
        FROM d, sizes WHERE len(ws) >= size)),
m AS (SELECT g.doc_id, g.i, g.size, w.item FROM g JOIN w ON g.size = w.size AND g.win = w.win),
hits AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, i + unnest(range(0, CAST(size AS BIGINT))) AS p FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL = {
    "op4_line_dedup": LINE_DEDUP,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op9_quality_rules": QUALITY_RULES,
}
