"""DuckDB SQL for the operators that SQL can express over whole tables."""

from .quality_rules import MAX_RATE, MAX_REPEAT, MAX_SYMBOL_RATIO, MIN_WORDS

QUALITY_RULES = rf"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
measured AS (SELECT s.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR n_symbols > {MAX_SYMBOL_RATIO} * n_words) AS failures FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT least(greatest(avg(failures / docs), 0.001), 0.999) AS m, var_pop(failures / docs) AS v, avg(docs) AS d, avg(1 / docs) AS inv FROM hosts),
prior AS (SELECT m, least(greatest(CASE WHEN v - m * (1 - m) * inv > 0 THEN m * (1 - m) / (v - m * (1 - m) * inv) - 1 ELSE d END, 1), 1000000) AS w FROM moments),
rates AS (SELECT source, (failures + m * w) / (docs + w) AS rate, docs + w AS total FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > {MAX_RATE}, false) AS kept, round(coalesce(rate, 0), 6) AS host_rate
FROM judged LEFT JOIN rates USING (source)
"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = rf"""
WITH b AS (SELECT item_id, {_FOLDED} AS ws FROM benchmark), d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
places AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized))),
hits AS (SELECT doc_id, item_id, n, i FROM places JOIN wanted USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id),
-- Proximity: from a place within two of where the window's rarest word says, every word stands within two of its place.
tokens AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
counted AS (SELECT w, count(*) AS c FROM tokens GROUP BY w),
parts AS (SELECT DISTINCT item_id, n, g, j, split_part(g, ' ', j) AS w FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM wanted)),
rarest AS (SELECT item_id, n, g, min_by(j, (c, j)) AS j, min_by(w, (c, j)) AS w FROM (SELECT p.*, coalesce(c, 0) AS c FROM parts p LEFT JOIN counted USING (w)) GROUP BY ALL),
tried AS (SELECT DISTINCT doc_id, item_id, n, g, i - j + shift AS place FROM tokens JOIN rarest USING (w), (SELECT unnest(range(-2, 3)) AS shift)),
close AS (SELECT DISTINCT doc_id, item_id FROM (SELECT t.*, string_split(g, ' ') AS gs, ws FROM tried t JOIN d USING (doc_id))
  WHERE len(list_filter(range(1, n + 1), lambda j: list_contains(ws[greatest(place + j - 2, 1) : greatest(place + j + 2, 0)], gs[j]))) = n),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS near_ids FROM close WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
