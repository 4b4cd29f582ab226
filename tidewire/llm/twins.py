"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import RATIOS

OP1 = r"""
WITH words AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), NULL, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT kind, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words),
win AS (SELECT DISTINCT id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT id, w, least(len(w), 8) AS n, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM w WHERE kind = 'i' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, sizes WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT doc_id, p, places.n AS n, id FROM places JOIN win ON win.s = places.s AND win.n = places.n),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) WHERE kind = 'd'
"""

_PAIRS = ", ".join(f"{{'k': '{k}', 'v': {k}}}" for k in RATIOS)
_BIN = "CASE WHEN p.v < 64 THEN p.v ELSE (p.v >> (length(bin(p.v)) - 6)) << (length(bin(p.v)) - 6) END"
_LEVEL = "SELECT {n} AS level, {lang} AS lang, {source} AS source, k, bin, sum(n) AS n FROM fine GROUP BY ALL"
_SPREAD = " ".join(f"WHEN k = '{k}' THEN {least}" for k, (least, _) in RATIOS.items())
_LOW = ", ".join(f"'{k}'" for k, (_, low) in RATIOS.items() if low)
_FINE = " AND ".join(f"{k} <= hi['{k}'] AND {k} >= coalesce(lo['{k}'], {k})" for k in RATIOS)
OP3 = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM tri WHERE n > 1) GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols_pm, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines_pm,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_words_pm, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_len_pc, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
fine AS (SELECT lang, source, p.k AS k, {_BIN} AS bin, count(*) AS n FROM (SELECT lang, source, unnest([{_PAIRS}]) AS p FROM f WHERE NOT base_failed) GROUP BY ALL),
sk AS ({_LEVEL.format(n=0, lang='lang', source='source')} UNION ALL {_LEVEL.format(n=1, lang='lang', source='NULL')} UNION ALL {_LEVEL.format(n=2, lang='NULL', source='NULL')}),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY level, lang, source, k) AS total FROM sk),
q AS (SELECT level, lang, source, k, max(total) AS total, min(bin) FILTER (cum * 4 >= total) AS q25, min(bin) FILTER (cum * 4 >= total * 3) AS q75 FROM c GROUP BY level, lang, source, k),
g AS (SELECT *, 3 * greatest(q75 - q25, CASE {_SPREAD} END) AS reach FROM q),
wide AS (SELECT level, lang, source, max(total) AS total, map(list(k), list(q75 + reach)) AS hi, map(list(k) FILTER (k IN ({_LOW})), list(q25 - reach) FILTER (k IN ({_LOW}))) AS lo FROM g GROUP BY level, lang, source),
lim AS (SELECT a.lang, a.source, CASE WHEN a.total >= 100 THEN a.hi WHEN b.total >= 100 THEN b.hi ELSE z.hi END AS hi, CASE WHEN a.total >= 100 THEN a.lo WHEN b.total >= 100 THEN b.lo ELSE z.lo END AS lo
  FROM (SELECT * FROM wide WHERE level = 0) a LEFT JOIN (SELECT * FROM wide WHERE level = 1) b ON a.lang IS NOT DISTINCT FROM b.lang LEFT JOIN (SELECT * FROM wide WHERE level = 2) z ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_FINE}, false) AS kept
FROM f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source
"""
