"""The subpackage's registered queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .language_id import op5_language_id
from .line_dedup import op7_line_dedup
from .packing import op10_best_fit_packing
from .quality import op8_quality_rules
from .repeats import op1_suffix_dedup
from .simhash import op2_simhash_near_dedup
from .token_counts import op6_token_counts
from .token_files import op4_token_files
from .url_filter import op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_simhash_near_dedup, op3_decontaminate, op4_token_files, op5_language_id, op6_token_counts, op7_line_dedup, op8_quality_rules, op9_url_filter, op10_best_fit_packing)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATE = rf"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i : i + 7] AS gram, len(w[i : i + 7]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, i, n, w[i : i + n - 1] AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (gram, n)),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, list(DISTINCT item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(array_to_string(list_sort(coalesce(ids, [])), ',')) AS items_sha256, coalesce(len(ids), 0) >= 2 AS contaminated
FROM doc_words LEFT JOIN marked USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
_HOST = r"translate(regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_RULE = """CASE WHEN ({h} = 'www.example.com' OR {h} LIKE '%.www.example.com') AND starts_with({p}, '/en/') THEN 'www.example.com/en/'
  WHEN ({h} = 'example.com' OR {h} LIKE '%.example.com') AND starts_with({p}, '/en/') THEN 'example.com/en/'
  WHEN ({h} = 'net' OR {h} LIKE '%.net') AND starts_with({p}, '/es/') THEN 'net/es/'
  WHEN ({h} = 'net' OR {h} LIKE '%.net') AND starts_with({p}, '/fr/') THEN 'net/fr/'
  WHEN ({h} = 'com' OR {h} LIKE '%.com') AND starts_with({p}, '/') THEN 'com/' END"""
#: Absolute canonical links only; the tables hold no other kind.
_URLS = rf"""
WITH RECURSIVE parsed AS (SELECT page_id, coalesce({_HOST.format("url")}, '') AS host, coalesce({_PATH.format("url")}, '') AS path, url, html FROM pages),
judged AS (SELECT *, {_RULE.format(h="host", p="path")} AS rule FROM parsed),
links AS (SELECT host || path AS a, regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="https?://([^"?#]*)', 1) AS b FROM judged WHERE contains(html, 'rel="canonical"')),
edges AS (SELECT a, b FROM links WHERE b <> '' AND a <> b UNION SELECT b, a FROM links WHERE b <> '' AND a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
seen AS (SELECT a, regexp_extract(b, '^[^/]*') AS h, regexp_extract(b, '^[^/]*(.*)$', 1) AS p FROM reach),
found AS (SELECT a, bool_or(r IN ('com/', 'www.example.com/en/')) AS allowed, bool_or(r NOT IN ('com/', 'www.example.com/en/')) AS blocked FROM (SELECT a, {_RULE.format(h="h", p="p")} AS r FROM seen) GROUP BY a)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM judged LEFT JOIN found ON host || path = a
"""
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": _DECONTAMINATE, "op9_url_filter": _URLS}
