"""DuckDB SQL for the registered queries that SQL can express, over the views of the test tables."""

from .licenses import PHRASES, TEMPLATES, longest, plain_words

#: Windows of documents joined with windows of items.
DECONTAMINATE = r"""WITH doc AS (
  SELECT doc_id, md5(coalesce(text, '')) AS th, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
gram AS (
  SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 8) + 1)) AS i FROM item WHERE len(w) > 0)),
probe AS (
  SELECT doc_id, th, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, th, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (SELECT DISTINCT doc_id, th, w FROM doc), (SELECT DISTINCT n FROM gram) WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.th, p.i, p.n, g.item FROM probe p JOIN gram g ON p.n = g.n AND p.g = g.g),
place AS (SELECT doc_id, th, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, th, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY ALL),
items AS (SELECT doc_id, th, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY ALL)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc d LEFT JOIN place p ON d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.th = p.th LEFT JOIN items i ON d.doc_id IS NOT DISTINCT FROM i.doc_id AND d.th = i.th
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_URLS = rf"""
p AS (
  SELECT page_id, url, host, path, scheme, CASE WHEN contains(url, '://') THEN scheme || '://' || host || rest END AS node
  FROM (
    SELECT page_id, url, {_LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
      {_LOWER.format("regexp_extract(coalesce(url, ''), '^(.*?)://', 1, 's')")} AS scheme, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest
    FROM pages)),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))"""
_RULE = "(SELECT first({0} ORDER BY length(h || r.p) DESC) FROM rules r WHERE ({1}.host = h OR ends_with({1}.host, '.' || h)) AND starts_with({1}.path, r.p))"

#: A url and its usual form are one group: no page has other links.
URL_FILTER = rf"""WITH {_URLS},
u AS (
  SELECT *, CASE WHEN scheme IN ('http', 'https') THEN 'https://' || regexp_replace(host, '^((www|m)\.)+([^.]+\..+)$', '\3') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS form
  FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*[^?#]*\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')), '&') AS q FROM p)),
node AS (SELECT DISTINCT form, node FROM u WHERE form IN (SELECT form FROM u WHERE form <> node) UNION SELECT form, form FROM u WHERE form <> node),
parts AS (SELECT form, node, {_LOWER.format("regexp_extract(node, '^.*?://([^/?#]*)', 1, 's')")} AS host, regexp_extract(node, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM node),
votes AS (SELECT form, min(node) AS component, bool_or(action = 'allow') AS allowed, bool_or(action = 'block') AS blocked FROM (SELECT form, node, {_RULE.format("action", "parts")} AS action FROM parts) GROUP BY form)
SELECT page_id, host, path, {_RULE.format("h || r.p", "u")} AS rule,
  coalesce({_RULE.format("action", "u")}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict, component
FROM u LEFT JOIN votes ON u.form = votes.form
"""

#: Chains of six pages, walked from every url.
URL_REDIRECTS = rf"""WITH RECURSIVE {_URLS},
e AS (SELECT a.node AS a, b.node AS b FROM p a JOIN p b ON a.page_id = b.page_id + 1 WHERE a.page_id % 6 <> 0 AND a.node <> b.node),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.m = both_ways.a),
action AS (SELECT node, any_value({_RULE.format("action", "p")}) AS action FROM p GROUP BY node),
votes AS (SELECT n, min(m) AS component, bool_or(action = 'allow') AS allowed, bool_or(action = 'block') AS blocked FROM reach JOIN action ON m = node GROUP BY n)
SELECT page_id, {_RULE.format("h || r.p", "p")} AS rule, coalesce({_RULE.format("action", "p")}, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict, component
FROM p LEFT JOIN votes ON p.node = votes.n
"""

#: Every window of 35 words, grouped by its words.
SUBSTRING_DEDUP = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM doc WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS k FROM twice),
per AS (SELECT r, list(k) AS gone FROM gone GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS k FROM doc WHERE r IN (SELECT r FROM per)),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.k) AS t FROM word LEFT JOIN gone ON word.r = gone.r AND word.k = gone.k WHERE gone.k IS NULL GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN per.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM doc LEFT JOIN per ON doc.r = per.r LEFT JOIN kept ON doc.r = kept.r
"""

_phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_templates = ", ".join(f"({k}, '{label}', {sorted(set(plain_words(text)))}, {[' '.join(plain_words(p)) for p in must]})" for k, (label, text, must) in enumerate(TEMPLATES))

#: All blocks against all templates, in place of the prefix, length and positional filters.
LICENSES = rf"""
WITH phrase(p, label, n) AS (VALUES {_phrases}),
template(k, label, t, must) AS (VALUES {_templates}),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
place AS (SELECT r, i - 1 AS pos, label FROM (SELECT r, w, p, label, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, phrase WHERE len(w) >= n) WHERE w[i] = split_part(p, ' ', 1) AND array_to_string(w[i : i + n - 1], ' ') = p),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY r),
line AS (
  SELECT r, k, len(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM doc)),
start AS (SELECT r, n, sum(n) OVER (PARTITION BY r ORDER BY k) - n AS before FROM line),
block AS (SELECT start.r, w[CAST(before AS BIGINT) + 1 : CAST(before + n AS BIGINT) + {longest(TEMPLATES)}] AS b FROM start JOIN doc ON start.r = doc.r WHERE n > 0),
pair AS (
  SELECT r, label, len(list_intersect(list_distinct(b), t)) AS shared, len(t) AS size
  FROM (SELECT r, b, ' ' || array_to_string(b, ' ') || ' ' AS joined FROM block), template WHERE len(list_filter(must, lambda m: contains(joined, ' ' || m || ' '))) > 0),
met AS (SELECT r, list(DISTINCT label) AS labels, max(shared / size) AS share FROM pair WHERE shared >= greatest(1, ceil(0.8 * size - 1e-9)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM doc LEFT JOIN base ON doc.r = base.r LEFT JOIN met ON doc.r = met.r
"""

QUALITY = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, chr(1)))) AS th, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM doc WHERE len(w) >= 5)),
twice AS (SELECT win.r, i FROM win JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) t ON win.r = t.r AND win.g = t.g),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS k FROM twice) GROUP BY r),
line AS (
  SELECT r, source, th, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT r, source, th, unnest(string_split(text, chr(10))) AS x FROM doc) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM line GROUP BY r),
host AS (SELECT source, count(DISTINCT th) AS n FROM doc GROUP BY source),
often AS (SELECT l.source, norm FROM line l JOIN host h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, norm, h.n HAVING count(DISTINCT th) > 10 AND count(DISTINCT th) > h.n * 0.01),
lost AS (SELECT r, sum(n) AS n FROM line l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM doc LEFT JOIN rep ON doc.r = rep.r LEFT JOIN dup ON doc.r = dup.r LEFT JOIN lost ON doc.r = lost.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_boilerplate_words >= n_words * 0.3 AS kept
FROM base
"""
