"""SQL that DuckDB runs on the same tables, where SQL can express a query."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM s
), o AS (
  SELECT *, sum(source_size) OVER ()
           - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, place
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, place
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
  FROM w
), f AS (
  SELECT *, 3 * source_size * opened < remaining * weight AS is_full FROM o
), g AS (
  SELECT *, (sum(source_size) OVER () - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT AS free,
         (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::BIGINT AS share
  FROM f
), t AS (
  SELECT source, place, source_size,
         CASE WHEN is_full THEN 3.0::DOUBLE * source_size ELSE (free * weight)::DOUBLE / share END AS target,
         CASE WHEN is_full THEN 3 * source_size ELSE (free * weight) // share END::BIGINT AS words
  FROM g
), p AS (
  SELECT d.doc_id, d.size, t.*,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start,
         CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS rounds
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, words - rounds * source_size - start)) AS tail FROM p
), r AS (
  SELECT *, rounds * size + tail AS taken, rounds + (tail > 0)::INT AS copies FROM q
), u AS (
  SELECT *, start::DOUBLE / nullif(words, 0) AS y,
         (start + (copies - 1) * source_size)::DOUBLE / nullif(words, 0) AS z
  FROM r
)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(CASE place % 3
    WHEN 0 THEN 2 * y / (1.5 + sqrt(2.25 - 2 * y))
    WHEN 1 THEN y
    ELSE CASE WHEN y < 0.375 THEN 2 * y / (0.5 + sqrt(0.25 + 2 * y))
         ELSE 0.5 + 2 * (y - 0.375) / (1 + sqrt(1 + 2 * (y - 0.375))) END END, 6) END AS position,
  CASE WHEN taken > 0 THEN round(CASE place % 3
    WHEN 0 THEN 2 * z / (1.5 + sqrt(2.25 - 2 * z))
    WHEN 1 THEN z
    ELSE CASE WHEN z < 0.375 THEN 2 * z / (0.5 + sqrt(0.25 + 2 * z))
         ELSE 0.5 + 2 * (z - 0.375) / (1 + sqrt(1 + 2 * (z - 0.375))) END END, 6) END AS last_position
FROM u
"""

ORACLES["op9_url_rules"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT *, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(rest, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS asked
  FROM p
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), k AS (
  SELECT page_id, host, path,
    (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
    CASE WHEN host <> '' THEN
      regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
      CASE WHEN len(list_filter(string_split(asked, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) > 0
      THEN '?' || array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&')
      ELSE '' END END AS key,
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                   '(?is)\bhref\s*=\s*["'']?https?://([^"''\s>?#]+)', 1) AS link
  FROM h
), e AS (
  SELECT DISTINCT key AS a, regexp_replace(regexp_replace(link, '^www\.', ''), '/+$', '') AS b
  FROM k WHERE link <> '' AND key IS NOT NULL
), b AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(node, seen) AS (
  SELECT a, a FROM b UNION SELECT r.node, b.b FROM r JOIN b ON r.seen = b.a
), c AS (
  SELECT node, min(seen) AS component FROM r GROUP BY node
), v AS (
  SELECT k.page_id, host, path, k.rule, (SELECT verdict FROM rules WHERE rhost || rpath = k.rule) AS given,
         coalesce(c.component, k.key) AS alias
  FROM k LEFT JOIN c ON k.key = c.node
), t AS (
  SELECT DISTINCT regexp_extract(link, '^[^/]*') AS host, regexp_extract(link, '^[^/]*(.*)$', 1) AS path,
         regexp_replace(regexp_replace(link, '^www\.', ''), '/+$', '') AS key
  FROM k WHERE link <> ''
), f AS (
  SELECT coalesce(c.component, t.key) AS alias,
    (SELECT rules.verdict FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC LIMIT 1) AS given
  FROM t LEFT JOIN c ON t.key = c.node
), m AS (
  SELECT alias, bool_or(given = 'block') AND NOT bool_or(given = 'allow') AS bad
  FROM (SELECT alias, given FROM v UNION ALL SELECT alias, given FROM f) WHERE given IS NOT NULL GROUP BY alias
)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN m.bad THEN 'block' ELSE 'allow' END) AS verdict, v.alias AS alias
FROM v LEFT JOIN m ON v.alias = m.alias
"""

ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL
), n AS (
  SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLES["op12_resampling"] = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT)) AS steps
), d AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT doc, unnest(words) AS word FROM d
), q AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), x AS (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM w UNION SELECT word FROM q)
), y AS (
  SELECT word, list_transform(range(len(digits) // 2), lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::BIGINT) AS bytes
  FROM x
), b AS (
  SELECT word, xor(list_reduce(bytes, lambda c, o: xor(c // 256, steps[xor(c % 256, o) + 1]), 4294967295), 4294967295)
               % 10000 AS bucket
  FROM y, crc
), s AS (
  SELECT bucket, count(*) AS s, sum(count(*)) OVER () AS total FROM w JOIN b USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM q JOIN b USING (word) GROUP BY bucket
), g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (s.total + 10000)::DOUBLE
           / ((s.s + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), m AS (
  SELECT doc, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM w JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc
), e AS (
  SELECT d.doc, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (doc)
), f AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS able
  FROM f
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM r
"""

ORACLES["op13_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digits FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
         list_transform(range(8), lambda k: ('0x' || substr(digits, 5 * k + 1, 5))::INT) AS parts
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda x:
         array_to_string(list_transform([32768, 1024, 32, 1], lambda u:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // u) % 32 + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       true AS intact
FROM d
"""
