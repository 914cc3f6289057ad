"""SQL for the named queries that SQL can express."""

DECONTAMINATION = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT d.*, k.n, unnest(range(1, len(w) - k.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) k WHERE len(w) >= k.n)
), h AS (
  SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(s.n_items, 0)::BIGINT AS n_items,
  coalesce(s.sha, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

#: The strength of a level's prior by moments, for the level's table.
_STRENGTH = """
  SELECT CASE WHEN c < 2 OR rho IS NULL THEN 1.0 WHEN rho <= 1 / 10001.0 THEN 10000.0 ELSE greatest(1.0, least(10000.0, 1 / rho - 1)) END AS k
  FROM (SELECT (sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0) AS rho, count(*) AS c
        FROM {} WHERE n > 0)
"""

REPUTATION = r"""
WITH base AS (
  SELECT page_id, coalesce(url, '') AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules AS (
  SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) r(rule, h, p, v)
), ruled AS (
  SELECT b.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.v, length(r.rule)) AS v
  FROM base b JOIN rules r ON (b.host = r.h OR ends_with(b.host, '.' || r.h)) AND starts_with(b.path, r.p) GROUP BY b.page_id
), outcome AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels GROUP BY doc_id
), parts AS (
  SELECT b.host, o.bad, string_split(b.host, '.') AS w, array_to_string(list_slice(string_split(b.host, '.'), -2, -1), '.') AS two
  FROM base b LEFT JOIN outcome o USING (page_id)
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    any_value(CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') THEN array_to_string(list_slice(w, -3, -1), '.') ELSE two END) AS domain,
    any_value(CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') THEN two ELSE w[-1] END) AS suffix
  FROM parts GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS prior FROM domains GROUP BY suffix
), sk AS (""" + _STRENGTH.format("suffixes") + r"""), s AS (SELECT suffix, (bad + k * prior) / (n + k) AS mean FROM suffixes, sk
), d0 AS (SELECT d.*, s.mean AS prior FROM domains d JOIN s USING (suffix)
), dk AS (""" + _STRENGTH.format("d0") + r"""), d AS (SELECT domain, suffix, (bad + k * prior) / (n + k) AS mean FROM d0, dk
), h0 AS (SELECT h.*, d.mean AS prior FROM hosts h JOIN d USING (domain, suffix)
), hk AS (""" + _STRENGTH.format("h0") + r"""), h AS (SELECT host, n, n + k + 1 AS m, (bad + k * prior) / (n + k) AS mean FROM h0, hk)
SELECT b.page_id, b.host, b.path, r.rule,
  coalesce(r.v, CASE WHEN h.mean - 1.645 * sqrt(h.mean * (1 - h.mean) / h.m) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, h.n::BIGINT AS n_labelled
FROM base b LEFT JOIN ruled r USING (page_id) LEFT JOIN h USING (host)
"""

ARCHIVE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    regexp_replace(replace(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), '(?s)^.*?://', '') AS rest FROM pages
), k AS (SELECT *, strftime(make_timestamp(page_id * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
    array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^[^/?#]*')), '.')), ',') || ')' || regexp_replace(rest, '^[^/?#]*', '') AS url_key FROM p
), q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first,
    row_number() OVER (ORDER BY url_key, ts, page_id) AS capture_no FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to,
  url_key, ts, capture_no
FROM q
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), freq AS (SELECT g, count(*) AS c FROM s GROUP BY g
), ranked AS (
  SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY freq.c, s.g) AS r FROM s JOIN freq USING (g) JOIN n USING (doc_id)
), prefix AS (SELECT * FROM ranked WHERE r <= n - ceil(0.8 * n - 1e-9) + 1
), maybe AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), shared AS (
  SELECT m.a, m.b, any_value(m.na) AS na, any_value(m.nb) AS nb, count(*) AS i
  FROM maybe m JOIN s x ON x.doc_id = m.a JOIN s y ON y.doc_id = m.b AND x.g = y.g GROUP BY m.a, m.b
), links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents WHERE doc_id IN (SELECT a FROM edges)
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) c USING (doc_id)
"""

#: Pairs whose letter counts differ too much are left out before the distance is computed; no near pair is.
LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, p, lines[p + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), t AS (SELECT *, (doc_id, p) AS place FROM l WHERE trim(line, ' ') <> ''
), d AS (
  SELECT line, min(place) AS first, length(line) AS n, [len(line) - len(replace(line, x, '')) FOR x IN string_split('enaotirshlud', '')] AS c FROM t GROUP BY line
), near AS (
  SELECT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb FROM d a JOIN d b
  ON a.n >= 10 AND b.n >= 10 AND b.n - a.n BETWEEN -2 AND 2 AND a.line <> b.line
    AND CASE WHEN list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.c, b.c)]) > 4 THEN false
      ELSE levenshtein(a.line, b.line) <= CASE WHEN a.n < 20 OR b.n < 20 THEN 1 ELSE 2 END END
), told AS (SELECT a AS line, count(*) AS links, bool_or(fb < fa) AS later FROM near GROUP BY a
), judged AS (
  SELECT t.doc_id, t.p, t.line, t.place <> d.first AS same, coalesce(told.later, false) AS later, coalesce(told.links, 0) AS links
  FROM t JOIN d USING (line) LEFT JOIN told USING (line)
), per_doc AS (
  SELECT doc_id, count(*) FILTER (same) AS n_equal, count(*) FILTER (NOT same AND later) AS n_near, sum(links) AS n_links FROM judged GROUP BY doc_id
), cleaned AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text FROM l LEFT JOIN judged j USING (doc_id, p) WHERE NOT coalesce(j.same OR j.later, false) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(c.text, '') END AS text,
  CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(n_equal, 0)::BIGINT AS n_equal,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN per_doc USING (doc_id) LEFT JOIN cleaned c USING (doc_id)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(w) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

#: The targets by handing the excess round: every round caps the sources that the common share would fill.
MIXTURE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS drawn
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source
), rounds AS (
  SELECT 0 AS r, source, size, w, false AS capped, sum(size) OVER ()::HUGEINT AS remaining, sum(w) OVER ()::HUGEINT AS weights FROM s
  UNION ALL
  SELECT r + 1, source, size, w, capped OR filled,
    (sum(size) OVER () - sum(CASE WHEN capped OR filled THEN 3 * size ELSE 0 END) OVER ())::HUGEINT,
    (sum(CASE WHEN capped OR filled THEN 0 ELSE w END) OVER ())::HUGEINT
  FROM (SELECT *, 3 * size::HUGEINT * weights <= remaining * w AS filled, bool_or(NOT capped AND 3 * size::HUGEINT * weights <= remaining * w) OVER () AS more FROM rounds)
  WHERE more
), told AS (
  SELECT source, size AS source_size, CASE WHEN capped THEN (3 * size)::DOUBLE ELSE (remaining * w)::DOUBLE / weights::DOUBLE END AS target
  FROM rounds WHERE r = (SELECT max(r) FROM rounds)
), steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216) ELSE 0 END::BIGINT AS step,
    ('0x' || substr(sha256('42:source:' || coalesce(source, '')), 1, 6))::BIGINT AS shift
  FROM told
), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, drawn, doc_id) AS p FROM d
), copied AS (
  SELECT doc_id, size, source_size, target, ((shift + p::HUGEINT * step) // 16777216 - (shift + (p - 1)::HUGEINT * step) // 16777216)::BIGINT AS copies
  FROM placed JOIN steps ON placed.source IS NOT DISTINCT FROM steps.source
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM copied
"""

RANKED_SEARCH = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL
), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n
), m AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM n, total
), w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t, n_docs
), q AS (SELECT item_id, t, count(*) AS q FROM i GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SQL = {"op1_decontamination": DECONTAMINATION, "op3_near_duplicates": NEAR_DUPLICATES, "op8_line_dedup": LINE_DEDUP, "op4_host_reputation": REPUTATION, "op5_warc_index": ARCHIVE,
       "op11_ranked_search": RANKED_SEARCH, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_mixture": MIXTURE}
