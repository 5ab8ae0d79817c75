"""The pipeline operators' queries in SQL, where SQL can express them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS w
    FROM {table}"""


OP2 = f"""
WITH d AS ({_words("documents", "doc_id")}), i AS ({_words("benchmark", "item_id")}),
iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS m, array_to_string(w[p:p + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw))),
hit AS (SELECT doc_id, p, dw.m, item FROM dw JOIN iw ON dw.g = iw.g AND dw.m = iw.m),
places AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

OP7 = f"""
WITH rules(rule_host, rule_path, says) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, says,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT split.page_id, host, path, rule, coalesce(says, 'allow') AS verdict
FROM split LEFT JOIN fits ON fits.page_id = split.page_id AND k = 1
"""

OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""

OP12 = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lowest AS (SELECT t, min(doc_id) AS low FROM w GROUP BY t),
said AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, list_filter([
      CASE WHEN len(w) < 100 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
      CASE WHEN doc_id > low THEN 'E' END], lambda x: x IS NOT NULL) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN lowest USING (t) LEFT JOIN said USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT part, filter_order, step, filter_order[step] AS filter
  FROM (SELECT DISTINCT part FROM g), orders, (SELECT unnest(range(1, 6)) AS step)),
gone AS (
  SELECT part, filter_order, fails, n, good, toxic, list_min(list_transform(fails, lambda x: instr(filter_order, x))) AS removal FROM g, orders),
counted AS (
  SELECT s.part, s.filter_order, s.step, s.filter,
    sum(CASE WHEN removal IS NULL OR removal > s.step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN removal = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN removal < s.step AND list_contains(fails, s.filter) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [s.filter] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN removal = s.step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN removal = s.step THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps s JOIN gone ON gone.part = s.part AND gone.filter_order = s.filter_order
  GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""

# crc32 by its definition: the table from the polynomial, then a fold over the bytes.
OP13 = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
    ORDER BY i) AS t
  FROM range(256) r(i)),
d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
dw AS (SELECT doc_id, unnest(w) AS f FROM d), bw AS (SELECT unnest(w) AS f FROM b),
bytes AS (
  SELECT f, list_transform(range(1, octet_length(encode(f)) + 1), lambda k: CAST('0x' || hex(encode(f))[2 * k - 1:2 * k] AS BIGINT)) AS o
  FROM (SELECT DISTINCT f FROM (SELECT f FROM dw UNION ALL SELECT f FROM bw))),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, o), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE)
    / ((s.n + 1) * CAST((SELECT count(*) FROM bw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
      AS BIGINT) AS score
  FROM d LEFT JOIN weighed ON weighed.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLE = {"op2_decontamination": OP2, "op7_url_filters": OP7, "op11_jaccard_join": OP11, "op12_filter_audit": OP12, "op13_target_resampling": OP13}
