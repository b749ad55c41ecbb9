"""SQL equivalents, for the operators that SQL can express, over the test tables as views."""

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


NEAR_DUPLICATES = f"""WITH RECURSIVE texts AS (
  SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(
      range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS f FROM texts),
features AS (SELECT doc_id, unnest(f) AS x FROM sets),
shared AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM features p
  JOIN features q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * c >= 90 * (len(p.f) + len(q.f) - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, len(f) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM sets JOIN least ON least.a = doc_id LEFT JOIN counts ON counts.a = doc_id"""

REPEATS = f"""WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, {_words("coalesce(text, '')")} AS w FROM documents),
hashed AS (
  SELECT doc_id, r, list_transform(range(1, len(w) - 48),
    lambda s: md5(array_to_string(w[s:s + 49], ' '))) AS h FROM texts WHERE len(w) >= 50),
windows AS (
  SELECT doc_id, r, unnest(h) AS k, unnest(range(1, len(h) + 1)) AS s FROM hashed),
owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 50)) AS p FROM windows JOIN owners USING (k)
  WHERE owner < doc_id),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)"""

EQUAL_TEXTS = f"""WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER same = 1 AS kept,
  sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t ORDER BY doc_id NULLS LAST)"""

FILTER_INTERACTIONS = f"""WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    {_words("coalesce(text, '')")} AS w FROM documents),
flags AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
  FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
      'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
      'D': regexp_matches(t, '[#$%&*|]'),
      'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)}} AS f
  FROM texts LEFT JOIN flags USING (doc_id)),
orders(o) AS (
  SELECT '' UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
  WHERE NOT contains(o, x)),
steps AS (
  SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
named AS (
  SELECT *, substr(filter_order, step::INT, 1) AS x, substr(filter_order, 1, step::INT - 1) AS b
  FROM steps),
cells AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x:
    CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END)
    AS failed, count(*) AS n
  FROM docs GROUP BY ALL),
marked AS (
  SELECT part, filter_order, step, x, n, good, toxic, list_contains(failed, x) AS fails,
    len(list_filter(failed, lambda y: contains(b, y))) > 0 AS before, len(failed) = 1 AS one
  FROM cells, named),
counted AS (
  SELECT part, filter_order, step, x,
    coalesce(sum(n) FILTER (NOT fails AND NOT before), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT before), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND one), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (fails AND NOT before AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (fails AND NOT before AND toxic), 0)::BIGINT AS toxic_lost
  FROM marked GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost,
  toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted"""
