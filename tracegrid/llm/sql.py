"""DuckDB forms of the corpus queries that SQL can express, written from the contracts and not from the operators.

Byte-pair and word-piece encoding, compression, signatures, best-fit plans and the 400-byte windows have none; the tests hold
those against other libraries or brute force."""

from __future__ import annotations

from tracegrid.llm.urls import BOUND, LEAST_STRENGTH, LOWER, MOST_STRENGTH, RULES, UPPER, Z

#: component: the smallest id that links (u, w, both ways) reach
_REACH = """reach(id, r) AS (SELECT DISTINCT u, u FROM links UNION SELECT l.w, r.r FROM reach r JOIN links l ON l.u = r.id),
component AS (SELECT id, min(r) AS c FROM reach GROUP BY id)"""

OP1 = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_REACH}
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id) AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN component c ON c.id = e.vec_id
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""

OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS k FROM d WHERE contains(text, chr(10))),
m AS (SELECT doc_id, k, regexp_matches(line, '[^ \t\n\x0B\x0C\r]') AS filled FROM l),
n AS (SELECT *, max(CASE WHEN filled THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(CASE WHEN filled THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM m),
spots AS (
  SELECT doc_id, k AS a, k + 2 AS b FROM n WHERE filled AND after = k + 1
  UNION ALL SELECT doc_id, before, k + 1 FROM n WHERE NOT filled AND before IS NOT NULL
  UNION ALL SELECT doc_id, k, after + 1 FROM n WHERE NOT filled AND after IS NOT NULL),
runs AS (SELECT s.doc_id, s.a, s.b, array_to_string(list_slice(d.lines, s.a + 1, s.b), chr(10)) AS body FROM spots s JOIN d USING (doc_id)),
again AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(a) OVER w AS first_a FROM runs WINDOW w AS (PARTITION BY body ORDER BY doc_id, a)),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS k FROM again WHERE (doc_id <> first_doc OR a <> first_a) AND NOT (doc_id = first_doc AND a < first_a + b - a)),
kept AS (SELECT l.doc_id, count(*) FILTER (g.k IS NULL) AS left_, count(g.k) AS removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id)
SELECT d.doc_id, greatest(1, coalesce(kept.left_, 1)) AS n_lines_left, coalesce(kept.removed, 0) AS n_removed_lines, sha256(coalesce(kept.text, d.text)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _strength(n: str, bad: str, prior: str, table: str) -> str:
    rho = f"(sum(pow({bad} - {n} * {prior}, 2)) - sum({n} * {prior} * (1 - {prior}))) / nullif(sum({n} * ({n} - 1) * {prior} * (1 - {prior})), 0)"
    return f"(SELECT coalesce(CASE WHEN {rho} <= 0 THEN {MOST_STRENGTH} ELSE greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, 1 / ({rho}) - 1)) END, {MOST_STRENGTH}) AS k FROM {table})"


def _rule(value) -> str:  # noqa: ANN001
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in ranked)
    return f"CASE {fits} END"


OP9 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT doc_id AS page_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
bare AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS x, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM h LEFT JOIN j USING (page_id) GROUP BY host),
kind AS (SELECT *, regexp_matches(x, '^[0-9]+([.][0-9]+){{3}}$|^\[') AS address, regexp_matches(x, '(^|[.])(ac|co|com|edu|gov|net|org)[.][a-z][a-z]$') AS two FROM bare),
hosts AS (SELECT host, n, b,
  CASE WHEN address THEN x WHEN two THEN regexp_extract(x, '([^.]*[.]){{0,2}}[^.]*$') ELSE regexp_extract(x, '([^.]*[.])?[^.]*$') END AS domain,
  CASE WHEN address THEN '[address]' WHEN two THEN regexp_extract(x, '([^.]*[.])?[^.]*$') ELSE regexp_extract(x, '[^.]*$') END AS suffix FROM kind),
domains AS (SELECT domain, suffix, sum(n) AS dn, sum(b) AS db FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb FROM domains GROUP BY suffix),
l0 AS (SELECT *, (SELECT (coalesce(sum(sb), 0) + 0.5) / (coalesce(sum(sn), 0) + 1) FROM suffixes)::DOUBLE AS p0 FROM suffixes),
l1 AS (SELECT suffix, (sb + k * p0) / (sn + k) AS p1 FROM l0, {_strength("sn", "sb", "p0", "l0")}),
d1 AS (SELECT * FROM domains JOIN l1 USING (suffix)),
l2 AS (SELECT domain, suffix, (db + k * p1) / (dn + k) AS p2 FROM d1, {_strength("dn", "db", "p1", "d1")}),
h2 AS (SELECT * FROM hosts JOIN l2 USING (domain, suffix)),
l3 AS (SELECT host, (b + k * p2) / (n + k) AS mean, n + k AS size FROM h2, {_strength("n", "b", "p2", "h2")}),
poor AS (SELECT host, round(mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)), 9) >= {BOUND} AS blocked FROM l3)
SELECT page_id, host, path, {_rule(lambda v, h, p: h + p)} AS rule, coalesce({_rule(lambda v, h, p: v)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN poor USING (host)
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) < 2 THEN t ELSE list_distinct([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS w, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
near AS (SELECT u, w FROM pairs WHERE 100 * i >= 80 * (m + n - i)),
links AS (SELECT u, w FROM near UNION SELECT w, u FROM near),
{_REACH}
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN component c ON c.id = s.doc_id
"""
