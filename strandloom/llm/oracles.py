"""SQL for those queries that SQL can express, in the dialect of the test driver's engine."""

from __future__ import annotations

import string

from .secret_scan import ASSIGN, KINDS

_QUOTED = ASSIGN.replace("'", "''")
_LABEL = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
_RUN = "[A-Za-z0-9+/_.=-]+"


def _line(condition: str) -> str:
    return f"coalesce(string_agg({_LABEL} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({condition}), '')"


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(doc_id::VARCHAR, '') AS repo FROM documents),
m AS (
  SELECT rid, 0 AS kind, string_split_regex(t, '{_QUOTED}') AS g, regexp_extract_all(t, '{_QUOTED}', 0) AS h, regexp_extract_all(t, '{_QUOTED}', 2) AS v FROM d
  UNION ALL SELECT rid, 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 3, string_split_regex(t, '{_RUN}'), regexp_extract_all(t, '{_RUN}'), regexp_extract_all(t, '{_RUN}') FROM d),
u AS (SELECT rid, kind, unnest(range(1, len(h) + 1)) AS k, unnest(g[1:len(h)]) AS gap, unnest(h) AS hit, unnest(v) AS value FROM m WHERE len(h) > 0),
p AS (SELECT rid, kind, value, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY k))::BIGINT AS e FROM u),
c AS (SELECT rid, kind, sha256(value) AS hash, e - length(hit) AS s, e FROM p
  WHERE CASE kind WHEN 0 THEN length(value) >= 6 WHEN 1 THEN length(value) >= 20 WHEN 2 THEN length(value) >= 24
    ELSE regexp_full_match(value, '[A-Za-z0-9+/_-]{{20,}}') AND regexp_matches(value, '[0-9].*[0-9]') AND regexp_matches(value, '[A-Za-z]') END),
a AS (SELECT * FROM c x WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM c y WHERE y.rid = x.rid AND y.kind < 3 AND y.s < x.e AND x.s < y.e)),
o AS (SELECT hash, count(*) >= 3 AND max(r) <= 0.9 * sum(r) AS example FROM (SELECT hash, owner, count(DISTINCT repo) AS r FROM a JOIN d USING (rid) GROUP BY hash, owner) GROUP BY hash),
f AS (SELECT a.*, example FROM a JOIN o USING (hash) WHERE kind < 3 OR NOT example)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256({_line('kind < 3')}) AS base_sha256, {_line('true')} AS spans, count(*) FILTER (example) AS n_example, count(*) FILTER (NOT example) AS n_live
FROM (SELECT d.rid, doc_id, kind, s, e, example FROM d LEFT JOIN f USING (rid)) GROUP BY rid, doc_id"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_FIVE = "('0x' || substr(hx, blk * 5 + 1, 5))::BIGINT"
_FOUR = " || ".join(f"substr({_BASE32}, (({_FIVE} >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))

ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
b AS (SELECT body, max(page_id) AS best FROM p GROUP BY body),
x AS (SELECT page_id, best, octet_length(encode(body)) AS payload_bytes, upper(sha1(body)) AS hx FROM p JOIN b USING (body))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda blk: {_FOUR}), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM x"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INT AS rank FROM (
    SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0))
WHERE rank <= 5"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS items FROM w),
x AS (SELECT rid, unnest(items) AS item FROM s),
n AS (SELECT rid, len(items) AS n FROM s),
c AS (SELECT a.rid AS r1, b.rid AS r2, count(*) AS c FROM x a JOIN x b ON a.item = b.item AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT r1, r2 FROM c JOIN n m1 ON m1.rid = r1 JOIN n m2 ON m2.rid = r2 WHERE 100 * c >= 80 * (m1.n + m2.n - c)),
e AS (SELECT r1, r2 FROM l UNION ALL SELECT r2, r1 FROM l),
r AS (SELECT rid, rid AS reached FROM s UNION SELECT r.rid, e.r2 FROM r JOIN e ON r.reached = e.r1)
SELECT d.doc_id, len(d.items) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM s d JOIN (SELECT r.rid, min(s.doc_id) AS component_id FROM r JOIN s ON s.rid = r.reached GROUP BY r.rid) g USING (rid)"""
