"""DuckDB SQL of the operators that SQL can express, by exact comparison."""

from __future__ import annotations

from tidemark.llm.common import UPPER

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

#: Every window of every item against every run of words of the same length.
OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM ip),
rp AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN (SELECT DISTINCT m FROM pat) lens ON len(w) >= m),
hit AS (SELECT r, i, pat.m, item FROM (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM rp) run JOIN pat USING (m, t)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
nm AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN nm USING (r)"""


def links(percent: int = 80) -> str:
    """From sg (id, s), distinct: sz (id, n), and cmp (id, label), the smallest id that
    each linked id reaches by links of Jaccard similarity ``percent`` or more.
    Two such sets share one of their n - ceil(n * percent) + 1 rarest elements."""
    return f"""sz AS (SELECT id, count(*) AS n FROM sg GROUP BY id),
rare AS (SELECT id, s, n, row_number() OVER (PARTITION BY id ORDER BY f, s) AS k FROM sg JOIN (SELECT s, count(*) AS f FROM sg GROUP BY s) USING (s) JOIN sz USING (id)),
head AS (SELECT id, s, n FROM rare WHERE k <= n - ceil(n * {percent} / 100.0) + 1),
pair AS (SELECT DISTINCT x.id AS a, y.id AS b, x.n AS na, y.n AS nb FROM head x JOIN head y ON x.s = y.s AND x.id < y.id AND x.n * 100 >= y.n * {percent} AND y.n * 100 >= x.n * {percent}),
met AS (SELECT a, b, na, nb, count(*) AS c FROM pair JOIN sg x ON x.id = a JOIN sg y ON y.id = b AND y.s = x.s GROUP BY ALL),
edge AS (SELECT a, b FROM met WHERE 100 * c >= {percent} * (na + nb - c)),
way AS MATERIALIZED (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach AS (SELECT DISTINCT a AS id, a AS other FROM way UNION SELECT reach.id, way.b FROM reach JOIN way ON way.a = reach.other),
cmp AS (SELECT id, min(other) AS label FROM reach GROUP BY id)"""


OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sg AS (SELECT DISTINCT id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
{links()}
SELECT w.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(label, w.id) AS component_id, coalesce(label, w.id) = w.id AS kept FROM w LEFT JOIN sz ON sz.id = w.id LEFT JOIN cmp ON cmp.id = w.id"""

_BLANK = r"[ \t\n\x0B\f\r]"
#: For tables whose doc_ids are distinct.  A line's id is the place (doc_id, position) where it first stands.
OP8 = rf"""WITH RECURSIVE parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, pos, trim(lower(regexp_replace(line, '{_BLANK}+', ' ', 'g'))) AS norm FROM (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS pos FROM parts) WHERE regexp_matches(line, '[^{_BLANK[1:]}')),
place AS (SELECT norm, min((doc_id, pos)) AS first FROM lines GROUP BY norm),
node AS (SELECT norm, row_number() OVER (ORDER BY first) AS id, first FROM place),
sg AS (SELECT DISTINCT id, substr(norm, i, 8) AS s FROM (SELECT id, norm, unnest(range(1, greatest(length(norm) - 3, 1) + 1)) AS i FROM node)),
{links()},
kept AS (SELECT node.norm, coalesce(head.first, node.first) AS keep FROM node LEFT JOIN cmp USING (id) LEFT JOIN node head ON head.id = cmp.label),
lost AS (SELECT doc_id, list(pos) AS lost FROM lines JOIN kept USING (norm) WHERE (doc_id, pos) <> keep GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, (coalesce(n, 0) - coalesce(len(lost), 0))::BIGINT AS n_kept,
 CASE WHEN lost IS NULL THEN text ELSE array_to_string(list_filter(p, lambda x, i: NOT list_contains(lost, i - 1)), chr(10)) END AS text FROM parts LEFT JOIN total USING (doc_id) LEFT JOIN lost USING (doc_id)"""

_DIGITS = " || ".join(f"substr('{UPPER}234567', (((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {shift}) & 31) + 1)::INT, 1)" for g in range(8) for shift in (15, 10, 5, 0))
OP10 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p"""

_FINE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
OP11 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding AS e, len(embedding) AS d, {_DOT.format("embedding", "embedding")} AS l FROM embeddings WHERE vec_id IS NOT NULL AND {_FINE}),
way AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND a.d = b.d AND a.l > 0 AND b.l > 0 AND {_DOT.format("a.e", "b.e")} >= 0.9::DOUBLE * sqrt(a.l * b.l)),
reach AS (SELECT a AS id, b AS other FROM way UNION SELECT reach.id, way.b FROM reach JOIN way ON way.a = reach.other),
cmp AS (SELECT id, min(other) AS label FROM reach GROUP BY 1), n AS (SELECT a AS id, count(*) AS n FROM way GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(cmp.label, vec_id) AS component_id, coalesce(cmp.label, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN cmp ON cmp.id = vec_id"""

#: The CRC-32 of a text's UTF-8 bytes, a byte a step, by the table of the reflected polynomial.
_CRC = """tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM every)), tab)"""
_RUNS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
#: For tables whose doc_ids are distinct.
OP12 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
every AS MATERIALIZED (SELECT doc_id, false AS aim, {_RUNS} AS f FROM d UNION ALL SELECT NULL, true, {_RUNS} FROM b), {_CRC},
k AS (SELECT i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(range(10000)) AS i) LEFT JOIN (SELECT bucket, sum((NOT aim)::INT) AS s, sum(aim::INT) AS t FROM every JOIN crc USING (f) GROUP BY 1) ON bucket = i),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM k),
wt AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM every JOIN crc USING (f) JOIN gain USING (bucket) WHERE NOT aim GROUP BY 1),
sc AS (SELECT doc_id, len(w) >= 20 AS fit, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN wt USING (doc_id)),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE fit)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)"""

#: For tables whose vec_ids are distinct.
OP13 = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, len(embedding) AS d FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINE}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.d = b.d),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op11_embedding_dedup": OP11, "op12_resampling": OP12, "op13_hard_negatives": OP13, "op1_decontamination": OP1, "op3_minhash_dedup": OP3, "op8_line_dedup": OP8, "op10_warc_zip": OP10}
