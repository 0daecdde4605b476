"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from . import chat
from .secret_scan import ALLOWED, CLASSES, RUN, WIDTH, WORDS

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of each kind with their places: gaps and matches alternate, so their lengths add up.
PLACES = """{k} AS (SELECT doc_id, m, e - coalesce(length(m), 0) AS s, e FROM (SELECT doc_id, m, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY rid ORDER BY i) AS e FROM
 (SELECT doc_id, rid, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(string_split_regex(t, '{p}')) AS g, generate_subscripts(string_split_regex(t, '{p}'), 1) AS i FROM {d})) WHERE m IS NOT NULL)"""
_BOUND = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {b}" for p, b in CLASSES[:-1])
_ALLOWED = " OR ".join(f"regexp_matches(m, '{p}')" for p in ALLOWED)

#: The text with spaces for base spans and allow-listed words: entropy is looked for in what is left.
_BLANKED = "CASE WHEN head IS NULL THEN t ELSE head || substr(t, z + 1) END"
for _w in WORDS:
    _BLANKED = f"regexp_replace({_BLANKED}, '(?i){_w}', '{' ' * len(_w)}', 'g')"

SECRETS = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
{PLACES.format(k="pa", d="d", p=ASSIGN)}, {PLACES.format(k="pb", d="d", p="AKIA[A-Z0-9]+")}, {PLACES.format(k="pc", d="d", p="[0-9a-f]{{24,}}".replace("{{", "{").replace("}}", "}"))},
b AS (SELECT doc_id, s, e, 0 AS k, 'assign' AS kind FROM pa WHERE length(regexp_extract(m, '{ASSIGN}', 2)) >= 6 UNION ALL SELECT doc_id, s, e, 1, 'access' FROM pb WHERE length(m) >= 20 UNION ALL SELECT doc_id, s, e, 2, 'hex' FROM pc),
mx AS (SELECT doc_id, s, e, k, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM b),
hd AS (SELECT doc_id, string_agg(substr(t, (upto + 1)::BIGINT, (greatest(s, upto) - upto)::BIGINT) || repeat(' ', greatest(e - greatest(s, upto), 0)::BIGINT), '' ORDER BY s, k) AS head, max(e)::BIGINT AS z FROM mx JOIN d USING (doc_id) GROUP BY 1),
bl AS (SELECT d.doc_id, rid, {_BLANKED} AS t FROM d LEFT JOIN hd USING (doc_id)), {PLACES.format(k="pd", d="bl", p=RUN)},
h AS (SELECT doc_id, s, e, list_max(list_transform(range(0, length(m) - {WIDTH} + 1), lambda i: list_aggregate(string_split(substr(m, i + 1, {WIDTH}), ''), 'entropy'))) AS h, CASE {_BOUND} ELSE {CLASSES[-1][1]} END AS bound FROM pd WHERE NOT ({_ALLOWED})),
x AS (SELECT doc_id, s, e, k, kind FROM b UNION ALL SELECT doc_id, s, e, 3, 'entropy' FROM h WHERE h >= bound),
g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_entropy,
 string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans FROM x GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN g USING (doc_id)"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, k = x.n AND k = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
e AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l),
r AS (SELECT DISTINCT a AS v, a AS o FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.o),
c AS (SELECT v, min(o) AS component_id FROM r GROUP BY 1),
t AS (SELECT a, count(*) AS n_links, count(*) FILTER (WHERE same) AS copies, min(b) FILTER (WHERE same) AS first FROM e GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce(first, d.doc_id)) AS class_id, 1 + coalesce(copies, 0) AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN t ON t.a = d.doc_id LEFT JOIN c ON c.v = d.doc_id"""

NEGATIVES = """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, a.z, b.vec_id, b.label, CASE WHEN len(a.z) = len(b.z) THEN list_sum(list_transform(range(1, len(a.z) + 1), lambda i: a.z[i] * b.z[i]))::BIGINT END AS score FROM v a JOIN v b ON len(a.z) = len(b.z) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, own, z, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id, own, z ORDER BY score DESC, vec_id) AS n FROM s WHERE label = own AND vec_id <> anchor_id) WHERE n <= 5),
q AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.own, p.z, positive_id, positive_score ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.z = p.z AND s.label <> p.own WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 3"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"""regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
LEXICAL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
z AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nl FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt FROM p, z GROUP BY t, nd),
i AS (SELECT iid, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark))),
s AS (SELECT iid, item_id, rid, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nl))))::BIGINT AS score FROM i JOIN p USING (t) JOIN v USING (t), z GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""

ORACLE = {"op3_chat_collapse": chat.ORACLE_SQL, "op6_secret_scan": SECRETS, "op10_jaccard_join": JACCARD, "op12_annulus_negatives": NEGATIVES, "op13_lexical": LEXICAL}
