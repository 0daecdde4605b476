"""Local process models, object-centric trees, fuzzy measures, and contacts of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fields, fuzzy, local_models, object_trees
from ..sources.tables import DAY_SQL, FLAT_SQL, LINE_SQL, activity_ocel, day_log, line_log, order_ocel
from .registry import query

#: Sequences, choices and loops of one operator in closed form. In the events of two activities a sequence occurs where
#: the second follows the first at once, a choice at every event, and a loop once in each case that has the activity.
SMALL_SQL = """e AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY ts NULLS LAST, event_id) AS p FROM log),
c AS (SELECT activity AS a, count(*) AS n FROM e GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
k AS (SELECT case_id, activity, count(*) AS m FROM e GROUP BY 1, 2), v AS (SELECT case_id, string_agg(activity, chr(31) ORDER BY p) AS variant FROM e GROUP BY 1),
pr AS (SELECT x.a, y.a AS b, x.n AS na, y.n AS nb FROM c x JOIN c y ON x.a <> y.a),
tg AS (SELECT x.activity AS a, y.activity AS b FROM k x JOIN k y ON x.case_id = y.case_id AND x.activity <> y.activity GROUP BY 1, 2 HAVING count(*) >= 10),
f AS (SELECT pr.a, pr.b, e.case_id, e.activity = pr.b AND lag(e.activity) OVER w = pr.a AS hit FROM pr JOIN e ON e.activity IN (pr.a, pr.b) WINDOW w AS (PARTITION BY pr.a, pr.b, e.case_id ORDER BY e.p)),
fc AS (SELECT a, b, case_id, count(*) AS m, count(*) FILTER (WHERE hit) AS hits FROM f GROUP BY 1, 2, 3),
sq AS (SELECT fc.a, fc.b, sum(hits) AS f, avg(2 * hits / m) AS fitness FROM fc JOIN tg USING (a, b) GROUP BY 1, 2),
lo AS (SELECT activity AS a, count(*) AS f, count(DISTINCT CASE WHEN m <= 3 THEN m END) AS words FROM k GROUP BY 1),
lf AS (SELECT a, sum(m) / count(*) AS firings FROM (SELECT k.activity AS a, v.variant, min(m) AS m FROM k JOIN v USING (case_id) GROUP BY 1, 2) GROUP BY 1),
md AS (SELECT 'seq(''' || a || ''', ''' || b || ''')' AS model, f::BIGINT AS frequency, 2 / (na / f + nb / f) AS confidence, 1.0::DOUBLE AS determinism, (na + nb) / total AS coverage, 1.0 AS language_fit, 2.0 AS avg_firings, fitness FROM sq JOIN pr USING (a, b), t WHERE f >= 10 AND nb >= 10 AND na >= 10
UNION ALL SELECT 'xor(''' || a || ''', ''' || b || ''')', (na + nb)::BIGINT, 1.0, 0.5, (na + nb) / total, 1.0, 1.0, 1.0 FROM pr, t WHERE a < b AND na + nb >= 10
UNION ALL SELECT 'loop(''' || lo.a || ''')', f::BIGINT, 1.0, 1.0, n / total, words / 3, firings, 1.0 FROM lo JOIN c USING (a) JOIN lf USING (a), t WHERE f >= 10 AND n >= 10 AND words / 3 >= 0.49)
SELECT model, frequency, round(log10(frequency) / (log10(frequency) + 1), 9) AS support, round(confidence, 9) AS confidence, determinism, round(coverage, 9) AS coverage, round(language_fit, 9) AS language_fit, round(avg_firings, 9) AS avg_firings, round(fitness, 9) AS fitness FROM md"""


def _small(log) -> DataFrame:
    found = local_models.discover(log, size=2, operators=("seq", "xor", "loop"))
    return found.selectExpr("model", "frequency", "determinism", *[f"round({c}, 9) as {c}" for c in ("support", "confidence", "coverage", "language_fit", "avg_firings", "fitness")])


@query(f"WITH {DAY_SQL}, {SMALL_SQL}")
def g12_small_models(spark, d) -> DataFrame:
    return _small(day_log(spark, d))


@query(f"WITH {LINE_SQL}, {SMALL_SQL}")
def g12_small_models_lines(spark, d) -> DataFrame:
    return _small(line_log(spark, d))


@query()
def g12_local_models(spark, d) -> DataFrame:
    return local_models.discover(day_log(spark, d), size=3)


@query()
def g13_combined_models(spark, d) -> DataFrame:
    log = activity_ocel(spark, d)
    return local_models.combined(log, local_models.discover_by_type(log, size=2))


@query()
def g17_object_tree(spark, d) -> DataFrame:
    return object_trees.discover(order_ocel(spark, d))


@query()
def g17_object_tree_users(spark, d) -> DataFrame:
    return object_trees.discover(activity_ocel(spark, d))


_SIM = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE (greatest(length({a}), length({b})) - levenshtein({a}, {b}))::DOUBLE / greatest(length({a}), length({b})) END"
_STEPS = "\n UNION ALL ".join(f"SELECT lag(activity, {k}) OVER w AS source, activity AS target, {k} AS distance, us // 1000 - lag(us // 1000, {k}) OVER w AS gap, coalesce(lag(resource, {k}) OVER w, '<no resource>') AS ra, coalesce(resource, '<no resource>') AS rb FROM lg WINDOW w AS (PARTITION BY case_id ORDER BY ts NULLS LAST, event_id)" for k in range(1, 6))


def _fuzzy_sql(share: str, routing: float = 1.0, invert: bool = False) -> str:
    """The measures by windows over all pairs; ``invert`` mirrors the frequency of successions."""
    norm = lambda x: f"CASE WHEN max({x}) OVER () > 0 THEN {x} / max({x}) OVER () ELSE {x} END"
    ef = f"1.0 - ({norm('n')})" if invert else norm("n")
    return f"""lb AS ({_STEPS}), sc AS (SELECT source, target, distance, count(*) AS n, sum(CASE WHEN gap = 0 THEN 1.0 ELSE 1.0 / gap END) AS near, sum({_SIM.format(a="ra", b="rb")}) AS alike FROM lb WHERE source IS NOT NULL GROUP BY 1, 2, 3),
rw AS (SELECT source, target, sum(n * {share}) AS n, sum(near * {share}) AS near, sum(alike * {share}) AS alike FROM sc GROUP BY 1, 2), cn AS (SELECT activity, count(*)::DOUBLE AS n FROM lg GROUP BY 1),
gr AS (SELECT a.activity AS source, b.activity AS target, coalesce(rw.n, 0) AS n, CASE WHEN rw.n > 0 THEN near / rw.n ELSE 0 END AS near, CASE WHEN rw.n > 0 THEN alike / rw.n ELSE 0 END AS alike, CASE WHEN rw.n > 0 THEN {_SIM.format(a="a.activity", b="b.activity")} ELSE 0 END AS nm FROM cn a CROSS JOIN cn b LEFT JOIN rw ON source = a.activity AND target = b.activity),
m1 AS (SELECT source, target, {ef} AS edge_frequency, {norm('near')} AS proximity, {norm('nm')} AS endpoint, {norm('alike')} AS originator FROM gr),
m2 AS (SELECT *, {norm('edge_frequency')} AS link, {norm('(proximity + endpoint + originator)')} AS tie FROM m1),
ou AS (SELECT source AS activity, sum(link * tie) AS o FROM m2 WHERE source <> target GROUP BY 1), it AS (SELECT target AS activity, sum(link * tie) AS i FROM m2 WHERE source <> target GROUP BY 1),
a1 AS (SELECT activity, n, {norm('n')} AS frequency, CASE WHEN coalesce(o, 0) + coalesce(i, 0) = 0 THEN 0 ELSE abs(i - o) / (i + o) END AS lop FROM cn LEFT JOIN ou USING (activity) LEFT JOIN it USING (activity)),
a2 AS (SELECT *, {norm('frequency')} AS simple, {routing} * ({norm('lop')}) AS routing FROM a1),
m3 AS (SELECT m2.*, CASE WHEN p.simple + q.simple = 0 THEN 0 ELSE 1 - (p.simple + q.simple - 2 * link) / (p.simple + q.simple) END AS far FROM m2 JOIN a2 p ON p.activity = source JOIN a2 q ON q.activity = target), m4 AS (SELECT *, {norm('far')} AS distance FROM m3)"""


_LG = "lg AS (SELECT case_id, activity, ts, event_id, epoch_us(ts) AS us, {r} AS resource FROM log)"


@query(f"WITH {LINE_SQL}, {_LG.format(r='resource')}, {_fuzzy_sql('pow(2.7, 1 - distance)')} SELECT activity, n::BIGINT AS n, round(frequency, 6) AS frequency, round(routing, 6) AS routing, round((frequency + routing) / max(frequency + routing) OVER (), 6) AS significance FROM a2")
def g9_activity_significance(spark, d) -> DataFrame:
    return fuzzy.model(line_log(spark, d))[0]


@query(f"WITH {LINE_SQL}, {_LG.format(r='resource')}, {_fuzzy_sql('pow(2.7, 1 - distance)')} SELECT source, target, round(edge_frequency, 6) AS edge_frequency, round(distance, 6) AS distance, round(proximity, 6) AS proximity, round(endpoint, 6) AS endpoint, round(originator, 6) AS originator, round((edge_frequency + distance) / max(edge_frequency + distance) OVER (), 6) AS significance, round((proximity + endpoint + originator) / max(proximity + endpoint + originator) OVER (), 6) AS correlation FROM m4")
def g9_pair_measures(spark, d) -> DataFrame:
    return fuzzy.model(line_log(spark, d))[1]


@query(f"WITH {DAY_SQL}, {_LG.format(r='NULL::VARCHAR')}, {_fuzzy_sql('CASE WHEN distance <= 1 THEN 1.0 ELSE greatest((4.0 - distance + 1) / 4.0, 0.0) END', 0.5, True)} SELECT source, target, round(edge_frequency, 6) AS edge_frequency, round(distance, 6) AS distance, round(proximity, 6) AS proximity, round(endpoint, 6) AS endpoint, round(originator, 6) AS originator, round((edge_frequency + distance) / max(edge_frequency + distance) OVER (), 6) AS significance, round((proximity + endpoint + originator) / max(proximity + endpoint + originator) OVER (), 6) AS correlation FROM m4")
def g9_linear_inverted(spark, d) -> DataFrame:
    return fuzzy.model(day_log(spark, d), attenuation="linear", radical=4.0, weights={"routing": 0.5}, inverted=("edge_frequency",))[1]


BOX = (0.0, 0.5, 0.25, 1.0)
CONTACT_SQL = FLAT_SQL + """, q AS (SELECT DISTINCT event_id, activity, epoch_ms(ts) AS ts_ms, object_id, object_type FROM r WHERE object_type IN ('Order', 'Supplier')), lf AS (SELECT object_id, min(ts_ms) AS f, max(ts_ms) AS l FROM q GROUP BY 1),
rl AS (SELECT q.*, CASE WHEN f = l THEN 0.5 ELSE (ts_ms - f)::DOUBLE / (l - f) END AS phase, l - f AS life, count(*) OVER (PARTITION BY event_id, object_type) AS n FROM q JOIN lf USING (object_id)),
ct AS (SELECT a.event_id, a.activity, a.ts_ms, a.object_id AS object_a, b.object_id AS object_b, a.phase AS phase_a, b.phase AS phase_b, a.life AS lifetime_a, b.life AS lifetime_b, a.n AS count_a, b.n AS count_b, a.n * b.n AS pairs FROM rl a JOIN rl b ON a.event_id = b.event_id AND a.object_type = 'Order' AND b.object_type = 'Supplier'),
bx AS (SELECT * FROM ct WHERE phase_a BETWEEN 0.0 AND 0.5 AND phase_b BETWEEN 0.25 AND 1.0), mb AS (SELECT 'event' AS kind, event_id AS id FROM bx UNION SELECT 'object', object_a FROM bx UNION SELECT 'object', object_b FROM bx)"""


def _contacts(spark, d) -> DataFrame:
    return fields.contacts(order_ocel(spark, d), "Order", "Supplier")


def _picked(spark, d) -> DataFrame:
    return _contacts(spark, d).where(fields.inside(BOX))


@query(f"WITH {CONTACT_SQL} SELECT * REPLACE (round(phase_a, 9) AS phase_a, round(phase_b, 9) AS phase_b) FROM bx ORDER BY ts_ms, event_id, object_a, object_b LIMIT 25 OFFSET 10")
def f33_detail_page(spark, d) -> DataFrame:
    return fields.page(_picked(spark, d), 25, 10).withColumns({c: F.round(c, 9) for c in ("phase_a", "phase_b")})


@query(f"WITH {CONTACT_SQL} SELECT count(*) AS contacts, min(lifetime_a) AS min_lifetime_a, median(lifetime_a) AS median_lifetime_a, max(lifetime_a) AS max_lifetime_a, min(lifetime_b) AS min_lifetime_b, median(lifetime_b) AS median_lifetime_b, max(lifetime_b) AS max_lifetime_b, count(*) FILTER (WHERE count_a = 1 AND count_b = 1) AS one_one, count(*) FILTER (WHERE count_a = 1 AND count_b > 1) AS one_many, count(*) FILTER (WHERE count_a > 1 AND count_b = 1) AS many_one, count(*) FILTER (WHERE count_a > 1 AND count_b > 1) AS many_many FROM bx")
def f33_field_summary(spark, d) -> DataFrame:
    return fields.summary(_picked(spark, d))


@query(f"""WITH {CONTACT_SQL}, ce AS (SELECT avg(phase_a) AS ca, avg(phase_b) AS cb FROM bx),
k AS (SELECT bx.*, row_number() OVER (ORDER BY ts_ms, event_id, object_a, object_b) AS k1, row_number() OVER (ORDER BY ts_ms DESC, event_id DESC, object_a DESC, object_b DESC) AS k2, row_number() OVER (ORDER BY pairs DESC, ts_ms, event_id, object_a, object_b) AS k3, row_number() OVER (ORDER BY round(pow(phase_a - ca, 2) + pow(phase_b - cb, 2), 12), ts_ms, event_id, object_a, object_b) AS k4 FROM bx, ce)
SELECT reason, event_id, object_a, object_b, ts_ms, pairs FROM (SELECT *, unnest(['earliest', 'latest', 'most pairs', 'centre']) AS reason, unnest([k1, k2, k3, k4]) AS kk FROM k) WHERE kk = 1""")
def f33_representatives(spark, d) -> DataFrame:
    return fields.representatives(_picked(spark, d)).select("reason", "event_id", "object_a", "object_b", "ts_ms", "pairs")


@query(f"WITH {CONTACT_SQL} SELECT least(floor(phase_a * 24), 23)::INTEGER AS bin_a, least(floor(phase_b * 24), 23)::INTEGER AS bin_b, round(sum(CASE WHEN i THEN 1.0::DOUBLE / pairs ELSE 0 END), 9) AS mass_in, count(*) FILTER (WHERE i) AS n_in, round(sum(CASE WHEN i THEN 0 ELSE 1.0::DOUBLE / pairs END), 9) AS mass_out, count(*) FILTER (WHERE NOT i) AS n_out FROM (SELECT *, phase_a BETWEEN 0.0 AND 0.5 AND phase_b BETWEEN 0.25 AND 1.0 AS i FROM ct) GROUP BY 1, 2")
def f33_field_partition(spark, d) -> DataFrame:
    return fields.partition(_contacts(spark, d), BOX)


@query(f"WITH {CONTACT_SQL} SELECT * FROM mb")
def f33_cohort(spark, d) -> DataFrame:
    return fields.cohort(_picked(spark, d))


@query(f"""WITH {CONTACT_SQL}, m2 AS (SELECT 'event' AS kind, event_id AS id FROM ct WHERE phase_b > 0.75 UNION SELECT 'object', object_a FROM ct WHERE phase_b > 0.75 UNION SELECT 'object', object_b FROM ct WHERE phase_b > 0.75)
SELECT 'union' AS how, kind, count(*) AS n FROM (SELECT * FROM mb UNION SELECT * FROM m2) GROUP BY 2 UNION ALL SELECT 'intersection', kind, count(*) FROM (SELECT * FROM mb INTERSECT SELECT * FROM m2) GROUP BY 2 UNION ALL SELECT 'difference', kind, count(*) FROM (SELECT * FROM mb EXCEPT SELECT * FROM m2) GROUP BY 2""")
def f33_cohort_algebra(spark, d) -> DataFrame:
    both = fields.cohorts(_contacts(spark, d), one=fields.inside(BOX), two=F.col("phase_b") > 0.75)
    hows = {"union": F.lit(True), "intersection": F.col("one") & F.col("two"), "difference": F.col("one") & ~F.col("two")}
    n = both.groupBy("kind").agg(*[F.count_if(x).alias(how) for how, x in hows.items()])  # a row a kind
    return n.unpivot("kind", list(hows), "how", "n").where("n > 0").select("how", "kind", "n")


@query(f"""WITH {CONTACT_SQL}, vl AS (SELECT event_id AS id, 'activity' AS field, activity AS value FROM ev UNION ALL SELECT event_id, name, value FROM ea), x AS (SELECT vl.*, id IN (SELECT id FROM mb WHERE kind = 'event') AS i FROM vl),
n AS (SELECT field, value, count(*) FILTER (WHERE i) AS n_in, count(*) FILTER (WHERE NOT i) AS n_out FROM x GROUP BY 1, 2) SELECT field, value, n_in, n_out, round(n_in / sum(n_in) OVER (PARTITION BY field), 9) AS share_in, round(n_out / sum(n_out) OVER (PARTITION BY field), 9) AS share_out FROM n""")
def f33_in_and_out(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    values = log.events.select(F.col("event_id").alias("id"), F.lit("activity").alias("field"), F.col("activity").alias("value")).unionAll(log.event_attr.select("event_id", "name", "value"))
    return fields.in_and_out(values, fields.cohort(_picked(spark, d)))


@query(f"""WITH {CONTACT_SQL}, o0 AS (SELECT DISTINCT id FROM mb WHERE kind = 'object' AND id LIKE 's:1'), e0 AS (SELECT DISTINCT event_id FROM e2o WHERE object_id IN (SELECT id FROM o0)), o1 AS (SELECT DISTINCT object_id AS id FROM e2o WHERE event_id IN (SELECT event_id FROM e0) EXCEPT SELECT id FROM o0),
e1 AS (SELECT DISTINCT event_id FROM e2o WHERE object_id IN (SELECT id FROM o1) EXCEPT SELECT event_id FROM e0)
SELECT 0 AS distance, (SELECT count(*) FROM o0) AS objects, (SELECT count(*) FROM e0) AS events UNION ALL SELECT 1, (SELECT count(*) FROM o1), (SELECT count(*) FROM e1)""")
def f33_ripple(spark, d) -> DataFrame:
    """What the first supplier of the cohort reaches in a step: its events' objects, and their events."""
    members = fields.cohort(_picked(spark, d)).where("kind = 'object' and id like 's:1'")
    return fields.ripple(order_ocel(spark, d), members, 1)
