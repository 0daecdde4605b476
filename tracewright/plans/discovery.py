"""Discovery queries: directly-follows graphs, variants, footprints, rules, social networks and resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EventLog, micros
from ..operators import miners, profile, relations
from ..sources.tables import DAY_SQL, FLAT_SQL, LINE_SQL, USER_SQL, day_log, line_log, order_ocel, table, user_log
from .registry import query

DF = "df AS (SELECT source, target, count(*) AS n FROM (SELECT activity AS source, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS target FROM log) WHERE target IS NOT NULL GROUP BY 1, 2)"
SEQ = "sq AS (SELECT case_id, list(activity ORDER BY ts, event_id) AS seq FROM log GROUP BY 1)"


@query(f"WITH {USER_SQL}, {DF} SELECT source, target, n FROM df")
def g1_directly_follows(spark, d) -> DataFrame:
    return relations.directly_follows(user_log(spark, d))


@query(f"WITH {USER_SQL} SELECT activity, count(*) AS n, count(*) FILTER (WHERE a IS NULL) AS starts, count(*) FILTER (WHERE z IS NULL) AS ends FROM (SELECT activity, lag(activity) OVER w AS a, lead(activity) OVER w AS z FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)) GROUP BY 1")
def g1_starts_and_ends(spark, d) -> DataFrame:
    return relations.ends(user_log(spark, d))


@query(f"WITH {LINE_SQL}, {SEQ} SELECT coalesce(array_to_string(seq, '>'), '') AS seq, count(*) AS n FROM cases LEFT JOIN sq USING (case_id) GROUP BY 1")
def g2_variants(spark, d) -> DataFrame:
    return relations.variants(line_log(spark, d)).select(F.array_join("seq", ">").alias("seq"), "n")


FOOT = "nm AS (SELECT DISTINCT activity FROM log), fp AS (SELECT x.activity AS a, y.activity AS b, EXISTS (SELECT 1 FROM df WHERE source = x.activity AND target = y.activity) AS ab, EXISTS (SELECT 1 FROM df WHERE source = y.activity AND target = x.activity) AS ba FROM nm x, nm y)"


@query(f"WITH {LINE_SQL}, {DF}, {FOOT} SELECT a, b, CASE WHEN ab AND ba THEN '||' WHEN ab THEN '->' WHEN ba THEN '<-' ELSE '#' END AS relation FROM fp")
def g3_footprint(spark, d) -> DataFrame:
    return relations.footprint(line_log(spark, d))


def year_log(spark, d) -> EventLog:
    """A case for each customer, its events the years in which it ordered."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").alias("ts"))
    case = F.col("o_custkey").cast("string")
    return EventLog(o.select(case.alias("case_id"), F.col("y").cast("string").alias("activity"), "ts", F.concat_ws(":", case, F.col("y")).alias("event_id")))


@query()
def g3_alpha_places(spark, d) -> DataFrame:
    return miners.alpha_places(spark, relations.footprint(year_log(spark, d)))


DEP = "dp AS (SELECT x.source, x.target, x.n, coalesce(y.n, 0) AS back, CASE WHEN x.source = x.target THEN x.n / (x.n + 1) ELSE (x.n - coalesce(y.n, 0)) / (x.n + coalesce(y.n, 0) + 1) END AS dependency FROM df x LEFT JOIN df y ON y.source = x.target AND y.target = x.source)"


@query(f"WITH {LINE_SQL}, {DF}, {DEP} SELECT * FROM dp")
def g4_dependencies(spark, d) -> DataFrame:
    return relations.dependencies(line_log(spark, d))


@query(f"""WITH {LINE_SQL}, {DF}, {DEP}, z AS (SELECT *, max(dependency) FILTER (WHERE source <> target) OVER (PARTITION BY source) AS bo, max(dependency) FILTER (WHERE source <> target) OVER (PARTITION BY target) AS bi FROM dp)
SELECT source, target, n, dependency FROM z WHERE (source <> target AND (dependency = bo OR dependency = bi)) OR (dependency >= 0.9 AND (source = target OR bo - dependency <= 0.05 OR bi - dependency <= 0.05))""")
def g4_heuristics(spark, d) -> DataFrame:
    return relations.kept_dependencies(line_log(spark, d))


@query()
def g6_inductive_tree(spark, d) -> DataFrame:
    return miners.inductive(relations.variants(day_log(spark, d)), noise=0.2)


@query(f"""WITH {LINE_SQL}, e AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS pos FROM log), g AS (SELECT *, lag(pos) OVER (PARTITION BY case_id, activity ORDER BY pos) AS prior FROM e), m AS (SELECT activity, min(pos - prior) AS gap FROM g WHERE prior IS NOT NULL GROUP BY 1)
SELECT DISTINCT g.activity, e.activity AS "between" FROM g JOIN m ON m.activity = g.activity AND g.pos - g.prior = m.gap JOIN e ON e.case_id = g.case_id AND e.pos > g.prior AND e.pos < g.pos""")
def g7_self_distance(spark, d) -> DataFrame:
    return relations.self_distance(line_log(spark, d))


@query()
def g8_tree_to_net(spark, d) -> DataFrame:
    return miners.net_table(spark, miners.tree_to_net(miners.mine_table(relations.variants(day_log(spark, d)), 0.2)))


LB = "lb AS (" + " UNION ALL ".join(f"SELECT {k} AS distance, lag(activity, {k}) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS source, activity AS target FROM log" for k in range(1, 6)) + ")"


@query(f"WITH {USER_SQL}, {LB}, w AS (SELECT source, target, count(*) AS n, sum(pow(2.7, 1 - distance)) AS w FROM lb WHERE source IS NOT NULL GROUP BY 1, 2) SELECT source, target, n, round(w / max(w) OVER (), 6) AS frequency FROM w")
def g9_fuzzy_significance(spark, d) -> DataFrame:
    return relations.fuzzy_significance(user_log(spark, d))


@query(f"WITH {USER_SQL}, p AS (SELECT lag(activity) OVER w AS source, activity AS target, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS gap FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)) SELECT source, target, round(avg(CASE WHEN gap > 0 THEN 1.0 / gap ELSE 1.0 END), 12) AS proximity FROM p WHERE source IS NOT NULL GROUP BY 1, 2")
def g9_proximity(spark, d) -> DataFrame:
    return relations.proximity(user_log(spark, d))


@query()
def g10_split_filter(spark, d) -> DataFrame:
    return miners.split_filter(spark, relations.directly_follows(line_log(spark, d)), relations.ends(line_log(spark, d)))


RULE = """e AS (SELECT case_id, activity, row_number() OVER w AS pos, lead(activity) OVER w AS nx FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)), po AS (SELECT case_id, activity, count(*) AS k, min(pos) AS f, max(pos) AS l FROM e GROUP BY 1, 2),
nm AS (SELECT activity, CAST(sum(k) AS BIGINT) AS n, count(*) AS c FROM po GROUP BY 1),
rc AS (SELECT x.activity AS a, y.activity AS b, max(x.n) AS activations, max(x.n) - count(*) FILTER (WHERE p.l > e.pos) AS response, max(x.n) - count(*) FILTER (WHERE p.f < e.pos) AS preceded, max(x.n) - count(p.f) AS responded, max(x.n) - count(*) FILTER (WHERE e.nx = y.activity) AS chain, max(x.c) + max(y.c) - 2 * count(DISTINCT CASE WHEN p.f IS NOT NULL THEN e.case_id END) AS coexistence
FROM nm x JOIN nm y ON x.activity <> y.activity JOIN e ON e.activity = x.activity LEFT JOIN po p ON p.case_id = e.case_id AND p.activity = y.activity GROUP BY 1, 2)"""


@query(f"WITH {DAY_SQL}, {RULE} SELECT * FROM rc")
def g19_rule_counts(spark, d) -> DataFrame:
    return relations.rule_counts(day_log(spark, d))


@query(f"""WITH {LINE_SQL}, {RULE}, x AS (SELECT 'response' AS template, a, b, activations, response AS violations FROM rc UNION ALL SELECT 'precedence', a, b, activations, preceded FROM rc UNION ALL SELECT 'responded existence', a, b, activations, responded FROM rc UNION ALL SELECT 'chain response', a, b, activations, chain FROM rc) SELECT * FROM x WHERE 1 - violations / activations >= 0.4""")
def g19_declare(spark, d) -> DataFrame:
    return relations.declare_rules(line_log(spark, d), 0.4)


@query(f"WITH {DAY_SQL}, k AS (SELECT case_id, activity, count(*) AS k, bool_or(i IS NULL) AS i, bool_or(l IS NULL) AS l FROM (SELECT case_id, activity, lag(activity) OVER w AS i, lead(activity) OVER w AS l FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)) GROUP BY 1, 2) SELECT activity, count(*) AS existence, count(*) FILTER (WHERE k = 1) AS exactly_once, count(*) FILTER (WHERE i) AS init, count(*) FILTER (WHERE l) AS last FROM k GROUP BY 1")
def g19_unary(spark, d) -> DataFrame:
    return relations.unary_rules(day_log(spark, d))


@query(f"""WITH {LINE_SQL}, {DF}, {RULE}, tg AS (SELECT x.activity AS a, y.activity AS b, count(*) AS bo, count(*) FILTER (WHERE x.k = y.k) AS same FROM po x JOIN po y ON x.case_id = y.case_id AND x.activity <> y.activity GROUP BY 1, 2)
SELECT 'always-after' AS relation, a, b FROM rc WHERE response <= activations * 0.35 UNION ALL SELECT 'always-before', a, b FROM rc WHERE preceded <= activations * 0.35 UNION ALL SELECT 'never-together', a, b FROM rc WHERE a < b AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.a = rc.a AND tg.b = rc.b)
UNION ALL SELECT 'equivalence', tg.a, tg.b FROM tg JOIN nm x ON x.activity = tg.a JOIN nm y ON y.activity = tg.b WHERE same = x.c AND x.c = y.c AND tg.a < tg.b UNION ALL SELECT 'directly-follows', source, target FROM df""")
def g20_skeleton(spark, d) -> DataFrame:
    return relations.skeleton(line_log(spark, d), 0.35)


HAND = "hv AS (SELECT case_id, source, target, max(w) AS w FROM (" + " UNION ALL ".join(f"SELECT case_id, lag(resource, {k}) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS source, resource AS target, {0.5 ** (k - 1)} AS w FROM log" for k in (1, 2)) + ") WHERE source IS NOT NULL AND source <> target GROUP BY 1, 2, 3)"


@query(f"WITH {LINE_SQL}, {HAND} SELECT source, target, round(CAST(sum(w) AS DOUBLE), 9) AS weight FROM hv GROUP BY 1, 2")
def g21_handover(spark, d) -> DataFrame:
    return relations.handover(line_log(spark, d), most=2)


@query(f"WITH {LINE_SQL}, c AS (SELECT DISTINCT case_id, resource FROM log), n AS (SELECT resource, count(*) AS n FROM c GROUP BY 1), p AS (SELECT x.resource AS a, y.resource AS b, count(*) AS cases FROM c x JOIN c y ON x.case_id = y.case_id AND x.resource < y.resource GROUP BY 1, 2) SELECT a, b, cases, cases / (x.n + y.n - cases) AS jaccard FROM p JOIN n x ON x.resource = a JOIN n y ON y.resource = b")
def g21_working_together(spark, d) -> DataFrame:
    return relations.working_together(line_log(spark, d))


@query(f"WITH {LINE_SQL} SELECT source, target, count(*) AS n FROM (SELECT resource AS back, lag(resource, 1) OVER w AS target, lag(resource, 2) OVER w AS source FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)) WHERE source = back AND source <> target GROUP BY 1, 2")
def g21_subcontracting(spark, d) -> DataFrame:
    return relations.subcontracting(line_log(spark, d))


@query(f"""WITH {LINE_SQL}, k AS (SELECT resource, activity, CAST(count(*) AS DOUBLE) AS x FROM log GROUP BY 1, 2), m AS (SELECT CAST(count(DISTINCT activity) AS DOUBLE) AS m FROM log), s AS (SELECT resource, sum(x) AS s, sum(x * x) AS q FROM k GROUP BY 1), p AS (SELECT u.resource AS a, v.resource AS b, sum(u.x * v.x) AS xy FROM k u JOIN k v ON u.activity = v.activity AND u.resource < v.resource GROUP BY 1, 2)
SELECT a, b, round(CASE WHEN m * u.q - u.s * u.s > 0 AND m * v.q - v.s * v.s > 0 THEN (m * xy - u.s * v.s) / sqrt((m * u.q - u.s * u.s) * (m * v.q - v.s * v.s)) END, 9) AS pearson, round(xy / sqrt(u.q * v.q), 9) AS cosine, round(1 / (1 + sqrt(greatest(u.q + v.q - 2 * xy, 0))), 9) AS euclid FROM p JOIN s u ON u.resource = a JOIN s v ON v.resource = b, m""")
def g22_similar_task(spark, d) -> DataFrame:
    return relations.similar_task(line_log(spark, d))


@query(f"""WITH {LINE_SQL}, k AS (SELECT resource, activity, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY resource) AS p FROM log GROUP BY 1, 2), s AS (SELECT resource, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0.0 END, 9) AS spread, max(p) AS top_share FROM k GROUP BY 1)
SELECT resource, count(*) AS events, count(DISTINCT activity) AS activities, count(DISTINCT case_id) AS cases, count(DISTINCT date_trunc('day', ts)) AS active_days, max(spread) AS spread, max(top_share) AS top_share FROM log JOIN s USING (resource) GROUP BY 1""")
def g25_resource_profiles(spark, d) -> DataFrame:
    return relations.resource_profiles(line_log(spark, d))


def items(spark, d) -> DataFrame:
    """Work items: a line from its order's date to its shipping, by supplier, where these are in order."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    from ..sources.tables import line_id

    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate > o_orderdate")
    return x.select(F.col("l_suppkey").cast("string").alias("resource"), line_id().alias("item"), F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_returnflag").alias("activity"), micros("o_orderdate").alias("start"), micros("l_shipdate").alias("end"))


ITEMS = "it AS (SELECT CAST(l_suppkey AS VARCHAR) AS resource, " + LINE_SQL.split(" AS ts, ")[1].split(" AS event_id")[0] + " AS item, epoch_us(o_orderdate) AS s, epoch_us(l_shipdate) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"


@query(f"""WITH {ITEMS}, p AS (SELECT resource, t, sum(s) AS s FROM (SELECT resource, s AS t, 1 AS s FROM it UNION ALL SELECT resource, e, -1 FROM it) GROUP BY 1, 2), q AS (SELECT resource, sum(s) OVER w AS depth, lead(t) OVER w - t AS len FROM p WINDOW w AS (PARTITION BY resource ORDER BY t))
SELECT resource, CAST(sum(CASE WHEN depth >= 1 THEN len ELSE 0 END) AS BIGINT) AS busy_us, CAST(sum(CASE WHEN depth >= 2 THEN len ELSE 0 END) AS BIGINT) AS overlap_us FROM q GROUP BY 1""")
def g27_busy_time(spark, d) -> DataFrame:
    return relations.busy_time(items(spark, d))


@query(f"WITH {ITEMS} SELECT a.resource, a.item, (SELECT count(*) FROM it b WHERE a.resource = b.resource AND b.s <= a.s AND b.e > a.s) AS concurrent FROM it a")
def g28_workload(spark, d) -> DataFrame:
    return relations.workload(items(spark, d))


@query(f"""WITH {LINE_SQL}, r AS (SELECT *, sum(CASE WHEN p = activity AND t - pt <= 86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY resource ORDER BY ts, event_id) AS run FROM (SELECT *, epoch_us(ts) AS t, lag(activity) OVER w AS p, lag(epoch_us(ts)) OVER w AS pt FROM log WINDOW w AS (PARTITION BY resource ORDER BY ts, event_id)))
SELECT resource, activity, size, count(*) AS runs FROM (SELECT resource, run, activity, count(*) AS size FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1, 2, 3""")
def g29_batches(spark, d) -> DataFrame:
    return relations.batches(line_log(spark, d), 86_400_000_000)


@query(f"WITH {LINE_SQL} SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS bucket, resource, count(*) AS n FROM log GROUP BY 1, 2")
def g30_calendar(spark, d) -> DataFrame:
    return relations.calendar(line_log(spark, d))


@query(f"WITH {USER_SQL}, {DF} SELECT source, target, n FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, source, target ROWS UNBOUNDED PRECEDING) - n AS b, sum(n) OVER () AS t FROM df) WHERE b < 0.6 * t")
def v6_cumulative_prune(spark, d) -> DataFrame:
    return relations.cumulative_prune(relations.directly_follows(user_log(spark, d)), "n", 0.6, "source", "target")


@query(f"WITH {FLAT_SQL}, x AS (SELECT object_type, activity AS source, lead(activity) OVER (PARTITION BY object_type, object_id ORDER BY ts, event_id) AS target FROM (SELECT DISTINCT object_type, object_id, event_id, activity, ts FROM r)), c AS (SELECT object_type, source, target, count(*) AS n FROM x WHERE target IS NOT NULL GROUP BY 1, 2, 3) SELECT object_type, source, target, n FROM (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY n DESC, source, target) AS k FROM c) WHERE k <= 2")
def v7_top_arcs(spark, d) -> DataFrame:
    return relations.top_arcs(profile.ocdfg(order_ocel(spark, d))[1].drop("mean_us"), "object_type", 2)


@query(f"WITH {LINE_SQL}, {DF} SELECT source, target, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS a, row_number() OVER (PARTITION BY target ORDER BY n DESC, source) AS b FROM df) WHERE a = 1 OR b = 1")
def v2_best_edges(spark, d) -> DataFrame:
    return relations.best_edges(relations.directly_follows(line_log(spark, d)), "n")


@query(f"WITH {LINE_SQL}, {DF}, x AS (SELECT *, n / sum(n) OVER (PARTITION BY source) + n / sum(n) OVER (PARTITION BY target) AS r FROM df WHERE source <> target) SELECT x.source, x.target, x.n FROM x LEFT JOIN x y ON y.source = x.target AND y.target = x.source WHERE y.r IS NULL OR (x.r > 0.3 AND y.r > 0.3) OR (least(x.r, y.r) / greatest(x.r, y.r) < 0.9 AND x.r > y.r)")
def v1_concurrency_filter(spark, d) -> DataFrame:
    return relations.concurrency_filter(relations.directly_follows(line_log(spark, d)), 0.3, 0.9)
