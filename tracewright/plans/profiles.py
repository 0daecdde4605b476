"""Profiling, performance and object-centric analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import olap, profile
from ..sources.tables import DAY_SQL, FLAT_SQL, LINE_SQL, OCEL_SQL, USER_SQL, day_log, line_log, order_ocel, table, user_log
from .registry import query
from .transforms import ASOF

STREAM = "s AS (SELECT *, epoch_us(ts) // 1000 AS t, lag(activity) OVER w AS prev, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS wait_ms, row_number() OVER w AS pos, count(*) OVER (PARTITION BY case_id) AS len FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))"


@query(f"WITH {USER_SQL}, {STREAM} SELECT case_id, event_id, activity, prev, wait_ms, pos, len FROM s")
def f1_entity_stream(spark, d) -> DataFrame:
    return profile.entity_stream(user_log(spark, d)).select("case_id", "event_id", "activity", "prev", "wait_ms", "pos", "len")


@query(f"""WITH {USER_SQL}, {STREAM}, rw AS (SELECT activity, avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) AS rework FROM (SELECT case_id, activity, count(*) AS k FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT activity, count(*) AS n, count(DISTINCT case_id) AS entities, count(*) FILTER (WHERE pos = 1) AS starts, count(*) FILTER (WHERE pos = len) AS ends, count(*) FILTER (WHERE prev = activity) AS self_loops, median(wait_ms) AS median_wait, quantile_cont(wait_ms, 0.9) AS p90_wait, avg(wait_ms) AS mean_wait, min(wait_ms) AS min_wait, max(wait_ms) AS max_wait, CAST(sum(wait_ms) AS BIGINT) AS total_wait, median(pos) AS median_pos, rework FROM s JOIN rw USING (activity) GROUP BY activity, rework""")
def f2_activity_stats(spark, d) -> DataFrame:
    return profile.activity_stats(user_log(spark, d))


@query(f"WITH {USER_SQL}, {STREAM} SELECT prev, activity, count(*) AS n, count(DISTINCT case_id) AS entities, median(wait_ms) AS median_wait, quantile_cont(wait_ms, 0.9) AS p90_wait, CAST(sum(wait_ms) AS BIGINT) AS total_wait FROM s WHERE prev IS NOT NULL GROUP BY 1, 2")
def f3_edge_stats(spark, d) -> DataFrame:
    return profile.edge_stats(user_log(spark, d))


@query(f"WITH {USER_SQL}, {STREAM}, c AS (SELECT case_id, count(*) AS n, min(t) AS a, max(t) AS z, sum(wait_ms) AS w FROM s GROUP BY 1) SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS events, median(z - a) AS median_cycle, quantile_cont(z - a, 0.9) AS p90_cycle, max(z) - min(a) AS span, CAST(sum(w) AS BIGINT) AS total_wait, (SELECT count(DISTINCT activity) FROM s) AS activities FROM c")
def f4_overview(spark, d) -> DataFrame:
    return profile.overview(user_log(spark, d))


@query(f"WITH {USER_SQL}, {STREAM} SELECT CAST(hour(ts) AS VARCHAR) AS bucket, count(*) AS n, median(wait_ms) AS median_wait, CAST(sum(wait_ms) AS BIGINT) AS total_wait FROM s WHERE activity = 'purchase' AND wait_ms IS NOT NULL GROUP BY 1 ORDER BY total_wait DESC, bucket LIMIT 24")
def f5_wait_by_hour(spark, d) -> DataFrame:
    return profile.wait_breakdown(user_log(spark, d), "purchase", F.hour("ts"))


@query(f"WITH {OCEL_SQL} SELECT name, count(DISTINCT value) AS n_values FROM oa GROUP BY 1 HAVING count(DISTINCT value) BETWEEN 2 AND 40")
def f6_attribute_keys(spark, d) -> DataFrame:
    return profile.low_cardinality(order_ocel(spark, d).object_attr)


@query(f"""WITH {DAY_SQL}, {STREAM}, c AS (SELECT case_id, string_agg(activity, '>' ORDER BY pos) AS signature, max(t) - min(t) AS cycle, sum(wait_ms) FILTER (WHERE activity = 'click') AS wait_here FROM s GROUP BY 1 HAVING bool_or(activity = 'click'))
SELECT signature, count(*) AS entities, median(cycle) AS median_cycle, median(wait_here) AS median_wait_here, min(case_id) AS example FROM c GROUP BY 1""")
def f7_variants_through(spark, d) -> DataFrame:
    return profile.variants_through(day_log(spark, d), "click")


@query(f"""WITH {USER_SQL}, {STREAM} SELECT case_id, events, cycle, worst_wait, CAST(sum_wait AS BIGINT) AS sum_wait FROM (SELECT case_id, max(wait_ms) AS worst_wait, sum(wait_ms) AS sum_wait FROM s WHERE activity = 'error' GROUP BY 1 HAVING max(wait_ms) IS NOT NULL ORDER BY worst_wait DESC, case_id LIMIT 60) JOIN (SELECT case_id, count(*) AS events, max(t) - min(t) AS cycle FROM s GROUP BY 1) USING (case_id)""")
def f8_worst_cases(spark, d) -> DataFrame:
    return profile.worst_cases(user_log(spark, d), "error")


@query(f"WITH {USER_SQL}, {STREAM} SELECT pos, activity, wait_ms FROM s WHERE case_id = '7'")
def f9_case_route(spark, d) -> DataFrame:
    log = user_log(spark, d)
    return profile.entity_stream(type(log)(log.events.where("case_id = '7'"))).select("pos", "activity", "wait_ms")


SPECTRUM = "g AS (SELECT case_id, event_id, activity AS source, lead(activity) OVER w AS target, epoch_us(ts) AS start, epoch_us(lead(ts) OVER w) AS \"end\" FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))"


@query(f"WITH {USER_SQL}, {SPECTRUM} SELECT *, \"end\" - start AS duration, CAST(ntile(4) OVER (PARTITION BY source, target ORDER BY \"end\" - start, case_id, start, event_id) AS INTEGER) AS quartile FROM g WHERE target IS NOT NULL")
def f12_performance_spectrum(spark, d) -> DataFrame:
    return profile.spectrum(user_log(spark, d))


@query(f"WITH {USER_SQL} SELECT case_id, event_id, activity, epoch_us(ts) AS t, epoch_us(min(ts) OVER p) AS first_t, epoch_us(max(ts) OVER p) AS last_t, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) - 1 AS logical_idx FROM log WINDOW p AS (PARTITION BY case_id)")
def f13_dotted_chart(spark, d) -> DataFrame:
    return profile.dotted_chart(user_log(spark, d))


@query("""WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) AS gap FROM events), n AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS active_days, (SELECT median(n) FROM n) AS median_per_day, (SELECT max(n) FROM n) AS busiest, (SELECT median(gap) FROM g) AS median_gap_us, avg(CASE WHEN epoch_us(ts) % 1000000 = 0 THEN 1.0 ELSE 0.0 END) AS whole_second_share, avg(CASE WHEN epoch_us(ts) % 86400000000 = 0 THEN 1.0 ELSE 0.0 END) AS midnight_share, count(DISTINCT ts) / count(ts) AS distinct_share FROM events""")
def f14_timing_overview(spark, d) -> DataFrame:
    return profile.timing_overview(table(spark, d, "events"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def f14_hours(spark, d) -> DataFrame:
    return profile.by_hour(table(spark, d, "events"))


@query(f"""WITH {OCEL_SQL}, a AS (SELECT count(DISTINCT object_id) AS k FROM e2o GROUP BY event_id), b AS (SELECT count(DISTINCT event_id) AS k FROM e2o GROUP BY object_id)
SELECT (SELECT avg(k) FROM a) AS objects_per_event, (SELECT max(k) FROM a) AS max_objects, (SELECT avg(k) FROM b) AS events_per_object, (SELECT max(k) FROM b) AS max_events, (SELECT count(*) FROM ev WHERE event_id NOT IN (SELECT event_id FROM e2o)) AS lone_events, (SELECT count(*) FROM ob WHERE object_id NOT IN (SELECT object_id FROM e2o)) AS lone_objects, (SELECT count(DISTINCT qualifier) FROM e2o) AS qualifiers""")
def f15_structure(spark, d) -> DataFrame:
    return profile.structure(order_ocel(spark, d))


@query(f"WITH {OCEL_SQL}, g AS (SELECT target_id, count(*) + 1 AS size FROM o2o GROUP BY 1) SELECT count(*) AS components, max(size) AS largest FROM g")
def f16_o2o_components(spark, d) -> DataFrame:
    from ..operators.graph import component_sizes

    return component_sizes(order_ocel(spark, d).o2o, "source_id", "target_id")


@query(f"WITH {FLAT_SQL}, k AS (SELECT activity, object_type, event_id, count(*) AS k FROM r GROUP BY 1, 2, 3), a AS (SELECT activity, count(*) AS total FROM ev GROUP BY 1) SELECT activity, object_type, count(*) AS events, CAST(sum(k) AS BIGINT) AS relations, max(k) AS most, count(*) / max(total) AS share FROM k JOIN a USING (activity) GROUP BY 1, 2")
def f17_activity_type_matrix(spark, d) -> DataFrame:
    return profile.activity_type_matrix(order_ocel(spark, d))


PATHS = "pt AS (SELECT object_type, object_id, string_agg(activity, '>' ORDER BY ts, event_id) AS path, count(*) AS length FROM (SELECT DISTINCT object_type, object_id, event_id, activity, ts FROM r) GROUP BY 1, 2)"


@query(f"""WITH {FLAT_SQL}, {PATHS}, v AS (SELECT object_type, path, count(*) AS n FROM pt GROUP BY 1, 2), w AS (SELECT *, n / sum(n) OVER (PARTITION BY object_type) AS p, row_number() OVER (PARTITION BY object_type ORDER BY n DESC, path) AS k FROM v),
a AS (SELECT object_type, CAST(sum(n) AS BIGINT) AS objects, count(*) AS variants, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0.0 END, 9) AS entropy, max(path) FILTER (WHERE k = 1) AS top_path FROM w GROUP BY 1)
SELECT a.*, median_length, max_length FROM a JOIN (SELECT object_type, median(length) AS median_length, max(length) AS max_length FROM pt GROUP BY 1) USING (object_type)""")
def f18_type_lifecycles(spark, d) -> DataFrame:
    return profile.type_lifecycles(order_ocel(spark, d))


@query(f"WITH {FLAT_SQL} SELECT activity, object_type, qualifier, count(*) AS n FROM r GROUP BY 1, 2, 3")
def f19_relation_counts(spark, d) -> DataFrame:
    return olap.relations(order_ocel(spark, d)).groupBy("activity", "object_type", "qualifier").agg(F.count("*").alias("n"))


@query(f"WITH {FLAT_SQL} SELECT event_id, activity, ts, qualifier FROM r WHERE object_id = 'c:10'")
def f20_object_detail(spark, d) -> DataFrame:
    return olap.relations(order_ocel(spark, d)).where("object_id = 'c:10'").select("event_id", "activity", "ts", "qualifier")


@query(f"WITH {OCEL_SQL} SELECT object_id, name, value, n FROM (SELECT *, count(*) OVER (PARTITION BY object_id, name) AS n, row_number() OVER (PARTITION BY object_id, name ORDER BY ts DESC NULLS LAST, value) AS k FROM oa) WHERE k = 1")
def f21_latest_attribute(spark, d) -> DataFrame:
    a = order_ocel(spark, d).object_attr
    log = order_ocel(spark, d)
    n = a.groupBy("object_id", "name").agg(F.count("*").alias("n"))
    return profile.state_at(log, "9999-12-31").join(n, ["object_id", "name"])


@query(f"WITH {FLAT_SQL}, k AS (SELECT activity, object_type, event_id, count(DISTINCT object_id) AS k FROM r GROUP BY 1, 2, 3) SELECT activity, object_type, count(*) AS events, min(k) AS least, max(k) AS most, median(k) AS mid, avg(k) AS mean, count(*) FILTER (WHERE k = 1) AS exactly_one FROM k GROUP BY 1, 2")
def f22_multiplicity(spark, d) -> DataFrame:
    return profile.multiplicity(order_ocel(spark, d))


@query(f"WITH {FLAT_SQL}, s AS (SELECT event_id, activity, string_agg(DISTINCT object_type, '+' ORDER BY object_type) AS signature FROM r GROUP BY 1, 2) SELECT activity, signature, count(*) AS n FROM s GROUP BY 1, 2")
def f23_type_signatures(spark, d) -> DataFrame:
    return profile.type_signatures(order_ocel(spark, d))


@query(f"WITH {FLAT_SQL}, k AS (SELECT object_type, activity, object_id, count(DISTINCT event_id) AS k FROM r GROUP BY 1, 2, 3) SELECT object_type, activity, least(k, 5) AS times, count(*) AS objects FROM k GROUP BY 1, 2, 3")
def f24_repetition(spark, d) -> DataFrame:
    return profile.repetition(order_ocel(spark, d))


AB = "q AS (SELECT DISTINCT object_id, event_id, activity, epoch_us(ts) AS us FROM r WHERE object_type = 'Order')"


@query(f"WITH {FLAT_SQL}, {AB} SELECT a.object_id, a.event_id, min(b.us) - a.us AS delta_us FROM q a LEFT JOIN q b ON b.object_id = a.object_id AND b.activity = 'ship' AND b.us > a.us WHERE a.activity = 'place order' GROUP BY a.object_id, a.event_id, a.us")
def f25_first_after(spark, d) -> DataFrame:
    return profile.first_after(order_ocel(spark, d), "Order", "place order", "ship")


@query(f"WITH {FLAT_SQL}, {AB}, a AS (SELECT object_id, us, row_number() OVER (PARTITION BY object_id ORDER BY us) AS i FROM q WHERE activity = 'place order'), b AS (SELECT b.object_id, b.us, row_number() OVER (PARTITION BY b.object_id ORDER BY b.us, b.event_id) AS k FROM q b JOIN a ON a.object_id = b.object_id AND a.i = 1 AND b.us > a.us WHERE b.activity = 'ship') SELECT a.object_id, a.i AS k, b.us - a.us AS delta_us FROM a JOIN b ON a.object_id = b.object_id AND a.i = b.k")
def f25_next_after(spark, d) -> DataFrame:
    return profile.next_after(order_ocel(spark, d), "Order", "place order", "ship")


@query(f"WITH {OCEL_SQL} SELECT activity, name, value, count(*) AS n FROM ea JOIN ev USING (event_id) GROUP BY 1, 2, 3")
def f26_event_attributes(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return log.event_attr.join(log.events, "event_id").groupBy("activity", "name", "value").agg(F.count("*").alias("n"))


@query(f"WITH {FLAT_SQL}, {ASOF} SELECT activity, value, count(*) AS n FROM aso JOIN ev USING (event_id) GROUP BY 1, 2")
def f27_attribute_as_of(spark, d) -> DataFrame:
    from ..operators import joins

    log = order_ocel(spark, d)
    return joins.attribute_as_of(log, "Customer", "last_priority").join(log.events, "event_id").groupBy("activity", "value").agg(F.count("*").alias("n"))


@query(f"WITH {OCEL_SQL} SELECT object_id, ts, value, lag(value) OVER (PARTITION BY object_id ORDER BY ts NULLS FIRST, value) AS previous, count(*) OVER (PARTITION BY object_id) AS changes FROM oa WHERE name = 'last_priority'")
def f28_history(spark, d) -> DataFrame:
    return profile.history(order_ocel(spark, d), "last_priority")


@query(f"WITH {FLAT_SQL} SELECT DISTINCT object_id, ts, 'event' AS kind, activity AS what FROM r UNION ALL SELECT object_id, ts, 'change', name || '=' || value FROM oa WHERE ts IS NOT NULL")
def f28_timeline(spark, d) -> DataFrame:
    return profile.timeline(order_ocel(spark, d))


@query(f"WITH {OCEL_SQL} SELECT object_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY object_id, name ORDER BY ts DESC NULLS LAST, value) AS k FROM oa WHERE ts IS NULL OR ts <= TIMESTAMP '1996-06-01') WHERE k = 1")
def f28_state_at(spark, d) -> DataFrame:
    return profile.state_at(order_ocel(spark, d), "1996-06-01")


@query(f"WITH {FLAT_SQL}, k AS (SELECT activity, object_type, event_id, count(DISTINCT object_id) AS k FROM r GROUP BY 1, 2, 3), t AS (SELECT event_id FROM r GROUP BY 1 HAVING count(DISTINCT object_type) > 1) SELECT (SELECT count(*) FROM t) AS multi_type_events, (SELECT count(*) FROM (SELECT activity, object_type FROM k GROUP BY 1, 2 HAVING min(k) <> max(k))) AS variable_pairs, (SELECT count(*) FROM (SELECT activity, object_type FROM (SELECT activity, object_type, object_id, count(DISTINCT event_id) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(n) > 1)) AS repeating_pairs")
def f29_variability(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    many = olap.shapes(log).agg(F.coalesce(F.sum(F.when(F.size(F.filter("shape", lambda x: x["object_type"].isNotNull())) > 1, F.col("n"))), F.lit(0)).alias("multi_type_events"))
    var = profile.multiplicity(log).agg(F.count_if(F.col("least") != F.col("most")).alias("variable_pairs"))
    rep = profile.repetition(log, by="event_id").groupBy("object_type", "activity").agg(F.max("times").alias("m")).agg(F.count_if(F.col("m") > 1).alias("repeating_pairs"))
    return many.crossJoin(var).crossJoin(rep)  # one row each


@query(f"WITH {OCEL_SQL} SELECT DISTINCT object_type, name FROM oa JOIN ob USING (object_id)")
def f30_attribute_names(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return log.object_attr.join(log.objects, "object_id").select("object_type", "name").distinct()


PHASE = "q AS (SELECT DISTINCT event_id, object_id, object_type, epoch_us(ts) AS t FROM r WHERE object_type IN ('Order','Supplier')), li AS (SELECT object_id, min(t) AS a, max(t) AS z FROM q GROUP BY 1), ph AS (SELECT event_id, object_id, object_type, CASE WHEN z > a THEN (t - a) / (z - a) ELSE 0.5 END AS phase FROM q JOIN li USING (object_id))"


@query(f"""WITH {FLAT_SQL}, {PHASE}, p AS (SELECT x.event_id, CAST(least(floor(x.phase * 24), 23) AS INTEGER) AS bin_x, CAST(least(floor(y.phase * 24), 23) AS INTEGER) AS bin_y FROM ph x JOIN ph y ON x.event_id = y.event_id AND x.object_type = 'Order' AND y.object_type = 'Supplier'), n AS (SELECT event_id, count(*) AS n FROM p GROUP BY 1)
SELECT bin_x, bin_y, count(*) AS raw, round(sum(1.0 / n), 9) AS mass FROM p JOIN n USING (event_id) GROUP BY 1, 2""")
def f31_interaction_field(spark, d) -> DataFrame:
    return profile.interaction_field(order_ocel(spark, d), "Order", "Supplier")


@query(f"WITH {FLAT_SQL}, k AS (SELECT event_id, object_type, count(DISTINCT object_id) AS k FROM r GROUP BY 1, 2) SELECT a.object_type AS type_a, b.object_type AS type_b, count(*) AS events, count(*) FILTER (WHERE a.k = 1 AND b.k = 1) AS one_one, count(*) FILTER (WHERE a.k = 1 AND b.k > 1) AS one_many, count(*) FILTER (WHERE a.k > 1 AND b.k = 1) AS many_one, count(*) FILTER (WHERE a.k > 1 AND b.k > 1) AS many_many FROM k a JOIN k b ON a.event_id = b.event_id AND a.object_type < b.object_type GROUP BY 1, 2")
def f32_pair_totals(spark, d) -> DataFrame:
    return profile.pair_totals(order_ocel(spark, d))


@query(f"""WITH {FLAT_SQL}, k AS (SELECT DISTINCT event_id, object_id, object_type FROM r), n AS (SELECT event_id, object_type AS target, count(*) AS n FROM k GROUP BY 1, 2), t AS (SELECT object_type AS source, count(*) AS total FROM k GROUP BY 1)
SELECT source, target, count(*) AS n, CAST(greatest(1, round(quantile_cont(n.n, 0.25))) AS BIGINT) AS p25, CAST(greatest(1, round(quantile_cont(n.n, 0.5))) AS BIGINT) AS mid, CAST(greatest(1, round(quantile_cont(n.n, 0.75))) AS BIGINT) AS p75, round(100 * count(*) / max(total), 6) AS support
FROM (SELECT event_id, object_type AS source FROM k) s JOIN n USING (event_id) JOIN t USING (source) WHERE source <> target GROUP BY 1, 2""")
def f34_cardinality_evidence(spark, d) -> DataFrame:
    return profile.cardinality_evidence(order_ocel(spark, d))


@query(f"""WITH {FLAT_SQL}, l AS (SELECT object_type, object_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS h, count(*) > count(DISTINCT activity) AS rw FROM (SELECT DISTINCT object_type, object_id, event_id, activity, ts FROM r) GROUP BY 1, 2)
SELECT object_type, count(*) AS objects, median(h) AS median_lead_hours, avg(CASE WHEN rw THEN 1.0 ELSE 0.0 END) AS rework_rate FROM l GROUP BY 1""")
def f35_lifecycle_profile(spark, d) -> DataFrame:
    r = olap.relations(order_ocel(spark, d)).select("object_type", "object_id", "event_id", "activity", "ts").distinct()
    h = F.expr("(unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) / 3600000000")
    o = r.groupBy("object_type", "object_id").agg(h.alias("h"), (F.count("*") > F.countDistinct("activity")).alias("rw"))
    return o.groupBy("object_type").agg(F.count("*").alias("objects"), F.median("h").alias("median_lead_hours"), F.avg(F.when(F.col("rw"), 1.0).otherwise(0.0)).alias("rework_rate"))


OCE = "x AS (SELECT object_type, object_id, activity, epoch_us(ts) AS t, lead(activity) OVER w AS target, epoch_us(lead(ts) OVER w) AS t2, lag(activity) OVER w AS before FROM (SELECT DISTINCT object_type, object_id, event_id, activity, ts FROM r) WINDOW w AS (PARTITION BY object_type, object_id ORDER BY ts, event_id))"


@query(f"WITH {FLAT_SQL}, {OCE} SELECT object_type, activity AS source, target, count(*) AS n, avg(t2 - t) AS mean_us FROM x WHERE target IS NOT NULL GROUP BY 1, 2, 3")
def f38_ocdfg_edges(spark, d) -> DataFrame:
    return profile.ocdfg(order_ocel(spark, d))[1]


@query(f"WITH {FLAT_SQL}, {OCE} SELECT object_type, activity, count(DISTINCT object_id) AS objects, count(*) FILTER (WHERE before IS NULL) AS starts, count(*) FILTER (WHERE target IS NULL) AS ends FROM x GROUP BY 1, 2")
def f38_ocdfg_nodes(spark, d) -> DataFrame:
    return profile.ocdfg(order_ocel(spark, d))[0]


@query(f"""WITH {FLAT_SQL}, k AS (SELECT DISTINCT event_id, activity, object_id, object_type FROM r), pe AS (SELECT activity, event_id, object_type, count(*) AS n FROM k GROUP BY 1, 2, 3), c AS (SELECT activity, object_type, bool_or(n > 1) AS convergent, count(*) AS w FROM pe GROUP BY 1, 2),
st AS (SELECT event_id, string_agg(DISTINCT object_id, ',' ORDER BY object_id) AS os FROM k GROUP BY 1), dv AS (SELECT activity, object_type, bool_or(v > 1) AS divergent FROM (SELECT activity, object_type, object_id, count(DISTINCT os) AS v FROM k JOIN st USING (event_id) GROUP BY 1, 2, 3) GROUP BY 1, 2), t AS (SELECT activity, count(*) AS total FROM ev GROUP BY 1)
SELECT activity, object_type, true AS related, divergent, convergent, w < total AS deficient FROM c JOIN dv USING (activity, object_type) JOIN t USING (activity)""")
def f39_interaction_patterns(spark, d) -> DataFrame:
    return profile.interaction_patterns(order_ocel(spark, d))


@query(f"WITH {FLAT_SQL}, k AS (SELECT activity, object_type, event_id, count(DISTINCT object_id) AS k FROM r GROUP BY 1, 2, 3) SELECT activity, object_type, avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) AS multiple, max(k) > 1 AS \"any\", avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) >= 0.95 AS variable FROM k GROUP BY 1, 2")
def f40_variable_arcs(spark, d) -> DataFrame:
    return profile.variable_arcs(order_ocel(spark, d))


@query("WITH s AS (SELECT min(o_totalprice) AS low, quantile_disc(o_totalprice, 0.5) AS mid, max(o_totalprice) AS high, avg(o_totalprice) AS mean, count(DISTINCT o_totalprice) AS \"distinct\" FROM orders) SELECT CAST(least(floor((o_totalprice - low) / ((high - low) / 20)), 19) AS INTEGER) AS bin, low, mid, high, mean, \"distinct\", count(*) AS n FROM orders, s GROUP BY ALL")
def v12_numeric_summary(spark, d) -> DataFrame:
    return profile.numeric_summary(table(spark, d, "orders"), "o_totalprice")
