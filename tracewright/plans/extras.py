"""Executions, cardinalities, timings, resources and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cardinality, conform, executions, olap, profile, relations, views
from ..sources import catalog
from ..sources.tables import DAY_SQL, FLAT_SQL, LINE_SQL, OCEL_SQL, USER_SQL, day_log, line_log, order_ocel, table, user_log
from .conformance import RECON
from .discovery import DEP, DF, HAND, ITEMS, items
from .profiles import AB, PATHS, STREAM
from .registry import query


@query("SELECT c_nationkey, any_value(n_name) AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def d6_any_value(spark, d) -> DataFrame:
    """The nation depends on the key, so any of its values is the value."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("c_nationkey").agg(F.any_value("n_name").alias("nation"), F.count("*").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def d21_rollup(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def d21_grouping_sets(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def d21_ranks_and_frames(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    near = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 1)
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(near).alias("near"))


@query(f"WITH {OCEL_SQL} SELECT name, object_type, count(*) AS n, count(value) AS filled FROM oa LEFT JOIN ob USING (object_id) GROUP BY 1, 2 UNION ALL SELECT 'related', object_type, count(*), count(qualifier) FROM e2o JOIN ob USING (object_id) GROUP BY 2")
def c14_merges(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    left = log.object_attr.join(log.objects, "object_id", "left").groupBy("name", "object_type").agg(F.count("*").alias("n"), F.count("value").alias("filled"))
    inner = log.e2o.join(log.objects, "object_id").groupBy("object_type").agg(F.count("*").alias("n"), F.count("qualifier").alias("filled"))
    return left.unionByName(inner.withColumn("name", F.lit("related")))


@query(f"WITH {USER_SQL}, {STREAM} SELECT event_id, wait_ms FROM s WHERE activity = 'view' AND wait_ms IS NOT NULL ORDER BY md5(CAST(event_id AS VARCHAR) || '|11'), event_id LIMIT 400")
def f11_wait_sample(spark, d) -> DataFrame:
    s = profile.entity_stream(user_log(spark, d)).where("activity = 'view' and wait_ms is not null")
    return catalog.sample_rows(s, "event_id", 400, seed=11).select("event_id", "wait_ms")


@query(f"WITH {FLAT_SQL}, {AB}, qa AS (SELECT object_id, event_id, us FROM q WHERE activity = 'place order'), qb AS (SELECT object_id, event_id, us FROM q WHERE activity = 'ship'), j AS (SELECT qa.object_id, qa.event_id AS a_event, qb.event_id AS b_event, qb.us - qa.us AS delta_us FROM qa JOIN qb USING (object_id) WHERE qb.us > qa.us) SELECT * FROM j UNION ALL SELECT object_id, event_id, NULL, NULL FROM qa ANTI JOIN (SELECT object_id, a_event AS event_id FROM j) USING (object_id, event_id)")
def f25_all_pairs(spark, d) -> DataFrame:
    return cardinality.all_pairs(order_ocel(spark, d), "Order", "place order", "ship")


@query(f"WITH {FLAT_SQL}, {AB}, p AS (SELECT b.us - a.us AS d FROM q a LEFT JOIN q b ON b.object_id = a.object_id AND b.activity = 'ship' AND b.us > a.us WHERE a.activity = 'place order') SELECT count(d) AS pairs, count(*) FILTER (WHERE d IS NULL) AS unmatched, avg(d) AS mean, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.9) AS p90 FROM p")
def f25_summary(spark, d) -> DataFrame:
    return cardinality.timing_summary(cardinality.all_pairs(order_ocel(spark, d), "Order", "place order", "ship"))


@query(f"""WITH {OCEL_SQL}, b(title, words) AS (VALUES ('Picker','picker|worker|resource'),('Warehouse','warehouse|site|location'),('Customer segment','segment|customer|client')),
f AS (SELECT title, name AS attribute, value, count(*) AS n FROM oa JOIN ob USING (object_id), b WHERE regexp_matches(lower(name), words) GROUP BY 1, 2, 3), t AS (SELECT title, attribute, row_number() OVER (PARTITION BY title ORDER BY sum(n) DESC, attribute) AS k FROM f GROUP BY 1, 2),
g AS (SELECT f.*, row_number() OVER (PARTITION BY title ORDER BY n DESC, value) AS rank FROM f JOIN t USING (title, attribute) WHERE k = 1) SELECT * FROM g WHERE rank <= 8""")
def f36_breakdowns(spark, d) -> DataFrame:
    return cardinality.breakdowns(order_ocel(spark, d)).withColumn("rank", F.col("rank").cast("long"))


_LABEL = "CASE WHEN ({t} - {o} - {m})::DOUBLE / {t} >= 0.9 THEN '0' WHEN {o}::DOUBLE / {t} >= 0.9 THEN '1' WHEN ({t} - {m})::DOUBLE / {t} >= 0.9 THEN '0...1' WHEN ({o} + {m})::DOUBLE / {t} >= 0.9 THEN '1..*' ELSE '0...*' END"


@query(f"""WITH {FLAT_SQL}, q AS (SELECT DISTINCT event_id, object_id, object_type, ts FROM r), k AS (SELECT event_id, object_type AS t, count(*) AS n FROM q GROUP BY 1, 2), kt AS (SELECT t, count(*) AS total FROM k GROUP BY 1),
e1 AS (SELECT x.t AS source, y.t AS target, count(*) FILTER (WHERE y.n = 1) AS o, count(*) FILTER (WHERE y.n > 1) AS m FROM k x JOIN k y ON x.event_id = y.event_id AND x.t <> y.t GROUP BY 1, 2), ec AS (SELECT source, target, {_LABEL.format(t="total", o="o", m="m")} AS ec FROM e1 JOIN kt ON kt.t = source),
li AS (SELECT object_id, object_type, min(ts) AS a, max(ts) AS z FROM q GROUP BY 1, 2), lt AS (SELECT object_type AS t, count(*) AS total FROM li GROUP BY 1),
pr AS (SELECT x.object_id AS x, y.object_id AS y FROM q x JOIN q y ON x.event_id = y.event_id AND x.object_type <> y.object_type UNION SELECT source_id, target_id FROM o2o),
pt AS (SELECT lx.object_type AS source, ly.object_type AS target, x, y, lx.a AS ax, lx.z AS zx, ly.a AS ay, ly.z AS zy FROM pr JOIN li lx ON lx.object_id = x JOIN li ly ON ly.object_id = y WHERE lx.object_type <> ly.object_type),
l1 AS (SELECT source, target, count(*) FILTER (WHERE n = 1) AS o, count(*) FILTER (WHERE n > 1) AS m FROM (SELECT source, target, x, count(*) AS n FROM pt GROUP BY 1, 2, 3) GROUP BY 1, 2), lc AS (SELECT source, target, {_LABEL.format(t="total", o="o", m="m")} AS lc FROM l1 JOIN lt ON lt.t = source),
tr AS (SELECT source, target, CASE WHEN avg((ay <= ax AND zx <= zy)::INT) >= 0.9 THEN 'D' WHEN avg((ax <= ay AND zy <= zx)::INT) >= 0.9 THEN 'Di' WHEN avg((zx <= ay OR (ax < ay AND ay <= zx AND zx < zy))::INT) >= 0.9 THEN 'I' WHEN avg((zy <= ax OR (ay < ax AND ax <= zy AND zy < zx))::INT) >= 0.9 THEN 'Ii' ELSE 'P' END AS tr FROM pt GROUP BY 1, 2)
SELECT * FROM ec JOIN lc USING (source, target) JOIN tr USING (source, target)""")
def f37_totem_cardinalities(spark, d) -> DataFrame:
    return cardinality.totem_full(order_ocel(spark, d))


@query(f"WITH {LINE_SQL}, e AS (SELECT case_id, activity, resource, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS pos FROM log) SELECT source, target, count(*) AS n FROM (SELECT DISTINCT x.case_id, x.resource AS source, y.resource AS target FROM e x JOIN e y ON x.case_id = y.case_id AND x.activity = y.activity AND x.pos < y.pos AND x.resource <> y.resource) GROUP BY 1, 2")
def g21_reassignment(spark, d) -> DataFrame:
    return relations.reassignment(line_log(spark, d))


@query(f"WITH {LINE_SQL}, e AS (SELECT case_id, activity, resource, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS pos FROM log) SELECT x.resource AS source, y.resource AS target, count(*) AS n FROM e x JOIN e y ON x.case_id = y.case_id AND x.activity = y.activity AND x.pos < y.pos AND x.resource <> y.resource GROUP BY 1, 2")
def g21_reassignment_each(spark, d) -> DataFrame:
    return relations.reassignment(line_log(spark, d), once=False)


@query(f"WITH {LINE_SQL}, {HAND}, g AS (SELECT source, target, round(CAST(sum(w) AS DOUBLE), 9) AS weight FROM hv GROUP BY 1, 2) SELECT source, target, weight, round(weight / (SELECT sum(weight) FROM g), 9) AS share FROM g")
def g21_shares(spark, d) -> DataFrame:
    return relations.shares(relations.handover(line_log(spark, d), most=2), "weight")


@query(f"WITH {LINE_SQL}, k AS (SELECT resource, activity, count(*) AS n FROM log GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY n DESC, activity) AS rank FROM k) SELECT * FROM x WHERE rank <= 64")
def g23_top_activities(spark, d) -> DataFrame:
    return relations.top_activities_of(line_log(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {LINE_SQL} SELECT a.resource, count(DISTINCT b.resource) AS collaborators FROM log a LEFT JOIN log b ON a.case_id = b.case_id AND a.resource <> b.resource GROUP BY 1")
def g25_collaborators(spark, d) -> DataFrame:
    return relations.collaborators(line_log(spark, d))


@query(f"WITH {ITEMS}, c AS (SELECT a.resource, a.item, (a.e - a.s) / 1e6 AS secs, (SELECT count(*) FROM it b WHERE a.resource = b.resource AND b.s <= a.s AND b.e > a.s) AS n FROM it a) SELECT resource, count(*) AS items, CASE WHEN count(*) >= 3 AND min(n) < max(n) AND min(secs) < max(secs) THEN round(corr(CAST(n AS DOUBLE), secs), 9) END AS correlation FROM c GROUP BY 1")
def g28_load_correlation(spark, d) -> DataFrame:
    return relations.load_correlation(items(spark, d))


@query(f"""WITH {LINE_SQL}, x AS (SELECT resource, epoch_us(ts) AS us FROM log), s AS (SELECT max(us) - min(us) AS span FROM x), w AS (SELECT CASE WHEN ceil(span / 3600000000) <= 400 THEN 3600000000 WHEN ceil(span / 86400000000) <= 400 THEN 86400000000 WHEN ceil(span / 604800000000) <= 400 THEN 604800000000 ELSE 2592000000000 END AS w FROM s)
SELECT CASE w WHEN 3600000000 THEN 'hour' WHEN 86400000000 THEN 'day' WHEN 604800000000 THEN 'week' ELSE 'month' END AS width, CAST(floor(us / w) AS BIGINT) AS bucket, resource, count(*) AS n FROM x, w GROUP BY 1, 2, 3""")
def g30_timeline(spark, d) -> DataFrame:
    return relations.timeline(line_log(spark, d), "hour")


@query(f"WITH {LINE_SQL}, k AS (SELECT case_id, activity, count(*) AS k FROM log GROUP BY 1, 2), n AS (SELECT activity, k, count(*) AS cases FROM k GROUP BY 1, 2) SELECT * FROM n UNION ALL SELECT activity, 0, (SELECT count(*) FROM cases) - sum(cases) FROM n GROUP BY 1 HAVING (SELECT count(*) FROM cases) > sum(cases)")
def g20_allowed_counts(spark, d) -> DataFrame:
    return relations.allowed_counts(line_log(spark, d))


_DEPS = f"{DF}, {DEP}"


@query(f"WITH {LINE_SQL}, {_DEPS}, x AS (SELECT *, row_number() OVER (ORDER BY dependency DESC, source, target) AS k, count(*) OVER () AS m FROM dp) SELECT source, target, n, back, dependency FROM x WHERE k <= round(0.4 * m)")
def v6_prune_negative(spark, d) -> DataFrame:
    return relations.share_prune(relations.dependencies(line_log(spark, d)), "dependency", 0.4, "source", "target")


@query(f"WITH {LINE_SQL}, {_DEPS}, t AS (SELECT max(n) AS top FROM dp) SELECT row_number() OVER (ORDER BY n DESC, source, target) AS rank, source, target, n, round(n / top, 9) AS scaled FROM dp, t")
def v5_matrix_series(spark, d) -> DataFrame:
    return views.series(relations.dependencies(line_log(spark, d)), "n", "source", "target")


@query(f"WITH {LINE_SQL}, {HAND}, g AS (SELECT target AS resource, round(CAST(sum(w) AS DOUBLE), 6) AS received FROM hv GROUP BY 1), b AS (SELECT DISTINCT resource FROM log) SELECT b.resource, received, row_number() OVER (ORDER BY received DESC NULLS LAST, b.resource) AS rank FROM b LEFT JOIN g USING (resource)")
def v15_profile_sort(spark, d) -> DataFrame:
    log = line_log(spark, d)
    got = relations.handover(log, most=2).groupBy(F.col("target").alias("resource")).agg(F.round(F.sum("weight"), 6).alias("received"))
    return views.sorted_profiles(log.events.select("resource").distinct().join(got, "resource", "left"), "received", "resource")


_FIELD = """{k}p AS (SELECT x.event_id, CAST(least(floor(x.phase * 24), 23) AS INTEGER) AS bin_x, CAST(least(floor(y.phase * 24), 23) AS INTEGER) AS bin_y FROM {k}ph x JOIN {k}ph y ON x.event_id = y.event_id AND x.object_type = 'Order' AND y.object_type = 'Supplier'), {k}n AS (SELECT event_id, count(*) AS n FROM {k}p GROUP BY 1),
{k}f AS (SELECT bin_x, bin_y, round(sum(1.0 / n), 9) AS mass FROM {k}p JOIN {k}n USING (event_id) GROUP BY 1, 2)"""
_SPAN = "{k}q AS (SELECT DISTINCT event_id, object_id, object_type, epoch_us(ts) AS t FROM r WHERE object_type IN ('Order','Supplier') AND ts {c} TIMESTAMP '1997-01-01'), {k}li AS (SELECT object_id, min(t) AS a, max(t) AS z FROM {k}q GROUP BY 1), {k}ph AS (SELECT event_id, object_id, object_type, CASE WHEN z > a THEN (t - a) / (z - a) ELSE 0.5 END AS phase FROM {k}q JOIN {k}li USING (object_id)), "


@query(f"WITH {FLAT_SQL}, {_SPAN.format(k='u', c='<')}{_FIELD.format(k='u')}, {_SPAN.format(k='v', c='>=')}{_FIELD.format(k='v')} SELECT bin_x, bin_y, coalesce(uf.mass, 0.0) AS mass_one, coalesce(vf.mass, 0.0) AS mass_two, round(coalesce(vf.mass, 0.0) - coalesce(uf.mass, 0.0), 9) AS delta FROM uf FULL JOIN vf USING (bin_x, bin_y)")
def v13_compare_periods(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    when = F.col("ts") < F.lit("1997-01-01").cast("timestamp_ntz")
    one, two = (profile.interaction_field(log.with_(events=log.events.where(c)), "Order", "Supplier") for c in (when, ~when))
    return views.compare_fields(one, two)


EXECUTIONS = """lv AS (SELECT DISTINCT event_id, object_id, object_type FROM r), l1 AS (SELECT DISTINCT a.object_id AS execution, b.object_id, b.object_type FROM lv a JOIN lv b ON a.event_id = b.event_id AND a.object_type = 'Order' AND b.object_type <> 'Order'),
lk AS (SELECT object_id AS execution FROM ob WHERE object_type = 'Order' AND object_id NOT IN (SELECT execution FROM l1 WHERE object_type = 'Part')),
l2 AS (SELECT DISTINCT execution, b.object_id FROM lk JOIN l1 USING (execution) JOIN lv a ON a.object_id = l1.object_id AND l1.object_type = 'Customer' JOIN lv b ON b.event_id = a.event_id AND b.object_type = 'Order' AND b.object_id <> execution),
l3 AS (SELECT DISTINCT execution, b.object_id FROM l2 JOIN lv a ON a.object_id = l2.object_id JOIN lv b ON b.event_id = a.event_id AND b.object_type IN ('Part','Supplier')),
me AS (SELECT object_id AS execution, object_id FROM ob WHERE object_type = 'Order' UNION SELECT execution, object_id FROM l1 UNION SELECT execution, object_id FROM l3),
sh AS (SELECT object_id, count(*) AS share FROM me GROUP BY 1), tc AS (SELECT event_id, object_id, share, min(share) OVER (PARTITION BY event_id) AS least FROM lv JOIN sh USING (object_id)), xe AS (SELECT DISTINCT execution, event_id FROM tc JOIN me USING (object_id) WHERE share = least)"""


@query(f"WITH {FLAT_SQL}, {EXECUTIONS} SELECT * FROM me")
def g31_executions(spark, d) -> DataFrame:
    return executions.by_leading_type(order_ocel(spark, d), "Order", ordered=False)


@query(f"WITH {FLAT_SQL}, {EXECUTIONS} SELECT * FROM xe")
def g31_execution_events(spark, d) -> DataFrame:
    return executions.events_of(order_ocel(spark, d), leading="Order", ordered=False)


@query(f"""WITH {FLAT_SQL}, {EXECUTIONS}, th AS (SELECT xe.execution, lv.event_id, lv.object_id, lv.object_type, ev.activity, ev.ts FROM xe JOIN lv USING (event_id) JOIN me ON me.execution = xe.execution AND me.object_id = lv.object_id JOIN ev ON ev.event_id = lv.event_id),
st AS (SELECT DISTINCT execution, a, b FROM (SELECT execution, lag(event_id) OVER (PARTITION BY execution, object_id ORDER BY ts, event_id) AS a, event_id AS b FROM th) WHERE a IS NOT NULL)
SELECT execution, a, b, string_agg(object_type || '=' || n, ',' ORDER BY object_type) AS label FROM (SELECT st.execution, st.a, st.b, y.object_type, count(*) AS n FROM st JOIN th x ON x.execution = st.execution AND x.event_id = st.a JOIN th y ON y.execution = st.execution AND y.event_id = st.b AND y.object_id = x.object_id GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def g32_execution_edges(spark, d) -> DataFrame:
    return executions.graphs(order_ocel(spark, d), leading="Order")[1]


@query()
def g32_graph_variants(spark, d) -> DataFrame:
    return executions.variants(order_ocel(spark, d), leading="Order")


@query()
def g33_attributed_edges(spark, d) -> DataFrame:
    return executions.attributed_edges(order_ocel(spark, d), leading="Order")


@query()
def v11_execution_partition(spark, d) -> DataFrame:
    return executions.partition(order_ocel(spark, d), leading="Order")


@query(f"""WITH {FLAT_SQL}, {PATHS}, a AS (SELECT object_type, activity AS name, count(*) AS n FROM (SELECT DISTINCT object_type, event_id, object_id, activity FROM r) GROUP BY 1, 2), v AS (SELECT object_type, path AS name, count(*) AS n FROM pt GROUP BY 1, 2)
SELECT object_type, 'activity' AS kind, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY n DESC, name) AS rank FROM a) WHERE rank <= 5 UNION ALL SELECT object_type, 'variant', name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY n DESC, name) AS rank FROM v) WHERE rank <= 4""")
def f35_lifecycle_tops(spark, d) -> DataFrame:
    return profile.lifecycle_tops(order_ocel(spark, d))


def _ranks(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return conform.reconstruct(log, olap.ablate(log))


@query(f"WITH {OCEL_SQL}, {RECON} SELECT object_type, count(*) AS gaps, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS hits_1, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS hits_10, avg(coalesce(1.0 / rank, 0.0)) AS mrr FROM dr LEFT JOIN rr USING (event_id, object_id) JOIN ob USING (object_id) GROUP BY 1")
def h11_by_type(spark, d) -> DataFrame:
    return conform.ranking_by_type(_ranks(spark, d), order_ocel(spark, d).objects)


@query(f"WITH {OCEL_SQL}, {RECON} SELECT CASE WHEN rank IS NULL THEN 'none' WHEN rank <= 1 THEN '1' WHEN rank <= 3 THEN '2-3' WHEN rank <= 5 THEN '4-5' WHEN rank <= 10 THEN '6-10' ELSE 'over 10' END AS bucket, count(*) AS n FROM dr LEFT JOIN rr USING (event_id, object_id) GROUP BY 1")
def h11_histogram(spark, d) -> DataFrame:
    return conform.rank_histogram(_ranks(spark, d))


@query(f"WITH {OCEL_SQL}, {RECON}, e AS (SELECT event_id, count(*) FILTER (WHERE rank <= 5) AS hits, count(*) AS lost FROM dr LEFT JOIN rr USING (event_id, object_id) GROUP BY 1), pr5 AS (SELECT sum(hits) / (count(*) * 5) AS p, sum(hits) / sum(lost) AS r FROM e) SELECT p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr5")
def h11_precision_at_5(spark, d) -> DataFrame:
    return conform.precision_at(_ranks(spark, d), 5)
