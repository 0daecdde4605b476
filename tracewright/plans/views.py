"""Queries of the views' filters, of object-centric nets and of model exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, miners, object_nets, profile, relations, views
from ..sources import bpmn
from ..sources.tables import DAY_SQL, FLAT_SQL, LINE_SQL, OCEL_SQL, USER_SQL, day_log, line_log, order_ocel, table, user_log
from .discovery import DEP, DF, HAND, ITEMS, items
from .profiles import PATHS
from .registry import query


@query(f"WITH {LINE_SQL}, {DF}, x AS (SELECT substr(source, 1, 1) AS source, substr(target, 1, 1) AS target, n FROM df) SELECT source, target, max(n) AS n FROM x WHERE source <> target GROUP BY 1, 2")
def v4_lift_edges(spark, d) -> DataFrame:
    e = relations.directly_follows(line_log(spark, d))
    names = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return views.lift_edges(e, names.select("node", F.substring("node", 1, 1).alias("cluster")))


@query(f"WITH {LINE_SQL}, {DF}, c AS (SELECT source, target, n FROM (SELECT *, sum(n) OVER (ORDER BY n DESC, source, target ROWS UNBOUNDED PRECEDING) - n AS b, sum(n) OVER () AS t FROM df) WHERE b < 0.5 * t), k AS (SELECT source, target, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS a, row_number() OVER (PARTITION BY target ORDER BY n DESC, source) AS b FROM df) WHERE a = 1 OR b = 1) SELECT * FROM c UNION SELECT * FROM k")
def v8_station_edges(spark, d) -> DataFrame:
    return views.station_edges(relations.directly_follows(line_log(spark, d)), 0.5)


VE = f"{PATHS}, vr AS (SELECT path, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, path) AS rk FROM pt WHERE object_type = 'Order' GROUP BY 1), ve AS (SELECT rk, n, unnest(l[:len(l)-1]) AS source, unnest(l[2:]) AS target FROM (SELECT rk, n, string_split(path, '>') AS l FROM vr) WHERE len(l) > 1), eg AS (SELECT source, target, min(rk) AS min_variant, CAST(sum(n) AS BIGINT) AS n FROM ve GROUP BY 1, 2)"


@query(f"WITH {FLAT_SQL}, {VE} SELECT source, target, min_variant, n FROM eg")
def g33_variant_edges(spark, d) -> DataFrame:
    return views.variant_edges(order_ocel(spark, d), "Order")


@query(f"WITH {FLAT_SQL}, {VE} SELECT source, target, min_variant, n FROM eg WHERE min_variant <= 3")
def v9_variant_prefix(spark, d) -> DataFrame:
    return views.variant_edges(order_ocel(spark, d), "Order").where("min_variant <= 3")


@query(f"""WITH {FLAT_SQL}, {VE}, na AS (SELECT rk, count(*) AS a FROM (SELECT name, min(rk) AS rk FROM (SELECT rk, unnest(string_split(path, '>')) AS name FROM vr) GROUP BY 1) GROUP BY 1), ne AS (SELECT min_variant AS rk, count(*) AS e FROM eg GROUP BY 1),
al AS (SELECT rk, n, coalesce(a, 0) AS a, coalesce(e, 0) AS e FROM vr LEFT JOIN na USING (rk) LEFT JOIN ne USING (rk))
SELECT rk AS rank, n, sum(n) OVER w / sum(n) OVER () AS cumulative, a AS new_activities, CAST(sum(a) OVER w AS BIGINT) AS activities, e AS new_edges, CAST(sum(e) OVER w AS BIGINT) AS edges FROM al WINDOW w AS (ORDER BY rk ROWS UNBOUNDED PRECEDING)""")
def v9_variant_prefixes(spark, d) -> DataFrame:
    return views.variant_prefixes(order_ocel(spark, d), "Order")


@query(f"WITH {DAY_SQL}, sq AS (SELECT list(activity ORDER BY ts, event_id) AS seq FROM log GROUP BY case_id), v AS (SELECT seq, count(*) AS n FROM sq GROUP BY 1), w AS (SELECT seq, n, row_number() OVER (ORDER BY n DESC, seq) AS rank, sum(n) OVER (ORDER BY n DESC, seq ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS t FROM v) SELECT rank, array_to_string(seq, '>') AS seq, n, run / t AS cumulative FROM w WHERE run - n < 0.8 * t")
def v10_variant_list(spark, d) -> DataFrame:
    return views.variant_list(day_log(spark, d)).withColumn("seq", F.array_join("seq", ">"))


@query(f"""WITH {FLAT_SQL}, q AS (SELECT DISTINCT event_id, object_id, object_type, epoch_us(ts) AS t FROM r WHERE object_type IN ('Order','Supplier')), li AS (SELECT object_id, min(t) AS a, max(t) AS z FROM q GROUP BY 1), ph AS (SELECT event_id, object_id, object_type, CASE WHEN z > a THEN (t - a) / (z - a) ELSE 0.5 END AS phase FROM q JOIN li USING (object_id)),
p AS (SELECT x.event_id, CAST(least(floor(x.phase * 24), 23) AS INTEGER) AS bin_x, CAST(least(floor(y.phase * 24), 23) AS INTEGER) AS bin_y FROM ph x JOIN ph y ON x.event_id = y.event_id AND x.object_type = 'Order' AND y.object_type = 'Supplier'), n AS (SELECT event_id, count(*) AS n FROM p GROUP BY 1),
f1 AS (SELECT bin_x, bin_y, round(sum(1.0::DOUBLE / n), 9) AS mass FROM p JOIN n USING (event_id) GROUP BY 1, 2)
SELECT a.bin_x, a.bin_y, a.mass AS mass_one, coalesce(b.mass, 0.0) AS mass_two, round(coalesce(b.mass, 0.0) - a.mass, 9) AS delta FROM f1 a LEFT JOIN f1 b ON b.bin_x = a.bin_x AND b.bin_y = a.bin_y AND b.bin_x < 12""")
def v13_compare_fields(spark, d) -> DataFrame:
    f = graph.settled(profile.interaction_field(order_ocel(spark, d), "Order", "Supplier"))  # a row a bin, read twice
    return views.compare_fields(f, f.where("bin_x < 12"))


@query(f"WITH {USER_SQL}, a AS (SELECT activity, count(*) AS n FROM log GROUP BY 1) SELECT activity, n, round(power(n / (SELECT max(n) FROM a), 0.65), 9) AS elevation FROM a")
def v16_elevation(spark, d) -> DataFrame:
    return views.elevation(user_log(spark, d).events.groupBy("activity").agg(F.count("*").alias("n")), "n")


@query(f"WITH {LINE_SQL}, {HAND}, g AS (SELECT source, target, round(CAST(sum(w) AS DOUBLE), 9) AS weight FROM hv GROUP BY 1, 2), b AS (SELECT resource, count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT activity) AS activities FROM log GROUP BY 1) SELECT b.*, coalesce((SELECT round(sum(weight), 6) FROM g WHERE source = b.resource), 0.0) AS sent, coalesce((SELECT round(sum(weight), 6) FROM g WHERE target = b.resource), 0.0) AS received FROM b")
def g23_involvement(spark, d) -> DataFrame:
    log = line_log(spark, d)
    return views.involvement(log, relations.handover(log, most=2))


LIFE = ITEMS.replace("AS resource,", "AS resource, CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag AS activity,")


@query(f"WITH {LIFE}, s AS (SELECT case_id, activity, s AS start, row_number() OVER (PARTITION BY case_id, activity ORDER BY s) AS k FROM it), e AS (SELECT case_id, activity, e AS \"end\", row_number() OVER (PARTITION BY case_id, activity ORDER BY e) AS k FROM it) SELECT case_id, activity, k, start, \"end\" FROM s JOIN e USING (case_id, activity, k)")
def g26_work_items(spark, d) -> DataFrame:
    i = items(spark, d)
    e = i.select("case_id", "activity", F.lit("start").alias("phase"), F.col("start").alias("t"), F.col("item").alias("event_id")).unionAll(i.select("case_id", "activity", F.lit("complete"), "end", "item"))
    return views.work_items(e)


@query(f"WITH {LIFE} SELECT x.activity AS a, y.activity AS b, count(*) AS n FROM it x JOIN it y ON x.case_id = y.case_id AND x.activity < y.activity AND greatest(x.s, y.s) < least(x.e, y.e) GROUP BY 1, 2")
def g11_lifecycle_overlap(spark, d) -> DataFrame:
    return views.lifecycle_overlap(items(spark, d))


#: The work items of all of a customer's orders as one case, and their starts and ends as events.
CUSTOMER = LIFE.replace("CAST(l_orderkey AS VARCHAR) AS case_id", "CAST(o_custkey AS VARCHAR) AS case_id")
PHASES = CUSTOMER + ", pe AS (SELECT case_id, activity, 'start' AS phase, s AS t, item || ':0' AS event_id FROM it UNION ALL SELECT case_id, activity, 'complete', e, item || ':1' FROM it), rf AS (SELECT phase, activity, last_value(CASE WHEN phase = 'complete' THEN activity END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY t NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM pe), rd AS (SELECT source, activity AS target, count(*) AS n FROM rf WHERE phase = 'start' AND source <> activity GROUP BY 1, 2)"


def customer_items(spark, d) -> tuple[DataFrame, DataFrame]:
    """(items, their starts and ends) with a customer's orders as one case."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_custkey").cast("string").alias("customer"))
    i = items(spark, d).join(orders, "case_id").drop("case_id").withColumnRenamed("customer", "case_id")
    starts = i.select("case_id", "activity", F.lit("start").alias("phase"), F.col("start").alias("t"), F.concat("item", F.lit(":0")).alias("event_id"))
    return i, starts.unionAll(i.select("case_id", "activity", F.lit("complete"), "end", F.concat("item", F.lit(":1"))))


@query(f"WITH {PHASES} SELECT * FROM rd")
def g11_refined_follows(spark, d) -> DataFrame:
    return views.refined_follows(customer_items(spark, d)[1])


@query(f"""WITH {PHASES}, ov AS (SELECT x.activity AS a, y.activity AS b, count(*) AS n FROM it x JOIN it y ON x.case_id = y.case_id AND x.activity < y.activity AND greatest(x.s, y.s) < least(x.e, y.e) GROUP BY 1, 2),
pr AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(CASE WHEN source < target THEN n ELSE 0 END)::BIGINT AS ab, sum(CASE WHEN source > target THEN n ELSE 0 END)::BIGINT AS ba FROM rd GROUP BY 1, 2)
SELECT a, b, coalesce(ab, 0) AS ab, coalesce(ba, 0) AS ba, coalesce(n, 0) AS overlap, coalesce(n, 0) > 0 OR (coalesce(ab, 0) > 0 AND coalesce(ba, 0) > 0 AND abs(ab - ba) < 0.1 * (ab + ba)) AS concurrent FROM pr FULL JOIN ov USING (a, b)""")
def g11_concurrent_pairs(spark, d) -> DataFrame:
    i, events = customer_items(spark, d)
    return views.concurrent_pairs(events, i)


@query(f"WITH {USER_SQL} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS pos, activity, epoch_us(ts) AS t FROM log WHERE case_id IN (SELECT DISTINCT case_id FROM log ORDER BY case_id LIMIT 10)")
def g34_replay_sample(spark, d) -> DataFrame:
    return views.replay_sample(user_log(spark, d), 10)


@query(f"WITH {OCEL_SQL} SELECT object_id AS value, row_number() OVER (ORDER BY object_id) - 1 AS id FROM ob")
def h13_dense_ids(spark, d) -> DataFrame:
    return views.dense_ids(order_ocel(spark, d).objects, "object_id")


@query(f"WITH {LINE_SQL}, {DF}, {DEP}, d2 AS (SELECT source, target FROM (SELECT *, max(dependency) FILTER (WHERE source <> target) OVER (PARTITION BY source) AS bo, max(dependency) FILTER (WHERE source <> target) OVER (PARTITION BY target) AS bi FROM dp) WHERE (source <> target AND (dependency = bo OR dependency = bi)) OR (dependency >= 0.9 AND (source = target OR bo - dependency <= 0.05 OR bi - dependency <= 0.05))) SELECT (SELECT count(*) FROM df) AS one, (SELECT count(*) FROM d2) AS two, (SELECT count(*) FROM df JOIN d2 USING (source, target)) AS \"both\", (SELECT count(*) FROM df JOIN d2 USING (source, target)) / (SELECT count(*) FROM (SELECT source, target FROM df UNION SELECT source, target FROM d2)) AS jaccard")
def h9_footprint_similarity(spark, d) -> DataFrame:
    """What was observed against what the dependency net keeps of it, both of the whole log."""
    log = line_log(spark, d)
    return views.footprint_similarity(relations.directly_follows(log), relations.kept_dependencies(log))


@query(f"WITH {FLAT_SQL} SELECT activity AS other, count(DISTINCT event_id) AS n FROM r WHERE object_type = 'Order' AND activity <> 'place order' AND object_id IN (SELECT object_id FROM r WHERE activity = 'place order') GROUP BY 1 ORDER BY n DESC, other LIMIT 6")
def f33_context(spark, d) -> DataFrame:
    return views.context(order_ocel(spark, d), "Order", "place order")


@query(f"WITH {FLAT_SQL}, l AS (SELECT object_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS h FROM r GROUP BY object_type, object_id) SELECT object_type, CAST(floor(log2(h + 1)) AS INTEGER) AS bin, count(*) AS n FROM l GROUP BY 1, 2")
def f33_lifetimes(spark, d) -> DataFrame:
    return views.lifetimes(order_ocel(spark, d))


@query(f"WITH {FLAT_SQL} SELECT object_id, epoch_us(max(ts)) AS ready_us FROM r WHERE object_type = 'Order' GROUP BY 1")
def f42_readiness(spark, d) -> DataFrame:
    return views.readiness(order_ocel(spark, d), "Order")


@query(f"WITH {DAY_SQL}, p AS (SELECT activity || '>' || lead(activity, 1) OVER w || '>' || lead(activity, 2) OVER w AS route FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)) SELECT route, count(*) AS n FROM p WHERE route IS NOT NULL GROUP BY 1")
def g12_routes(spark, d) -> DataFrame:
    return views.route_counts(day_log(spark, d), 3)


@query()
def g15_object_nets(spark, d) -> DataFrame:
    return object_nets.discover(order_ocel(spark, d))


@query()
def h6_object_replay(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    variants = graph.settled(object_nets.type_variants(log))  # mined and replayed
    return object_nets.replay(log, object_nets.nets_of(object_nets.discover(log, variants=variants)), variants)


@query()
def h17_tree_to_bpmn(spark, d) -> DataFrame:
    model = bpmn.from_tree(miners.mine_table(relations.variants(day_log(spark, d)), 0.2))
    return bpmn.table(spark, bpmn.from_xml(bpmn.to_xml(model)))
