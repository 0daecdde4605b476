"""Sources, projections, filters, joins and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import micros
from ..operators import joins, olap
from ..sources import catalog
from ..sources.tables import FLAT_SQL, LINE_SQL, OCEL_SQL, USER_SQL, line_log, order_ocel, table, user_log
from .registry import query

TYPES = ["Order", "Customer"]


@query(f"WITH {OCEL_SQL} SELECT event_id, activity, ts FROM ev")
def a1_scan_relation(spark, d) -> DataFrame:
    return catalog.Catalog({"log": order_ocel(spark, d)}).scan("{log.events}")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS price FROM orders ORDER BY orders.o_orderkey LIMIT 50 OFFSET 100")
def a2_page(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumn("price", F.rint("o_totalprice").cast("long"))  # half to even, as the SQL
    return catalog.page(o, ["o_orderkey", "o_orderstatus", "price"], order=["o_orderkey"], limit=50, offset=100)


@query(f"WITH {OCEL_SQL}, n AS (SELECT count(*) AS n FROM ev) SELECT event_id, activity, ts FROM ev, n WHERE n <= 2000000000")
def a3_load_guarded(spark, d) -> DataFrame:
    return catalog.load_guarded(order_ocel(spark, d), 2_000_000_000)


@query(f"""WITH {OCEL_SQL} SELECT name, CASE WHEN bool_and(TRY_CAST(value AS BIGINT) IS NOT NULL) THEN 'integer' WHEN bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) THEN 'float'
WHEN bool_and(lower(value) IN ('true','false')) THEN 'boolean' WHEN bool_and(TRY_CAST(value AS TIMESTAMP) IS NOT NULL) THEN 'time' ELSE 'string' END AS kind
FROM (SELECT name, value FROM oa UNION ALL SELECT 'custkey', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders) GROUP BY name""")
def a5_infer_types(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    attrs = order_ocel(spark, d).object_attr.select("name", "value").unionAll(o.select(F.lit("custkey"), F.col("o_custkey").cast("string"))).unionAll(o.select(F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return catalog.infer_types(attrs)


@query(f"""WITH {OCEL_SQL} SELECT issue, count(*) AS affected FROM (
SELECT 'duplicate-event-id' AS issue FROM ev GROUP BY event_id HAVING count(*) > 1 UNION ALL
SELECT 'duplicate-object-id' FROM ob GROUP BY object_id HAVING count(*) > 1 UNION ALL
SELECT 'dangling-event' FROM e2o WHERE event_id NOT IN (SELECT event_id FROM ev) UNION ALL
SELECT 'dangling-object' FROM e2o WHERE object_id NOT IN (SELECT object_id FROM ob) UNION ALL
SELECT 'event-without-object' FROM ev WHERE event_id NOT IN (SELECT event_id FROM e2o) UNION ALL
SELECT 'object-without-event' FROM ob WHERE object_id NOT IN (SELECT object_id FROM e2o) UNION ALL
SELECT 'missing-time' FROM ev WHERE ts IS NULL) GROUP BY issue""")
def a6_validate(spark, d) -> DataFrame:
    return catalog.validate(order_ocel(spark, d))


@query(f"WITH {OCEL_SQL} SELECT *, (SELECT count(*) FROM ev WHERE ts IS NOT NULL) AS total, true AS truncated FROM (SELECT event_id, activity, ts FROM ev WHERE ts IS NOT NULL ORDER BY ts, event_id LIMIT 500)")
def a9_prefix_scan(spark, d) -> DataFrame:
    return catalog.prefix_scan(order_ocel(spark, d).events, 500)


@query("SELECT value AS answer, 'segment' AS step, count(*) AS n FROM (SELECT c_mktsegment AS value FROM customer) GROUP BY 1")
def a11_tally(spark, d) -> DataFrame:
    r = table(spark, d, "customer").select(F.array(F.struct(F.lit("segment").alias("step"), F.col("c_mktsegment").alias("answer"))).alias("responses"))
    return catalog.tally(r)


@query(f"WITH {OCEL_SQL} SELECT qualifier AS value, count(*) AS n FROM e2o GROUP BY 1")
def a12_options(spark, d) -> DataFrame:
    return catalog.options(order_ocel(spark, d).e2o, "qualifier")


@query(f"""WITH {OCEL_SQL}, ca AS (SELECT object_id, object_type, row_number() OVER (ORDER BY list_position(['Order','Customer'], object_type), object_id) - 1 AS trace_idx FROM ob WHERE object_type IN ('Order','Customer'))
SELECT CAST(trace_idx AS BIGINT) AS trace_idx, object_type, ca.object_id, ev.event_id, activity, ts FROM (SELECT DISTINCT event_id, object_id FROM e2o) x JOIN ca USING (object_id) JOIN ev USING (event_id)""")
def b1_flatten(spark, d) -> DataFrame:
    return olap.flatten(order_ocel(spark, d), TYPES)[1]


@query(f"WITH {FLAT_SQL} SELECT * FROM r WHERE object_type = (SELECT object_type FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def b2_flatten_most_frequent(spark, d) -> DataFrame:
    return olap.flatten_one(order_ocel(spark, d))


DRILL = "f AS (SELECT object_id, value FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ts NULLS FIRST, value) AS k FROM oa WHERE name = '{0}' AND coalesce(value,'') <> '') WHERE k = 1), dd AS (SELECT object_id, CASE WHEN object_type = '{1}' AND value IS NOT NULL THEN '(' || object_type || ', ' || value || ')' ELSE object_type END AS object_type FROM ob LEFT JOIN f USING (object_id))"


@query(f"WITH {OCEL_SQL}, {DRILL.format('last_priority', 'Customer')} SELECT * FROM dd")
def b3_drill_down(spark, d) -> DataFrame:
    return olap.drill_down(order_ocel(spark, d), "Customer", "last_priority").objects


@query(f"WITH {OCEL_SQL} SELECT * FROM ob")
def b4_roll_up(spark, d) -> DataFrame:
    return olap.roll_up(olap.drill_down(order_ocel(spark, d), "Order", "orderpriority"), "Order").objects


@query(f"WITH {OCEL_SQL} SELECT event_id, CASE WHEN activity = 'ship' AND event_id IN (SELECT event_id FROM e2o JOIN ob USING (object_id) WHERE object_type = 'Part' AND qualifier = 'item') THEN '(ship, Part)' ELSE activity END AS activity, ts FROM ev")
def b5_unfold(spark, d) -> DataFrame:
    return olap.unfold(order_ocel(spark, d), "ship", "Part", "item").events


@query(f"WITH {OCEL_SQL} SELECT event_id, activity, ts FROM ev")
def b6_fold(spark, d) -> DataFrame:
    return olap.fold(olap.unfold(order_ocel(spark, d), "ship", "Supplier"), "ship").events


BUCKET = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) % 1000000"
ABLATE = f"""pr AS (SELECT DISTINCT event_id, object_id FROM e2o), te AS (SELECT * FROM pr WHERE {BUCKET.format("event_id || '|t42'")} < 300000),
rk AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, row_number() OVER (PARTITION BY event_id ORDER BY {BUCKET.format("event_id || '|' || object_id || '|d42'")}, object_id) AS k FROM te),
dr AS (SELECT event_id, object_id FROM rk WHERE n > 1 AND k <= least(greatest(1, floor(n * 0.3)), n - 1))"""


@query(f"WITH {OCEL_SQL}, {ABLATE} SELECT * FROM dr")
def b7_ablate(spark, d) -> DataFrame:
    return olap.ablate(order_ocel(spark, d))


@query(f"WITH {OCEL_SQL} SELECT * FROM ev WHERE ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '1995-06-30 23:59:59.999999' AND activity IN ('ship')")
def b8_time_range(spark, d) -> DataFrame:
    return olap.in_range(order_ocel(spark, d).events, "1995-01-01", "1995-06-30", ["ship"])


@query(f"WITH {OCEL_SQL} SELECT object_id, name, CASE WHEN name = 'mktsegment' THEN sha256('pepper' || lower(trim(value))) ELSE lower(trim(value)) END AS value, ts FROM oa")
def b9_repair_values(spark, d) -> DataFrame:
    return olap.pseudonymise(olap.canonical_values(order_ocel(spark, d).object_attr), ["mktsegment"], "pepper")


@query(f"WITH {OCEL_SQL} SELECT event_id, activity, ts + to_microseconds(row_number() OVER (PARTITION BY ts ORDER BY event_id) - 1) AS ts FROM ev")
def b10_disambiguate_order(spark, d) -> DataFrame:
    return olap.repair_events(order_ocel(spark, d))


@query(f"WITH {OCEL_SQL} SELECT DISTINCT event_id, object_id, coalesce(qualifier,'') AS qualifier FROM e2o WHERE event_id IN (SELECT event_id FROM ev) AND object_id IN (SELECT object_id FROM ob)")
def b10_repair_relations(spark, d) -> DataFrame:
    return olap.repair_relations(order_ocel(spark, d))


@query(f"WITH {OCEL_SQL} SELECT * FROM ob WHERE object_id IN (SELECT object_id FROM e2o)")
def b10_drop_orphans(spark, d) -> DataFrame:
    return olap.drop_orphans(order_ocel(spark, d)).objects


@query(f"WITH {OCEL_SQL} SELECT * FROM ob WHERE lower(object_id) LIKE '%12%' ORDER BY object_id LIMIT 8")
def b11_search(spark, d) -> DataFrame:
    return olap.search_objects(order_ocel(spark, d), "12")


@query(f"WITH {LINE_SQL} SELECT case_id, activity, ts, event_id, resource FROM log WHERE activity IN (SELECT activity FROM log GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)")
def b12_top_activities(spark, d) -> DataFrame:
    return olap.top_activities(line_log(spark, d), 3).events.select("case_id", "activity", "ts", "event_id", "resource")


@query(f"WITH {LINE_SQL} SELECT case_id, event_id, l[1] AS base, CASE WHEN lower(l[2]) = 'start' THEN 'start' ELSE 'complete' END AS phase FROM (SELECT case_id, event_id, string_split(CASE WHEN activity LIKE 'R%' THEN activity || chr(31) || 'START' ELSE activity END, chr(31)) AS l FROM log)")
def b13_lifecycle(spark, d) -> DataFrame:
    e = line_log(spark, d).events
    e = e.withColumn("activity", F.when(F.startswith("activity", F.lit("R")), F.concat("activity", F.lit("\u001fSTART"))).otherwise(F.col("activity")))
    return olap.classify_lifecycle(e).select("case_id", "event_id", "base", "phase")


@query(f"WITH {LINE_SQL} SELECT case_id, event_id, resource FROM log WHERE resource IN (SELECT resource FROM log GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, 1 LIMIT 20)")
def b14_top_resources(spark, d) -> DataFrame:
    return olap.top_resources(line_log(spark, d), 20, 5).events.select("case_id", "event_id", "resource")


@query(f"WITH {FLAT_SQL} SELECT object_type, activity, count(*) AS n, count(DISTINCT event_id) AS events, count(DISTINCT object_id) AS objects FROM r GROUP BY 1, 2")
def c1_three_way(spark, d) -> DataFrame:
    return olap.relations(order_ocel(spark, d)).groupBy("object_type", "activity").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.countDistinct("object_id").alias("objects"))


@query(f"WITH {OCEL_SQL} SELECT object_id, coalesce(n, 0) AS n FROM ob LEFT JOIN (SELECT object_id, count(*) AS n FROM e2o GROUP BY 1) USING (object_id)")
def c2_left_outer(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return log.objects.join(log.e2o.groupBy("object_id").agg(F.count("*").alias("n")), "object_id", "left").select("object_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {OCEL_SQL}, {ABLATE} SELECT x.* FROM e2o x WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.event_id = x.event_id AND dr.object_id = x.object_id)")
def c3_anti(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return olap.without(log, olap.ablate(log)).e2o.select("event_id", "object_id", "qualifier")


@query(f"WITH {OCEL_SQL} SELECT * FROM e2o WHERE object_id IN (SELECT object_id FROM ob WHERE object_type = 'Supplier')")
def c4_semi(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return log.e2o.join(log.objects.where("object_type = 'Supplier'"), "object_id", "left_semi").select("event_id", "object_id", "qualifier")


@query(f"WITH {FLAT_SQL} SELECT a.object_type AS type_a, b.object_type AS type_b, count(*) AS n, count(DISTINCT a.event_id) AS events FROM r a JOIN r b ON a.event_id = b.event_id AND a.object_id < b.object_id GROUP BY 1, 2")
def c5_co_occurrence(spark, d) -> DataFrame:
    return joins.co_occurrence(order_ocel(spark, d))


ASOF = "h AS (SELECT * FROM oa WHERE name = 'last_priority'), aso AS (SELECT event_id, object_id, value FROM (SELECT r.event_id, r.object_id, h.value, row_number() OVER (PARTITION BY r.event_id, r.object_id ORDER BY h.ts IS NULL, h.ts DESC, h.value) AS k FROM (SELECT DISTINCT event_id, object_id, ts FROM r WHERE object_type = 'Customer') r LEFT JOIN h ON h.object_id = r.object_id AND (h.ts IS NULL OR h.ts <= r.ts)) WHERE k = 1)"


@query(f"WITH {FLAT_SQL}, {ASOF} SELECT * FROM aso")
def c6_as_of(spark, d) -> DataFrame:
    return joins.attribute_as_of(order_ocel(spark, d), "Customer", "last_priority")


@query(f"""WITH {USER_SQL}, w AS (SELECT epoch_us(lag(ts) OVER (PARTITION BY case_id ORDER BY ts, event_id)) AS a, epoch_us(ts) AS z FROM log), b AS (SELECT min(a) AS lo, max(z) AS hi FROM w WHERE a IS NOT NULL),
g AS (SELECT k, lo + (hi - lo) // 80 * k AS s, lo + (hi - lo) // 80 * (k + 1) AS e FROM b, range(80) t(k))
SELECT CAST(k AS INTEGER) AS bin, count(*) AS waiting FROM g JOIN w ON w.a < g.e AND w.z > g.s GROUP BY 1""")
def c7_range_overlap(spark, d) -> DataFrame:
    return joins.queue_depth(user_log(spark, d), 80)


@query(f"""WITH {FLAT_SQL}, q AS (SELECT DISTINCT event_id, object_id, epoch_us(ts) AS t FROM r WHERE object_type IN ('Order','Customer'))
SELECT DISTINCT a.event_id AS event_a, b.event_id AS event_b FROM q a JOIN q b ON a.object_id = b.object_id AND a.event_id < b.event_id AND abs(a.t - b.t) <= 7 * 86400000000""")
def c8_proximity(spark, d) -> DataFrame:
    return joins.near_in_time(order_ocel(spark, d), ["Order", "Customer"], 7 * 86_400_000_000)


@query(f"""WITH {FLAT_SQL}, l AS (SELECT object_id, object_type, min(ts) AS a, max(ts) AS z FROM r WHERE object_type IN ('Supplier','Customer') AND activity = 'place order' OR object_type = 'Supplier' GROUP BY 1, 2)
SELECT x.object_id AS supplier, count(*) AS overlapping FROM l x JOIN l y ON x.object_type = 'Supplier' AND y.object_type = 'Customer' AND greatest(x.a, y.a) <= least(x.z, y.z) GROUP BY 1""")
def c9_overlapping_lives(spark, d) -> DataFrame:
    r = olap.relations(order_ocel(spark, d)).where("object_type in ('Supplier', 'Customer') and activity = 'place order' or object_type = 'Supplier'")
    life = r.groupBy("object_id", "object_type").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return joins.count_overlaps(life.where("object_type = 'Supplier'"), life.where("object_type = 'Customer'")).select(F.col("object_id").alias("supplier"), "overlapping")


@query(f"WITH {OCEL_SQL} SELECT count(*) FILTER (WHERE object_type = 'Supplier') AS a, count(*) FILTER (WHERE object_type = 'Customer') AS b, CAST(count(*) FILTER (WHERE object_type = 'Supplier') * count(*) FILTER (WHERE object_type = 'Customer') AS BIGINT) AS opportunities FROM ob")
def c10_opportunities(spark, d) -> DataFrame:
    o = order_ocel(spark, d).objects
    return o.agg(F.count_if(F.col("object_type") == "Supplier").alias("a"), F.count_if(F.col("object_type") == "Customer").alias("b")).withColumn("opportunities", F.col("a") * F.col("b"))


@query(f"WITH {FLAT_SQL}, q AS (SELECT DISTINCT object_id, event_id, activity, ts FROM r WHERE object_type = 'Order') SELECT b.activity, count(*) AS n FROM q a JOIN q b ON a.object_id = b.object_id AND b.ts > a.ts WHERE a.activity = 'place order' GROUP BY 1")
def c11_after(spark, d) -> DataFrame:
    return joins.after(order_ocel(spark, d), "Order", "place order")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 5)")
def c12_subqueries(spark, d) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    mean = F.broadcast(o.agg(F.avg("o_totalprice").alias("mean")))  # one row
    many = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).count().where("count > 5")
    return o.join(mean, F.col("o_totalprice") > F.col("mean")).join(many, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query(f"WITH {OCEL_SQL} SELECT source_id AS object_id, target_id AS neighbour FROM o2o UNION SELECT target_id, source_id FROM o2o")
def c13_neighbours(spark, d) -> DataFrame:
    return joins.neighbours(order_ocel(spark, d))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, median(l_quantity) AS mid, quantile_cont(l_quantity, 0.9) AS p90, min(l_shipdate) AS first, max(l_shipdate) AS last, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1, 2")
def d1_aggregates(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.median("l_quantity").alias("mid"), F.percentile("l_quantity", F.lit(0.9)).alias("p90"),
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.round(F.avg("l_extendedprice"), 6).alias("mean"))


@query(f"WITH {LINE_SQL}, s AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts, event_id) AS seq, bool_or(activity LIKE 'R%') AS returned FROM log GROUP BY 1) SELECT seq, returned, count(*) AS n, min(case_id) AS example FROM s GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 40")
def d5_two_level(spark, d) -> DataFrame:
    e = line_log(spark, d).events
    s = e.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "activity"))), lambda x: x["activity"]), ">").alias("seq"), F.bool_or(F.startswith("activity", F.lit("R"))).alias("returned"))
    return s.groupBy("seq", "returned").agg(F.count("*").alias("n"), F.min("case_id").alias("example")).where("n between 2 and 40")


@query("SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def d9_distinct(spark, d) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()


@query(f"""WITH {USER_SQL} SELECT case_id, event_id, row_number() OVER w AS pos, lag(activity) OVER w AS before, lead(activity) OVER w AS after, count(*) OVER (PARTITION BY case_id) AS n,
CAST(ntile(4) OVER w AS INTEGER) AS quarter, rank() OVER (PARTITION BY case_id ORDER BY activity) AS by_name FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)""")
def d10_windows(spark, d) -> DataFrame:
    w, p = Window.partitionBy("case_id").orderBy(F.col("ts").asc_nulls_last(), "event_id"), Window.partitionBy("case_id")
    return user_log(spark, d).events.select(
        "case_id", "event_id", F.row_number().over(w).cast("long").alias("pos"), F.lag("activity").over(w).alias("before"), F.lead("activity").over(w).alias("after"),
        F.count("*").over(p).alias("n"), F.ntile(4).over(w).alias("quarter"), F.rank().over(p.orderBy("activity")).cast("long").alias("by_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5")
def d14_top_k(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(5).limit(10)


SETS = "u AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), v AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)"


@query(f"WITH {SETS} SELECT 'union' AS op, k FROM (SELECT * FROM u UNION SELECT * FROM v) UNION ALL SELECT 'except', k FROM (SELECT * FROM u EXCEPT SELECT * FROM v) UNION ALL SELECT 'intersect', k FROM (SELECT * FROM u INTERSECT SELECT * FROM v) UNION ALL SELECT 'union all', k FROM (SELECT * FROM u UNION ALL SELECT * FROM v)")
def d15_set_operators(spark, d) -> DataFrame:
    u = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    v = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    tag = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return tag("union", u.union(v).distinct()).unionAll(tag("except", u.subtract(v))).unionAll(tag("intersect", u.intersect(v))).unionAll(tag("union all", u.unionAll(v)))


@query(f"WITH {USER_SQL} SELECT event_id FROM log ORDER BY md5(CAST(event_id AS VARCHAR) || '|7'), event_id LIMIT 200")
def d18_sample(spark, d) -> DataFrame:
    return catalog.sample_rows(user_log(spark, d).events, "event_id", 200, seed=7).select("event_id")


@query("SELECT count(*) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM lineitem) AS lines, max(o_orderdate) AS last FROM orders")
def d19_overview(spark, d) -> DataFrame:
    n = [table(spark, d, t).agg(F.count("*").alias(a)) for t, a in (("customer", "customers"), ("lineitem", "lines"))]
    return table(spark, d, "orders").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last")).crossJoin(n[0]).crossJoin(n[1])  # one row each


@query(f"WITH {OCEL_SQL} SELECT event_id, count(*) OVER (PARTITION BY ts) AS tied FROM ev")
def d20_group_size(spark, d) -> DataFrame:
    return order_ocel(spark, d).events.select("event_id", F.count("*").over(Window.partitionBy("ts")).alias("tied"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def d21_cube(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("SELECT a.c_name AS a, b.c_name AS b, round(jaro_similarity(a.c_name, b.c_name), 6) AS jaro, round(jaro_winkler_similarity(a.c_name, b.c_name), 6) AS winkler, CAST(levenshtein(a.c_name, b.c_name) AS BIGINT) AS edits FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey * 7 % (SELECT count(*) FROM customer) + 1")
def e1_string_similarity(spark, d) -> DataFrame:
    from ..functions.text import jaro, jaro_winkler

    c = table(spark, d, "customer").select("c_custkey", "c_name")
    n = F.broadcast(c.agg(F.count("*").alias("n")))  # one row
    a = c.crossJoin(n).select(F.col("c_name").alias("a"), (F.col("c_custkey") * 7 % F.col("n") + 1).alias("k"))
    p = a.join(c.select(F.col("c_name").alias("b"), F.col("c_custkey").alias("k")), "k")
    # Few bytes and much work a row: dealt to as many tasks as there are partitions, and one Jaro similarity a pair.
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").withColumn("j", jaro("a", "b"))
    return p.select("a", "b", F.round("j", 6).alias("jaro"), F.round(jaro_winkler("a", "b", "j"), 6).alias("winkler"), F.levenshtein("a", "b").cast("long").alias("edits"))


@query("SELECT event_id, epoch_us(ts) AS us, date_trunc('day', ts) AS day, CAST(hour(ts) AS INTEGER) AS hr, dayname(ts) AS weekday, CAST(year(ts) AS INTEGER) AS yr, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def e2_time_and_json(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", micros("ts").alias("us"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.hour("ts").alias("hr"), F.date_format("ts", "EEEE").alias("weekday"), F.year("ts").alias("yr"), F.get_json_object("props", "$.k").cast("long").alias("k"))
