"""Logs derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import OCEL, EventLog


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def user_log(spark: SparkSession, folder: str) -> EventLog:
    """A case for each user."""
    e = table(spark, folder, "events")
    return EventLog(e.select(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("activity"), "ts", "event_id", "value"))


def day_log(spark: SparkSession, folder: str) -> EventLog:
    """A case for each user and day."""
    e = table(spark, folder, "events")
    case = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return EventLog(e.select(case.alias("case_id"), F.col("event_type").alias("activity"), "ts", "event_id", "value"))


def line_log(spark: SparkSession, folder: str) -> EventLog:
    """A case for each order, the order's lines as events; orders without lines are empty cases."""
    li = table(spark, folder, "lineitem")
    events = li.select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").alias("ts"),
        line_id().alias("event_id"),
        F.col("l_suppkey").cast("string").alias("resource"),
    )
    return EventLog(events, table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("case_id")))


def line_id():
    """The only unique key of a line, as text that sorts by its numbers."""
    parts = [F.lpad(F.col(c).cast("string"), 10, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat(F.lit("l:"), F.concat_ws("-", *parts))


def order_ocel(spark: SparkSession, folder: str) -> OCEL:
    """Orders placed and lines shipped, with customers, parts and suppliers."""
    o, li, c = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
    p, s = table(spark, folder, "part"), table(spark, folder, "supplier")
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    placed, shipped = key("e:", "o_orderkey"), line_id()
    events = o.select(placed.alias("event_id"), F.lit("place order").alias("activity"), F.col("o_orderdate").alias("ts")).unionAll(
        li.select(shipped.alias("event_id"), F.lit("ship").alias("activity"), F.col("l_shipdate").alias("ts"))
    )
    objects = o.select(key("o:", "o_orderkey").alias("object_id"), F.lit("Order").alias("object_type"))
    for df, prefix, col, kind in ((c, "c:", "c_custkey", "Customer"), (p, "p:", "p_partkey", "Part"), (s, "s:", "s_suppkey", "Supplier")):
        objects = objects.unionAll(df.select(key(prefix, col), F.lit(kind)))
    # All relations of an event from one row: its id is made once, and its rows lie together when they are shuffled by event.
    related = lambda *to: F.inline(F.array(*[F.struct(key(prefix, col).alias("object_id"), F.lit(q).alias("qualifier")) for prefix, col, q in to]))
    e2o = o.select(placed.alias("event_id"), "o_orderkey", "o_custkey").select("event_id", related(("o:", "o_orderkey", "places"), ("c:", "o_custkey", "by"))).unionAll(
        li.select(shipped.alias("event_id"), "l_orderkey", "l_partkey", "l_suppkey").select("event_id", related(("o:", "l_orderkey", "ships"), ("p:", "l_partkey", "item"), ("s:", "l_suppkey", "from")))
    )
    o2o = o.select(key("o:", "o_orderkey").alias("source_id"), key("c:", "o_custkey").alias("target_id"), F.lit("belongs to").alias("qualifier"))
    event_attr = li.select(shipped.alias("event_id"), F.lit("returnflag").alias("name"), F.col("l_returnflag").alias("value")).unionAll(
        li.select(shipped, F.lit("linestatus"), F.col("l_linestatus"))
    )
    never = F.lit(None).cast("timestamp_ntz").alias("ts")
    object_attr = c.select(key("c:", "c_custkey").alias("object_id"), F.lit("mktsegment").alias("name"), F.col("c_mktsegment").alias("value"), never)
    for col, name in (("o_orderpriority", "orderpriority"), ("o_orderstatus", "orderstatus")):
        object_attr = object_attr.unionAll(o.select(key("o:", "o_orderkey"), F.lit(name), F.col(col), never))
    # A history: the priority of a customer's latest order so far; of one day's orders the last by key.
    day = o.groupBy("o_custkey", "o_orderdate").agg(F.max(F.struct("o_orderkey", "o_orderpriority"))["o_orderpriority"].alias("value"))
    object_attr = object_attr.unionAll(day.select(key("c:", "o_custkey"), F.lit("last_priority"), F.col("value"), F.col("o_orderdate")))
    return OCEL(events, objects, e2o, o2o, event_attr, object_attr)


def activity_ocel(spark: SparkSession, folder: str) -> OCEL:
    """Users' events with two types of objects: the user, and the user's day."""
    e = table(spark, folder, "events")
    user = F.concat(F.lit("u:"), F.col("user_id").cast("string"))
    day = F.concat(F.lit("d:"), F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    objects = e.select(user.alias("object_id"), F.lit("User").alias("object_type")).unionAll(e.select(day, F.lit("Day"))).where("object_id is not null").distinct()
    e2o = e.select("event_id", user.alias("object_id"), F.lit("by").alias("qualifier")).unionAll(e.select("event_id", day, F.lit("on"))).where("object_id is not null")
    return OCEL(e.select("event_id", F.col("event_type").alias("activity"), "ts"), objects, e2o)


# The same logs as DuckDB common table expressions, for the oracle.
USER_SQL = "log AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts, event_id, value FROM events)"
DAY_SQL = "log AS (SELECT CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d') AS case_id, event_type AS activity, ts, event_id, value FROM events)"
_LINE_ID = "'l:' || lpad(CAST(l_orderkey AS VARCHAR),10,'0') || '-' || lpad(CAST(l_linenumber AS VARCHAR),10,'0') || '-' || lpad(CAST(l_partkey AS VARCHAR),10,'0') || '-' || lpad(CAST(l_suppkey AS VARCHAR),10,'0')"
LINE_SQL = f"log AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity, l_shipdate AS ts, {_LINE_ID} AS event_id, CAST(l_suppkey AS VARCHAR) AS resource FROM lineitem), cases AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id FROM orders)"
OCEL_SQL = f"""ev AS (SELECT 'e:' || o_orderkey AS event_id, 'place order' AS activity, o_orderdate AS ts FROM orders UNION ALL SELECT {_LINE_ID}, 'ship', l_shipdate FROM lineitem),
ob AS (SELECT 'o:' || o_orderkey AS object_id, 'Order' AS object_type FROM orders UNION ALL SELECT 'c:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'p:' || p_partkey, 'Part' FROM part UNION ALL SELECT 's:' || s_suppkey, 'Supplier' FROM supplier),
e2o AS (SELECT 'e:' || o_orderkey AS event_id, 'o:' || o_orderkey AS object_id, 'places' AS qualifier FROM orders UNION ALL SELECT 'e:' || o_orderkey, 'c:' || o_custkey, 'by' FROM orders UNION ALL SELECT {_LINE_ID}, 'o:' || l_orderkey, 'ships' FROM lineitem UNION ALL SELECT {_LINE_ID}, 'p:' || l_partkey, 'item' FROM lineitem UNION ALL SELECT {_LINE_ID}, 's:' || l_suppkey, 'from' FROM lineitem),
o2o AS (SELECT 'o:' || o_orderkey AS source_id, 'c:' || o_custkey AS target_id, 'belongs to' AS qualifier FROM orders),
ea AS (SELECT {_LINE_ID} AS event_id, 'returnflag' AS name, l_returnflag AS value FROM lineitem UNION ALL SELECT {_LINE_ID}, 'linestatus', l_linestatus FROM lineitem),
oa AS (SELECT 'c:' || c_custkey AS object_id, 'mktsegment' AS name, c_mktsegment AS value, CAST(NULL AS TIMESTAMP) AS ts FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'orderpriority', o_orderpriority, NULL FROM orders UNION ALL SELECT 'o:' || o_orderkey, 'orderstatus', o_orderstatus, NULL FROM orders UNION ALL SELECT 'c:' || o_custkey, 'last_priority', arg_max(o_orderpriority, o_orderkey), o_orderdate FROM orders GROUP BY o_custkey, o_orderdate)"""
#: Event-object rows with their types and times.
FLAT_SQL = OCEL_SQL + ", r AS (SELECT e.event_id, e.activity, e.ts, x.object_id, o.object_type, x.qualifier FROM e2o x JOIN ev e USING (event_id) JOIN ob o USING (object_id))"
