"""Significance and correlation of activities and of their successions over several steps.

Spark counts successions by distance, with sums of their proximity in time and of the likeness of their originators'
names; what follows is arithmetic on tables with a row an activity or a pair of activities. Every measure is scaled to
its weight, mirrored there if it is inverted, and the weighted measures are summed and scaled to 1:

* frequency of activities, and routing (how far an activity's weighted in- and outflow differ);
* frequency of successions, and distance (whether a succession is as significant as its two activities);
* proximity (the mean of 1 / ms), endpoint (likeness of the names) and originator (likeness of the resources).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EventLog, in_order
from .graph import settled

MEASURES = ("frequency", "routing", "edge_frequency", "distance", "proximity", "endpoint", "originator")
NOBODY = "<no resource>"


def likeness(a: Column, b: Column) -> Column:
    """Share of letters that an edit distance leaves: (longer length - distance) / longer length; 1 for empty names."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def scan(log: EventLog, most: int = 20) -> DataFrame:
    """(source, target, distance, n, near, alike): successions over up to ``most`` steps, and the sums of 1 / ms between
    their events (1 for none, 0 without times) and of the likeness of their resources."""
    w = in_order("case_id")
    e = log.events if "resource" in log.events.columns else log.events.withColumn("resource", F.lit(None).cast("string"))
    e = e.select("case_id", "ts", "event_id", "activity", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), F.coalesce(F.col("resource").cast("string"), F.lit(NOBODY)).alias("resource"))
    step = F.struct("activity", "ms", "resource")
    lagged = e.select("activity", "ms", "resource", *[F.lag(step, k).over(w).alias(f"l{k}") for k in range(1, most + 1)])
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("distance"), F.col(f"l{k}").alias("from")) for k in range(1, most + 1)])).alias("s")
    x = lagged.select("activity", "ms", "resource", steps).where("s.from is not null")
    gap = F.col("ms") - F.col("s.from.ms")
    near = F.when(gap.isNull(), 0.0).when(gap == 0, 1.0).otherwise(1.0 / gap)
    # Names meet once for each pair, not for each event.
    pairs = x.groupBy(F.col("s.from.activity").alias("source"), F.col("activity").alias("target"), F.col("s.distance").alias("distance"), F.col("s.from.resource").alias("ra"), F.col("resource").alias("rb")).agg(F.count("*").alias("n"), F.sum(near).alias("near"))
    return pairs.groupBy("source", "target", "distance").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), F.sum(F.col("n") * likeness(F.col("ra"), F.col("rb"))).alias("alike"))


def weakened(kind: str, radical: float, distance: Column) -> Column:
    """What a succession over so many steps counts: radical ** -(steps - 1), or linear down to 0."""
    if kind == "linear":
        return F.when(distance <= 1, 1.0).otherwise(F.greatest((F.lit(radical) - distance + 1) / radical, F.lit(0.0)))
    return F.pow(F.lit(radical), 1 - distance)


def _most(x: Column) -> Column:
    """The greatest value, over a table with a row an activity or a pair of activities."""
    return F.max(x).over(Window.partitionBy(F.lit(1)))


def to_weight(x: Column, weight: float, inverted: bool) -> Column:
    """Scaled so that the greatest is ``weight``, then mirrored if inverted; 0 without weight."""
    if weight == 0:
        return F.lit(0.0)
    most = _most(x)
    scaled = F.when(most > 0, x * weight / most).otherwise(x)
    return F.lit(weight) - scaled if inverted else scaled


def to_one(x: Column) -> Column:
    most = _most(x)
    return F.when(most > 0, x / most).otherwise(x)


def model(log: EventLog, most: int = 5, attenuation: str = "root", radical: float = 2.7, weights: dict[str, float] | None = None, inverted: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(activities, pairs): (activity, n, frequency, routing, significance) and, of every ordered pair of activities,
    (source, target, edge_frequency, distance, proximity, endpoint, originator, significance, correlation), to 6 places."""
    weight = dict.fromkeys(MEASURES, 1.0) | (weights or {})
    scaled = lambda x, name: to_weight(x, weight[name], name in inverted)
    counts = settled(log.events.groupBy("activity").agg(F.count("*").cast("double").alias("n")))
    share = weakened(attenuation, radical, F.col("distance"))
    raw = settled(scan(log, most).groupBy("source", "target").agg(*[F.sum(F.col(c) * share).alias(c) for c in ("n", "near", "alike")]))
    names = counts.select(F.col("activity").alias("source"))
    grid = F.broadcast(names).crossJoin(names.select(F.col("source").alias("target")))  # pairs of names
    x = grid.join(raw, ["source", "target"], "left").fillna(0.0, ["n", "near", "alike"])
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.col(c))
    x = x.withColumns({"near": mean("near"), "alike": mean("alike"), "names": F.when(F.col("n") > 0, likeness(F.col("source"), F.col("target"))).otherwise(0.0)})
    x = x.select("source", "target", scaled(F.col("n"), "edge_frequency").alias("edge_frequency"), scaled(F.col("near"), "proximity").alias("proximity"), scaled(F.col("names"), "endpoint").alias("endpoint"), scaled(F.col("alike"), "originator").alias("originator"))
    x = settled(x.withColumns({"link": to_one(F.col("edge_frequency")), "tie": to_one(F.col("proximity") + F.col("endpoint") + F.col("originator"))}))
    other = x.where("source <> target").withColumn("w", F.col("link") * F.col("tie"))
    flow = other.groupBy(F.col("source").alias("activity")).agg(F.sum("w").alias("out")).join(other.groupBy(F.col("target").alias("activity")).agg(F.sum("w").alias("into")), "activity")
    a = counts.join(flow, "activity", "left").fillna(0.0, ["out", "into"])
    lop = F.when(F.col("out") + F.col("into") == 0, 0.0).otherwise(F.abs(F.col("into") - F.col("out")) / (F.col("into") + F.col("out")))
    a = a.withColumn("lop", lop).withColumns({"frequency": scaled(F.col("n"), "frequency")})
    a = settled(a.withColumns({"simple": to_one(F.col("frequency")), "routing": scaled(F.col("lop"), "routing") if weight["routing"] else F.lit(0.0)}))
    p, q = (a.select(F.col("activity").alias(s), F.col("simple").alias(f"s_{s}")) for s in ("source", "target"))
    both = F.col("s_source") + F.col("s_target")
    x = x.join(F.broadcast(p), "source").join(F.broadcast(q), "target").withColumn("far", F.when(both == 0, 0.0).otherwise(1 - (both - 2 * F.col("link")) / both))
    x = x.withColumn("distance", scaled(F.col("far"), "distance"))
    six = lambda c: F.round(c, 6)
    activities = a.select("activity", F.col("n").cast("long").alias("n"), six("frequency").alias("frequency"), six("routing").alias("routing"), six(to_one(F.col("frequency") + F.col("routing"))).alias("significance"))
    pairs = x.select("source", "target", *[six(c).alias(c) for c in ("edge_frequency", "distance", "proximity", "endpoint", "originator")], six(to_one(F.col("edge_frequency") + F.col("distance"))).alias("significance"), six(to_one(F.col("proximity") + F.col("endpoint") + F.col("originator"))).alias("correlation"))
    return activities, pairs
