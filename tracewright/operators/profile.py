"""Waiting times, variants, spectra and object-centric profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import OCEL, EventLog, in_order, micros, ratio
from .graph import settled
from .olap import by_type, by_types, relations, shapes
from .ordered import numbered, top_of_each


def entity_stream(log: EventLog) -> DataFrame:
    """Events with neighbours, wait in milliseconds, position and length of their case."""
    w = in_order("case_id")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    e = log.events.withColumn("t", t)
    return e.select(
        *e.columns, F.lag("activity").over(w).alias("prev"), F.lead("activity").over(w).alias("next"),
        (F.col("t") - F.lag("t").over(w)).alias("wait_ms"), F.row_number().over(w).cast("long").alias("pos"),
        F.count("*").over(Window.partitionBy("case_id")).alias("len"),
    )


def activity_stats(log: EventLog) -> DataFrame:
    """One row for each activity: counts, waits, median position and the share of its cases that repeat it."""
    s = entity_stream(log)
    rework = s.groupBy("case_id", "activity").agg(F.count("*").alias("k")).groupBy("activity").agg(F.avg(F.when(F.col("k") > 1, 1.0).otherwise(0.0)).alias("rework"))
    wait = F.col("wait_ms")
    return s.groupBy("activity").agg(
        F.count("*").alias("n"), F.countDistinct("case_id").alias("entities"), F.count_if(F.col("pos") == 1).alias("starts"), F.count_if(F.col("pos") == F.col("len")).alias("ends"),
        F.count_if(F.col("prev") == F.col("activity")).alias("self_loops"), F.median(wait).alias("median_wait"), F.percentile(wait, F.lit(0.9)).alias("p90_wait"), F.avg(wait).alias("mean_wait"),
        F.min(wait).alias("min_wait"), F.max(wait).alias("max_wait"), F.sum(wait).alias("total_wait"), F.median("pos").alias("median_pos"),
    ).join(rework, "activity")


def edge_stats(log: EventLog) -> DataFrame:
    s = entity_stream(log).where("prev is not null")
    return s.groupBy("prev", "activity").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("entities"), F.median("wait_ms").alias("median_wait"), F.percentile("wait_ms", F.lit(0.9)).alias("p90_wait"), F.sum("wait_ms").alias("total_wait"))


def overview(log: EventLog) -> DataFrame:
    s = entity_stream(log)
    by_case = s.groupBy("case_id").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z"), F.sum("wait_ms").alias("w"))
    kinds = s.agg(F.countDistinct("activity").alias("activities"))  # one row
    return by_case.agg(F.count("*").alias("entities"), F.sum("n").alias("events"), F.median(F.col("z") - F.col("a")).alias("median_cycle"), F.percentile(F.col("z") - F.col("a"), F.lit(0.9)).alias("p90_cycle"), (F.max("z") - F.min("a")).alias("span"), F.sum("w").alias("total_wait")).crossJoin(kinds)


def wait_breakdown(log: EventLog, activity: str, by: Column, most: int = 24) -> DataFrame:
    """(bucket, n, median_wait, total_wait) of one activity by a key, the longest total first."""
    s = entity_stream(log).where((F.col("activity") == activity) & F.col("wait_ms").isNotNull())
    return s.groupBy(by.cast("string").alias("bucket")).agg(F.count("*").alias("n"), F.median("wait_ms").alias("median_wait"), F.sum("wait_ms").alias("total_wait")).orderBy(F.desc("total_wait"), "bucket").limit(most)


def low_cardinality(attrs: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """(name, n_values) of attributes with few values."""
    return attrs.groupBy("name").agg(F.countDistinct("value").alias("n_values")).where(F.col("n_values").between(least, most))


def variants_through(log: EventLog, activity: str) -> DataFrame:
    """Variants of the cases that have the activity: signature, entities, median cycle, median wait here, example."""
    s = entity_stream(log)
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "activity"))), lambda x: x["activity"]), ">")
    c = s.groupBy("case_id").agg(seq.alias("signature"), (F.max("t") - F.min("t")).alias("cycle"), F.sum(F.when(F.col("activity") == activity, F.col("wait_ms"))).alias("wait_here"), F.max(F.col("activity") == activity).alias("has"))
    return c.where("has").groupBy("signature").agg(F.count("*").alias("entities"), F.median("cycle").alias("median_cycle"), F.median("wait_here").alias("median_wait_here"), F.min("case_id").alias("example"))


def worst_cases(log: EventLog, activity: str, most: int = 60) -> DataFrame:
    s = entity_stream(log)
    worst = s.where(F.col("activity") == activity).groupBy("case_id").agg(F.max("wait_ms").alias("worst_wait"), F.sum("wait_ms").alias("sum_wait")).where("worst_wait is not null").orderBy(F.desc("worst_wait"), "case_id").limit(most)
    shape = s.groupBy("case_id").agg(F.count("*").alias("events"), (F.max("t") - F.min("t")).alias("cycle"))
    return shape.join(worst, "case_id")


def spectrum(log: EventLog) -> DataFrame:
    """Directly-follows segments with times in microseconds, and the quartile of their duration among equal segments."""
    w = in_order("case_id")
    s = log.events.select("case_id", "event_id", F.col("activity").alias("source"), F.lead("activity").over(w).alias("target"), micros("ts").alias("start"), micros(F.lead("ts").over(w)).alias("end")).where("target is not null").withColumn("duration", F.col("end") - F.col("start"))
    return s.withColumn("quartile", F.ntile(4).over(Window.partitionBy("source", "target").orderBy("duration", "case_id", "start", "event_id")))


def dotted_chart(log: EventLog) -> DataFrame:
    """Events with their case's first and last time and their rank in it."""
    p, w = Window.partitionBy("case_id"), in_order("case_id")
    return log.events.select("case_id", "event_id", "activity", micros("ts").alias("t"), micros(F.min("ts").over(p)).alias("first_t"), micros(F.max("ts").over(p)).alias("last_t"), (F.row_number().over(w) - 1).cast("long").alias("logical_idx"))


def timing_overview(events: DataFrame) -> DataFrame:
    """One row: days, events a day, the busiest day, the share of whole seconds and midnights, the hour of most events.

    The median gap between consecutive events comes from the sorted distinct times, counted by day first: gaps inside a
    day are windows of that day, gaps between days need one row a day.
    """
    d = F.date_trunc("day", "ts").cast("timestamp_ntz")
    by_day = events.groupBy(d.alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    inside = events.select((micros("ts") - micros(F.lag("ts").over(Window.partitionBy(d).orderBy("ts", "event_id")))).alias("gap")).where("gap is not null")
    between = by_day.select((micros("a") - micros(F.lag("z").over(Window.orderBy("day")))).alias("gap")).where("gap is not null")  # one row a day
    gap = inside.unionAll(between).agg(F.median("gap").alias("median_gap_us"))
    us = micros("ts")
    grain = events.agg(F.avg(F.when(us % 1_000_000 == 0, 1.0).otherwise(0.0)).alias("whole_second_share"), F.avg(F.when(us % 86_400_000_000 == 0, 1.0).otherwise(0.0)).alias("midnight_share"), ratio(F.countDistinct("ts"), F.count("ts")).alias("distinct_share"))
    days = by_day.agg(F.count("*").alias("active_days"), F.median("n").alias("median_per_day"), F.max("n").alias("busiest"))
    return days.crossJoin(gap).crossJoin(grain)  # one row each


def by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def structure(log: OCEL) -> DataFrame:
    """One row: objects an event, events an object, and orphans of both kinds."""
    per_event = log.e2o.groupBy("event_id").agg(F.countDistinct("object_id").alias("k")).agg(F.avg("k").alias("objects_per_event"), F.max("k").alias("max_objects"))
    per_object = log.e2o.groupBy("object_id").agg(F.countDistinct("event_id").alias("k")).agg(F.avg("k").alias("events_per_object"), F.max("k").alias("max_events"))
    lone = log.events.join(log.e2o, "event_id", "left_anti").agg(F.count("*").alias("lone_events"))
    idle = log.objects.join(log.e2o, "object_id", "left_anti").agg(F.count("*").alias("lone_objects"))
    kinds = log.e2o.agg(F.countDistinct("qualifier").alias("qualifiers"))
    return per_event.crossJoin(per_object).crossJoin(lone).crossJoin(idle).crossJoin(kinds)  # one row each


def activity_type_matrix(log: OCEL) -> DataFrame:
    """(activity, object_type, events, relations, most, share of the activity's events)."""
    k = relations(log, by="event_id").groupBy("activity", "object_type", "event_id").agg(F.count("*").alias("k"))
    all_ = log.events.groupBy("activity").agg(F.count("*").alias("total"))
    return k.groupBy("activity", "object_type").agg(F.count("*").alias("events"), F.sum("k").alias("relations"), F.max("k").alias("most")).join(all_, "activity").select("activity", "object_type", "events", "relations", "most", ratio(F.col("events"), F.col("total")).alias("share"))


def lives(log: OCEL) -> DataFrame:
    """(object_type, object_id, seq): each object's activities in order; an event counts once, however often related."""
    r = relations(log).select("object_type", "object_id", "event_id", "activity", "ts")
    seq = F.transform(F.array_sort(F.collect_set(F.struct(F.col("ts").isNull().alias("n"), "ts", "event_id", "activity"))), lambda x: x["activity"])
    return r.groupBy("object_type", "object_id").agg(seq.alias("seq"))


def life_paths(log: OCEL) -> DataFrame:
    """(object_type, object_id, path, length): each object's activities in order, as text."""
    return lives(log).select("object_type", "object_id", F.array_join("seq", ">").alias("path"), F.size("seq").cast("long").alias("length"))


def type_lifecycles(log: OCEL) -> DataFrame:
    """By type: objects, variants, entropy of variants over its maximum, median and longest path, the commonest path."""
    paths = life_paths(log)
    v = paths.groupBy("object_type", "path").agg(F.count("*").alias("n"))
    total = Window.partitionBy("object_type")
    p = F.col("n") / F.sum("n").over(total)
    rank = F.row_number().over(total.orderBy(F.desc("n"), "path"))
    v = v.select("object_type", "path", "n", (-p * F.ln(p)).alias("h"), rank.alias("k"))
    entropy = F.when(F.count("*") > 1, F.sum("h") / F.ln(F.count("*"))).otherwise(0.0)
    a = v.groupBy("object_type").agg(F.sum("n").alias("objects"), F.count("*").alias("variants"), F.round(entropy, 9).alias("entropy"), F.max(F.when(F.col("k") == 1, F.col("path"))).alias("top_path"))
    return a.join(paths.groupBy("object_type").agg(F.median("length").alias("median_length"), F.max("length").alias("max_length")), "object_type")


def multiplicity(log: OCEL) -> DataFrame:
    """(activity, object_type, events, least, most, mid, mean, exactly_one) of objects in an event."""
    k = by_type(shapes(log, "activity"), "activity")
    return k.groupBy("activity", "object_type").agg(
        F.sum("n").alias("events"), F.min("k").alias("least"), F.max("k").alias("most"), F.percentile("k", F.lit(0.5), F.col("n")).alias("mid"), ratio(F.sum(F.col("k") * F.col("n")), F.sum("n")).alias("mean"),
        F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("exactly_one"),
    )


def type_signatures(log: OCEL) -> DataFrame:
    """(activity, signature, n): sets of types that events relate to."""
    # Events without relations stay in the same join; those whose objects are all unknown have no signature.
    r = log.e2o.join(log.objects.withColumn("_known", F.lit(True)), "object_id", "left").select("event_id", "object_type", F.coalesce("_known", F.lit(False)).alias("_known"))
    e = log.events.join(r, "event_id", "left").groupBy("event_id", "activity").agg(F.array_join(F.array_sort(F.collect_set("object_type")), "+").alias("signature"), F.max("_known").alias("_known"), F.count("*").alias("rows"))
    e = e.where(F.coalesce("_known", F.lit(True))).select("activity", "signature", F.when(F.col("_known"), 1).otherwise(F.col("rows")).alias("n"))
    return e.groupBy("activity", "signature").agg(F.sum("n").alias("n"))


def repetition(log: OCEL, most: int = 5, by: str = "object_id") -> DataFrame:
    """(object_type, activity, times, objects): how often an activity happens to an object, ``most`` and over together.

    ``by`` event_id shares its shuffles with ``shapes``; only counts go to the objects then.
    """
    r = relations(log, by=by).select("event_id", "activity", "object_id", "object_type").where("event_id is not null").distinct()
    k = r.groupBy("object_type", "activity", "object_id").agg(F.count("*").alias("k"))
    return k.groupBy("object_type", "activity", F.least(F.col("k"), F.lit(most)).alias("times")).agg(F.count("*").alias("objects"))


def first_after(log: OCEL, object_type: str, a: str, b: str) -> DataFrame:
    """(object_id, event_id, delta_us): each ``a`` with the first strictly later ``b`` of the object, null if none."""
    q = relations(log).where(F.col("object_type") == object_type).select("object_id", "event_id", "activity", "ts").distinct()
    later = Window.partitionBy("object_id").orderBy("us").rangeBetween(1, Window.unboundedFollowing)
    x = q.withColumn("us", micros("ts")).withColumn("hit", F.min(F.when(F.col("activity") == b, F.col("us"))).over(later))
    return x.where(F.col("activity") == a).select("object_id", "event_id", (F.col("hit") - F.col("us")).alias("delta_us"))


def next_after(log: OCEL, object_type: str, a: str, b: str) -> DataFrame:
    """(object_id, k, delta_us): ``a`` events matched first in, first out with later ``b`` events, one to one.

    The k-th matched b is the k-th that finds a waiting a. A b is matched unless all earlier a's are used up: with s the
    running a's less b's, and m the least of s so far (at most 0), matched b's so far are b's + m.
    """
    q = relations(log).where(F.col("object_type") == object_type).where(F.col("activity").isin(a, b)).select("object_id", "event_id", "activity", "ts").distinct()
    # At equal times b comes first, so a b never matches an a of its own time.
    w = Window.partitionBy("object_id").orderBy("ts", F.col("activity") == a, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    is_a, is_b = F.when(F.col("activity") == a, 1).otherwise(0), F.when(F.col("activity") == b, 1).otherwise(0)
    x = q.withColumn("na", F.sum(is_a).over(w)).withColumn("nb", F.sum(is_b).over(w)).withColumn("low", F.least(F.lit(0), F.min(F.col("na") - F.col("nb")).over(w)))
    prior = F.coalesce(F.lag("low").over(Window.partitionBy("object_id").orderBy("ts", F.col("activity") == a, "event_id")), F.lit(0))
    x = x.withColumn("matched", (F.col("activity") == b) & (F.col("low") == prior)).withColumn("k", F.when(F.col("activity") == a, F.col("na")).otherwise(F.col("nb") + F.col("low")))
    left = x.where(F.col("activity") == a).select("object_id", "k", micros("ts").alias("ta"))
    right = x.where("matched").select("object_id", "k", micros("ts").alias("tb"))
    return left.join(right, ["object_id", "k"]).select("object_id", F.col("k").cast("long").alias("k"), (F.col("tb") - F.col("ta")).alias("delta_us"))


def history(log: OCEL, attribute: str) -> DataFrame:
    """An attribute's values with the value before."""
    w = Window.partitionBy("object_id").orderBy(F.col("ts").asc_nulls_first(), "value")
    return log.object_attr.where(F.col("name") == attribute).select("object_id", "ts", "value", F.lag("value").over(w).alias("previous"), F.count("*").over(Window.partitionBy("object_id")).alias("changes"))


def timeline(log: OCEL) -> DataFrame:
    """(object_id, ts, kind, what): an object's events and attribute changes in one list."""
    r = relations(log).select("object_id", "ts", F.lit("event").alias("kind"), F.col("activity").alias("what")).distinct()
    return r.unionAll(log.object_attr.where("ts is not null").select("object_id", "ts", F.lit("change"), F.concat_ws("=", "name", "value")))


def state_at(log: OCEL, moment: str) -> DataFrame:
    """(object_id, name, value): every attribute as of a moment; a null time is before all others."""
    w = Window.partitionBy("object_id", "name").orderBy(F.col("ts").desc_nulls_last(), "value")
    seen = log.object_attr.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(moment).cast("timestamp_ntz")))
    return seen.withColumn("k", F.row_number().over(w)).where("k = 1").select("object_id", "name", "value")


def phases(log: OCEL, types: list[str]) -> DataFrame:
    """(event_id, object_id, object_type, phase): where in its object's life an event lies, 0.5 in a life of no length."""
    r = relations(log).where(F.col("object_type").isin(types)).select("event_id", "object_id", "object_type", micros("ts").alias("t")).distinct()
    life = r.groupBy("object_id").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    return r.join(life, "object_id").select("event_id", "object_id", "object_type", F.when(F.col("z") > F.col("a"), (F.col("t") - F.col("a")) / (F.col("z") - F.col("a"))).otherwise(0.5).alias("phase"))


def interaction_field(log: OCEL, x: str, y: str, bins: int = 24) -> DataFrame:
    """(bin_x, bin_y, raw, mass): events' pairs of objects of two types by both phases; an event's pairs share mass 1."""
    p = phases(log, [x, y])
    k = F.least(F.floor(F.col("phase") * bins), F.lit(bins - 1)).cast("int")
    a = p.where(F.col("object_type") == x).select("event_id", F.col("object_id").alias("ia"), k.alias("bin_x"))
    b = p.where(F.col("object_type") == y).select("event_id", F.col("object_id").alias("ib"), k.alias("bin_y"))
    pairs = a.join(b, "event_id").where("ia <> ib" if x != y else "ia < ib")
    pairs = pairs.withColumn("n", F.count("*").over(Window.partitionBy("event_id")))  # the pairs lie by event already
    return pairs.groupBy("bin_x", "bin_y").agg(F.count("*").alias("raw"), F.round(F.sum(1.0 / F.col("n")), 9).alias("mass"))


def pair_totals(log: OCEL) -> DataFrame:
    """By type pair: events with both, and in how many of them one or more objects of each."""
    p = by_types(shapes(log), "type_a", "type_b").where("type_a < type_b")
    several = lambda c, i: F.col(f"n_type_{c}") == 1 if i else F.col(f"n_type_{c}") > 1
    one = lambda i, j: F.sum(F.when(several("a", i) & several("b", j), F.col("n")).otherwise(0))
    return p.groupBy("type_a", "type_b").agg(F.sum("n").alias("events"), one(1, 1).alias("one_one"), one(1, 0).alias("one_many"), one(0, 1).alias("many_one"), one(0, 0).alias("many_many"))


def cardinality_evidence(log: OCEL) -> DataFrame:
    """(source, target, n, p25, mid, p75, support): objects of ``target`` in the events of each ``source`` object.

    Only events that have both types count; support is the share of the source type's event relations among them.
    """
    s = settled(shapes(log))
    pairs = by_types(s, "source", "target").withColumn("times", F.col("n") * F.col("n_source"))  # each object of the source
    total = by_type(s).groupBy(F.col("object_type").alias("source")).agg(F.sum(F.col("n") * F.col("k")).alias("total"))
    q = lambda p: F.greatest(F.lit(1), F.round(F.percentile("n_target", F.lit(p), F.col("times")))).cast("long")
    e = pairs.groupBy("source", "target").agg(F.sum("times").alias("n_obs"), q(0.25).alias("p25"), q(0.5).alias("mid"), q(0.75).alias("p75"))
    return e.join(total, "source").select("source", "target", F.col("n_obs").alias("n"), "p25", "mid", "p75", F.round(100 * F.col("n_obs") / F.col("total"), 6).alias("support"))


def ocdfg(log: OCEL) -> tuple[DataFrame, DataFrame]:
    """Object-centric directly-follows graph: nodes (objects, starts, ends) and edges (n, mean microseconds)."""
    r = relations(log).select("object_type", "object_id", "event_id", "activity", "ts").distinct()
    w = in_order("object_type", "object_id")
    e = r.select("object_type", "object_id", "activity", micros("ts").alias("t"), F.lead("activity").over(w).alias("target"), micros(F.lead("ts").over(w)).alias("t2"), F.lag("activity").over(w).alias("before"))
    nodes = e.groupBy("object_type", "activity").agg(F.countDistinct("object_id").alias("objects"), F.count_if(F.col("before").isNull()).alias("starts"), F.count_if(F.col("target").isNull()).alias("ends"))
    edges = e.where("target is not null").groupBy("object_type", F.col("activity").alias("source"), "target").agg(F.count("*").alias("n"), F.avg(F.col("t2") - F.col("t")).alias("mean_us"))
    return nodes, edges


def interaction_patterns(log: OCEL) -> DataFrame:
    """By activity and type: related, divergent (an object repeats the activity with another set of the rest),
    convergent (an event has several), deficient (an event has none)."""
    k = by_type(shapes(log, "activity"), "activity")
    conv = k.groupBy("activity", "object_type").agg(F.bool_or(F.col("k") > 1).alias("convergent"), F.sum("n").alias("with_it"))
    total = log.events.groupBy("activity").agg(F.count("*").alias("total"))
    r = relations(log, by="event_id").groupBy("event_id").agg(F.collect_set(F.struct("activity", "object_type", "object_id")).alias("all"))
    r = r.select(F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["object_id"]))), ",").alias("objects"), F.inline("all"))
    # An event's objects travel with each of them; one shuffle by object then tells whether they ever differ.
    div = r.repartition("object_id").groupBy("activity", "object_type", "object_id").agg((F.min("objects") != F.max("objects")).alias("differ")).groupBy("activity", "object_type").agg(F.bool_or("differ").alias("divergent"))
    return conv.join(div, ["activity", "object_type"]).join(total, "activity").select("activity", "object_type", F.lit(True).alias("related"), "divergent", "convergent", (F.col("with_it") < F.col("total")).alias("deficient"))


def variable_arcs(log: OCEL, threshold: float = 0.95) -> DataFrame:
    """(activity, object_type, multiple, variable): the share of events with several objects, and whether it reaches the bound."""
    k = by_type(shapes(log, "activity"), "activity")
    share = ratio(F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)), F.sum("n"))
    return k.groupBy("activity", "object_type").agg(share.alias("multiple"), (F.max("k") > 1).alias("any"), (share >= threshold).alias("variable"))


def numeric_summary(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n, low, mid, high, mean, distinct) over equal-width bins; ``mid`` is the lower median."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    k = settled(v.groupBy("v").agg(F.count("*").alias("k")))
    half = F.broadcast(k.agg(F.expr("(sum(k) + 1) div 2").alias("half")))  # one row
    mid = numbered(k, "v", running="k").crossJoin(half).where("running >= half").agg(F.min("v").alias("mid"))
    s = k.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("distinct")).crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(v.agg(F.avg("v").alias("mean"))))
    b = v.crossJoin(F.broadcast(s)).withColumn("bin", F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), (F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)))  # one row of bounds
    return b.groupBy(F.coalesce("bin", F.lit(0)).cast("int").alias("bin"), "low", "mid", "high", "mean", "distinct").agg(F.count("*").alias("n"))


def lifecycle_tops(log: OCEL, activities: int = 5, variants: int = 4) -> DataFrame:
    """(object_type, kind, name, n, rank): the commonest activities and variants of each type."""
    r = relations(log).select("object_type", "event_id", "object_id", "activity").distinct()
    a = r.groupBy("object_type", F.col("activity").alias("name")).agg(F.count("*").alias("n"))
    v = life_paths(log).groupBy("object_type", F.col("path").alias("name")).agg(F.count("*").alias("n"))
    top = lambda df, kind, most: top_of_each(df, ["object_type"], most, F.desc("n"), "name", salt="name").select("object_type", F.lit(kind).alias("kind"), "name", "n", "rank")
    return top(a, "activity", activities).unionAll(top(v, "variant", variants))
