"""Projection, refinement and repair of object-centric and traditional logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import OCEL, EventLog, in_order
from .ordered import numbered


def relations(log: OCEL, by: str = "object_id") -> DataFrame:
    """Event-object pairs with the event's activity and time and the object's type.

    Rows of one object lie together, or of one event if ``by`` is that: grouping by it next shuffles nothing.
    """
    if by == "event_id":
        r = log.e2o.join(log.objects, "object_id").join(log.events, "event_id")
    else:
        r = log.e2o.join(log.events, "event_id").join(log.objects, "object_id")
    return r.select("event_id", "activity", "ts", "object_id", "object_type", "qualifier")


def shapes(log: OCEL, *keys: str) -> DataFrame:
    """(keys, shape, n): events by how many different objects of each type they have, as a sorted array of (object_type,
    k); ``keys`` are columns of the events. What holds of an event's types follows from these few rows."""
    k = relations(log, by="event_id").select("event_id", *keys, "object_id", "object_type").distinct().groupBy("event_id", *keys, "object_type").agg(F.count("*").alias("k"))
    one = k.groupBy("event_id", *keys).agg(F.array_sort(F.collect_list(F.struct("object_type", "k"))).alias("shape"))
    return one.groupBy(*keys, "shape").agg(F.count("*").alias("n"))


def by_type(shape: DataFrame, *keys: str) -> DataFrame:
    """(keys, object_type, k, n) of ``shapes``: a row for each shape and type."""
    return shape.select(*keys, "n", F.inline("shape"))


def by_types(shape: DataFrame, one: str, two: str) -> DataFrame:
    """(one, n_one, two, n_two, n) of ``shapes``: a row for each shape and ordered pair of its types."""
    x = shape.select("n", "shape", F.inline("shape").alias(one, f"n_{one}"))
    return x.select("n", one, f"n_{one}", F.inline("shape").alias(two, f"n_{two}")).where(F.col(one) != F.col(two))


def flatten(log: OCEL, object_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """One case for each object of the types, in the order given: (cases, events).

    ``trace_idx`` counts the cases from 0, by the type's position, then the object.
    """
    place = F.array_position(F.array(*map(F.lit, object_types)), F.col("object_type"))
    chosen = log.objects.where(F.col("object_type").isin(object_types)).withColumn("_place", place)
    cases = numbered(chosen, "_place", "object_id").select((F.col("rank") - 1).alias("trace_idx"), "object_id", "object_type")
    pairs = log.e2o.select("event_id", "object_id").distinct()
    events = pairs.join(cases, "object_id").join(log.events, "event_id").select("trace_idx", "object_type", "object_id", "event_id", "activity", "ts")
    return cases, events


def as_log(events: DataFrame) -> EventLog:
    """Flattened events as a traditional log."""
    return EventLog(events.select(F.col("object_id").alias("case_id"), "activity", "ts", "event_id", "object_type"))


def most_frequent_type(log: OCEL) -> DataFrame:
    """The type of most event-object relations, ties by name: one row (object_type)."""
    k = log.e2o.join(log.events.select("event_id"), "event_id").groupBy("object_id").agg(F.count("*").alias("k"))
    n = k.join(log.objects, "object_id").groupBy("object_type").agg(F.sum("k").alias("n"))
    return n.orderBy(F.desc("n"), "object_type").limit(1).select("object_type")


def flatten_one(log: OCEL, object_type: str | None = None) -> DataFrame:
    """Events of the objects of one type, by default of the most frequent one."""
    if object_type is None:
        object_type = (most_frequent_type(log).first() or (None,))[0]  # one name, so that other types' rows aren't joined
    return relations(log, by="event_id").where(F.col("object_type") == object_type)


def drill_down(log: OCEL, object_type: str, attribute: str) -> OCEL:
    """Type T becomes (T, value) by the object's earliest non-empty value; objects without one keep T."""
    w = Window.partitionBy("object_id").orderBy(F.col("ts").asc_nulls_first(), "value")
    first = log.object_attr.where((F.col("name") == attribute) & (F.coalesce("value", F.lit("")) != "")).withColumn("k", F.row_number().over(w)).where("k = 1").select("object_id", "value")
    fine = F.concat(F.lit("("), "object_type", F.lit(", "), "value", F.lit(")"))
    objects = log.objects.join(first, "object_id", "left").select("object_id", F.when((F.col("object_type") == object_type) & F.col("value").isNotNull(), fine).otherwise(F.col("object_type")).alias("object_type"))
    return log.with_(objects=objects)


def in_parentheses(column: str, name: str):
    """Whether a name is (name, ...)."""
    return F.startswith(F.col(column), F.lit(f"({name}, ")) & F.endswith(F.col(column), F.lit(")"))


def roll_up(log: OCEL, object_type: str) -> OCEL:
    """Types (T, ...) become T again."""
    return log.with_(objects=log.objects.withColumn("object_type", F.when(in_parentheses("object_type", object_type), F.lit(object_type)).otherwise(F.col("object_type"))))


def unfold(log: OCEL, activity: str, object_type: str, qualifier: str = "") -> OCEL:
    """Activity a becomes (a, T) in events that are related to an object of type T (by that qualifier, if any)."""
    hit = log.e2o.join(log.objects.where(F.col("object_type") == object_type), "object_id", "left_semi")
    if qualifier:
        hit = hit.where(F.col("qualifier") == qualifier)
    hit = hit.select("event_id").distinct().withColumn("hit", F.lit(True))
    new = F.when((F.col("activity") == activity) & F.col("hit"), F.lit(f"({activity}, {object_type})")).otherwise(F.col("activity"))
    return log.with_(events=log.events.join(hit, "event_id", "left").select("event_id", new.alias("activity"), "ts"))


def fold(log: OCEL, activity: str) -> OCEL:
    """Activities (a, ...) become a again."""
    return log.with_(events=log.events.withColumn("activity", F.when(in_parentheses("activity", activity), F.lit(activity)).otherwise(F.col("activity"))))


def bucket(*parts: str, salt: str):
    """A reproducible number below a million for a key."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(salt))), 1, 8), 16, 10).cast("long") % 1_000_000).cast("long")


def ablate(log: OCEL, test_fraction: float = 0.3, drop_fraction: float = 0.3, seed: int = 42, protocol: str = "proportional") -> DataFrame:
    """Relations to drop, (event_id, object_id): of each test event the k objects of the lowest hashes.

    k is floor(fraction x objects), one at least and all but one at most; one for ``singleTarget``.
    """
    pairs = log.e2o.select("event_id", "object_id").distinct()
    test = pairs.where(bucket("event_id", salt=f"t{seed}") < int(test_fraction * 1_000_000))
    w, whole = Window.partitionBy("event_id"), F.count("*").over(Window.partitionBy("event_id"))
    ranked = test.select("event_id", "object_id", whole.alias("n"), F.row_number().over(w.orderBy(bucket("event_id", "object_id", salt=f"d{seed}"), "object_id")).alias("k"))
    quota = F.lit(1) if protocol == "singleTarget" else F.greatest(F.lit(1), F.floor(F.col("n") * drop_fraction))
    return ranked.where((F.col("n") > 1) & (F.col("k") <= F.least(quota, F.col("n") - 1))).select("event_id", "object_id")


def without(log: OCEL, dropped: DataFrame) -> OCEL:
    return log.with_(e2o=log.e2o.join(dropped, ["event_id", "object_id"], "left_anti"))


def top_activities(log: EventLog, most: int) -> EventLog:
    """Only events of the ``most`` most frequent activities, ties by name; dropped events bridge their neighbours."""
    top = log.events.groupBy("activity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "activity").limit(most)
    return EventLog(log.events.join(F.broadcast(top.select("activity")), "activity", "left_semi"), log.cases)


def top_resources(log: EventLog, most: int = 200, min_events: int = 1) -> EventLog:
    """Only events of the ``most`` busiest resources with at least ``min_events``, ties by id."""
    top = log.events.where("resource is not null").groupBy("resource").agg(F.count("*").alias("n")).where(F.col("n") >= min_events).orderBy(F.desc("n"), "resource").limit(most)
    return EventLog(log.events.join(top.select("resource"), "resource", "left_semi"), log.cases)


def classify_lifecycle(events: DataFrame, separator: str = "\u001f") -> DataFrame:
    """Split activity + separator + lifecycle into ``base`` and ``phase`` (start, complete or enqueue; default complete)."""
    parts = F.split("activity", separator)
    phase = F.lower(F.coalesce(F.get(parts, 1), F.lit("complete")))
    return events.withColumn("base", F.get(parts, 0)).withColumn("phase", F.when(phase.isin("start", "assign", "resume"), "start").when(phase.isin("schedule", "enqueue"), "enqueue").otherwise("complete"))


def repair_events(log: OCEL, step: int = 1) -> DataFrame:
    """Events with ties in time put apart by ``step`` microseconds in order of id."""
    from .repairs import apart

    return apart(log.events.select("event_id", "activity", "ts"), step)


def repair_relations(log: OCEL) -> DataFrame:
    """Relations without exact duplicates, dangling ends and null keys."""
    r = log.e2o.where("event_id is not null and object_id is not null").withColumn("qualifier", F.coalesce("qualifier", F.lit(""))).dropDuplicates(["event_id", "object_id", "qualifier"])
    return r.join(log.events, "event_id", "left_semi").join(log.objects, "object_id", "left_semi")


def drop_orphans(log: OCEL) -> OCEL:
    """Without events that have no object and objects that have no event."""
    return log.with_(events=log.events.join(log.e2o, "event_id", "left_semi"), objects=log.objects.join(log.e2o, "object_id", "left_semi"))


def canonical_values(attrs: DataFrame, sentinels: tuple[str, ...] = ("", "n/a", "na", "null", "none", "unknown", "-", "?")) -> DataFrame:
    """Values trimmed and lower-cased; sentinels become null."""
    v = F.lower(F.trim("value"))
    return attrs.withColumn("value", F.when(v.isin(*sentinels), F.lit(None)).otherwise(v))


def pseudonymise(attrs: DataFrame, names: list[str], salt: str) -> DataFrame:
    """Values of the named attributes replaced by salted SHA-256 digests."""
    return attrs.withColumn("value", F.when(F.col("name").isin(names) & F.col("value").isNotNull(), F.sha2(F.concat(F.lit(salt), "value"), 256)).otherwise(F.col("value")))


def in_range(events: DataFrame, first: str | None = None, last: str | None = None, activities: list[str] | None = None) -> DataFrame:
    """Events between two times, both included; a bare date as the last time means the end of that day."""
    if first:
        events = events.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        whole_day = len(last) == 10
        bound = F.lit(f"{last} 23:59:59.999999" if whole_day else last).cast("timestamp_ntz")
        events = events.where(F.col("ts") <= bound)
    return events.where(F.col("activity").isin(activities)) if activities else events


def search_objects(log: OCEL, text: str, most: int = 8) -> DataFrame:
    """Objects whose id contains the text in either case, first by id."""
    return log.objects.where(F.contains(F.lower("object_id"), F.lit(text.lower()))).orderBy("object_id").limit(most)


def pairs_in_order(log: EventLog) -> DataFrame:
    """Events with their successor in the case: case_id, activity, next_activity, ts, next_ts, pos."""
    w = in_order("case_id")
    return log.events.select("case_id", "activity", "ts", "event_id", F.lead("activity").over(w).alias("next_activity"), F.lead("ts").over(w).alias("next_ts"), F.row_number().over(w).alias("pos"))
