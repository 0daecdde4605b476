"""Filters, rankings and comparisons that the interactive views apply to discovered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import OCEL, EventLog, in_order, micros
from .olap import relations
from .graph import settled
from .ordered import numbered
from .profile import lives
from .relations import best_edges, cumulative_prune, sequences, variants


def lift_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between clusters (node, cluster), keeping the strongest of each pair; edges inside a cluster go."""
    a = clusters.select(F.col("node").alias("source"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("node").alias("target"), F.col("cluster").alias("cb"))
    x = edges.join(a, "source", "left").join(b, "target", "left").select(F.coalesce("ca", "source").alias("source"), F.coalesce("cb", "target").alias("target"), "n")
    return x.where("source <> target").groupBy("source", "target").agg(F.max("n").alias("n"))


def station_edges(edges: DataFrame, coverage: float = 0.88) -> DataFrame:
    """The strongest edges up to a share of all weight, and every node's best edge in and out."""
    keys = ("source", "target")
    return cumulative_prune(edges, "n", coverage, *keys).unionByName(best_edges(edges, "n")).distinct()


def variant_list(log: EventLog, coverage: float = 0.8) -> DataFrame:
    """(rank, seq, n, cumulative): the commonest variants that reach a share of the cases."""
    v = settled(variants(log).select("seq", "n"))
    total = F.broadcast(v.agg(F.sum("n").alias("total")))  # one row
    x = numbered(v, F.desc("n"), "seq", running="n").crossJoin(total)
    return x.where(F.col("running") - F.col("n") < coverage * F.col("total")).select("rank", "seq", "n", (F.col("running") / F.col("total")).alias("cumulative"))


def ranked_variants(log: OCEL, object_type: str) -> DataFrame:
    """(seq, n, rank, running): the variants of a type, the commonest first, and the objects up to each."""
    return numbered(lives(log).where(F.col("object_type") == object_type).groupBy("seq").agg(F.count("*").alias("n")), F.desc("n"), "seq", running="n")


def edges_of(ranked: DataFrame) -> DataFrame:
    """(source, target, min_variant, n) of ranked variants."""
    s = F.col("seq")
    e = ranked.select("rank", "n", F.explode(F.arrays_zip(F.slice(s, 1, F.size(s) - 1).alias("a"), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("b"))).alias("e"))
    return e.groupBy(F.col("e.a").alias("source"), F.col("e.b").alias("target")).agg(F.min("rank").cast("long").alias("min_variant"), F.sum("n").alias("n"))


def variant_edges(log: OCEL, object_type: str) -> DataFrame:
    """(source, target, min_variant, n): directly-follows edges of a type with the rank of the commonest variant that has them."""
    return edges_of(ranked_variants(log, object_type))


def variant_prefixes(log: OCEL, object_type: str) -> DataFrame:
    """(rank, n, cumulative, new_activities, activities, new_edges, edges): what showing the commonest variants up to each
    rank covers: its share of the objects, and how many activities and edges there are in all of them and in none before."""
    v = settled(ranked_variants(log, object_type))
    total = F.broadcast(v.agg(F.sum("n").alias("total")))  # one row
    first = v.select("rank", F.explode(F.array_distinct("seq")).alias("activity")).groupBy("activity").agg(F.min("rank").alias("rank"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    new = first.select("rank", one.alias("a"), none.alias("e")).union(edges_of(v).select("min_variant", none, one))
    new = new.groupBy("rank").agg(F.sum("a").alias("new_activities"), F.sum("e").alias("new_edges"))
    x = v.join(new, "rank", "left").fillna(0, ["new_activities", "new_edges"]).crossJoin(total)
    x = x.select("rank", "n", (F.col("running") / F.col("total")).alias("cumulative"), "new_activities", "new_edges")
    for what in ("activities", "edges"):
        x = numbered(x, "rank", running=f"new_{what}").withColumnRenamed("running", what)
    return x.select("rank", "n", "cumulative", "new_activities", "activities", "new_edges", "edges")


def compare_fields(one: DataFrame, two: DataFrame) -> DataFrame:
    """(bin_x, bin_y, mass_one, mass_two, delta) of two interaction fields."""
    a, b = (f.select("bin_x", "bin_y", F.col("mass").alias(n)) for f, n in ((one, "mass_one"), (two, "mass_two")))
    x = a.join(b, ["bin_x", "bin_y"], "full")
    m, n = F.coalesce("mass_one", F.lit(0.0)), F.coalesce("mass_two", F.lit(0.0))
    return x.select("bin_x", "bin_y", m.alias("mass_one"), n.alias("mass_two"), F.round(n - m, 9).alias("delta"))


def elevation(df: DataFrame, metric: str, power: float = 0.65) -> DataFrame:
    """A metric scaled to its maximum, raised to a power; for tables of activities."""
    top = F.broadcast(df.agg(F.max(metric).alias("_top")))  # one row
    return df.crossJoin(top).withColumn("elevation", F.round(F.power(F.try_divide(F.col(metric).cast("double"), F.col("_top").cast("double")), F.lit(power)), 9)).drop("_top")


def involvement(log: EventLog, edges: DataFrame) -> DataFrame:
    """(resource, events, cases, activities, sent, received) with the weights of the network's edges."""
    b = log.events.where("resource is not null").groupBy("resource").agg(F.count("*").alias("events"), F.countDistinct("case_id").alias("cases"), F.countDistinct("activity").alias("activities"))
    out = edges.groupBy(F.col("source").alias("resource")).agg(F.round(F.sum("weight"), 6).alias("sent"))
    into = edges.groupBy(F.col("target").alias("resource")).agg(F.round(F.sum("weight"), 6).alias("received"))
    return b.join(out, "resource", "left").join(into, "resource", "left").na.fill(0.0, ["sent", "received"])


def work_items(events: DataFrame) -> DataFrame:
    """(case_id, activity, k, start, end): starts and completes of a case's activity matched first in, first out.

    ``events`` has case_id, activity, phase, t and event_id. A complete that finds no open start is left out.
    """
    key = ["case_id", "activity"]
    w = Window.partitionBy(*key).orderBy("t", F.col("phase") == "complete", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = events.withColumn("s", F.sum(F.when(F.col("phase") == "start", 1).otherwise(0)).over(upto)).withColumn("c", F.sum(F.when(F.col("phase") == "complete", 1).otherwise(0)).over(upto))
    x = x.withColumn("low", F.least(F.lit(0), F.min(F.col("s") - F.col("c")).over(upto))).withColumn("prior", F.coalesce(F.lag("low").over(w), F.lit(0)))
    starts = x.where("phase = 'start'").select(*key, F.col("s").alias("k"), F.col("t").alias("start"))
    ends = x.where("phase = 'complete' and low = prior").select(*key, (F.col("c") + F.col("low")).alias("k"), F.col("t").alias("end"))
    return starts.join(ends, [*key, "k"]).select(*key, F.col("k").cast("long").alias("k"), "start", "end")


def lifecycle_overlap(items: DataFrame, at_once: int = 64) -> DataFrame:
    """(a, b, n): pairs of work items of one case that overlap, by activities a < b; items have case_id, activity, start, end.

    A running count for each activity of the items that are open when another starts, ends before starts; the names are
    taken ``at_once`` in a pass over the sorted events, and no pairs are made.
    """
    # Numbered, so that items that start together are in the same order in every pass.
    real = settled(items.where("start < end").select("case_id", "activity", "start", "end", F.monotonically_increasing_id().alias("nth")))
    events = real.select("case_id", "activity", F.col("start").alias("t"), F.lit(1).alias("step"), "nth").unionAll(real.select("case_id", "activity", "end", F.lit(-1), "nth"))
    names = [r.activity for r in events.select("activity").distinct().orderBy("activity").collect()]  # names
    before = Window.partitionBy("case_id").orderBy("t", "step", "nth").rowsBetween(Window.unboundedPreceding, -1)
    out = None
    for k in range(0, len(names), at_once) or [0]:
        some = names[k : k + at_once]
        counts = [F.coalesce(F.sum(F.when(F.col("activity") == n, F.col("step")).otherwise(0)).over(before), F.lit(0)).alias(f"n{i}") for i, n in enumerate(some)]
        starts = events.select("case_id", "activity", "step", *counts).where("step = 1")
        open_ = F.explode(F.array(*[F.struct(F.lit(n).alias("other"), F.col(f"n{i}").alias("n")) for i, n in enumerate(some)])) if some else F.explode(F.expr("cast(array() as array<struct<other: string, n: bigint>>)"))
        x = starts.select("activity", open_.alias("o")).where("o.n > 0 and o.other <> activity")
        x = x.groupBy(F.least("activity", "o.other").alias("a"), F.greatest("activity", "o.other").alias("b")).agg(F.sum("o.n").alias("n"))
        out = x if out is None else out.unionAll(x)
    return out.groupBy("a", "b").agg(F.sum("n").alias("n"))


def refined_follows(events: DataFrame) -> DataFrame:
    """(source, target, n): starts by the latest end before them in their case, whatever else is open then; an activity
    that follows its own end is left out. ``events`` has case_id, activity, phase, t and event_id, in order by t (nulls
    last) and event_id."""
    before = Window.partitionBy("case_id").orderBy(F.col("t").asc_nulls_last(), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.last(F.when(F.col("phase") == "complete", F.col("activity")), ignorenulls=True).over(before)
    x = events.select("phase", "activity", ended.alias("source")).where("phase = 'start' and source is not null and source <> activity")
    return x.groupBy("source", F.col("activity").alias("target")).agg(F.count("*").alias("n"))


def concurrent_pairs(events: DataFrame, items: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """(a, b, ab, ba, overlap, concurrent): pairs of activities a < b that follow each other both ways in the refined
    order, with the overlaps of their work items; concurrent where they overlap at all or the two directions differ by
    less than ``epsilon`` of their sum."""
    f = refined_follows(events)
    ab = f.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("n").alias("ab"))
    ba = f.select(F.col("target").alias("a"), F.col("source").alias("b"), F.col("n").alias("ba"))
    x = ab.join(ba, ["a", "b"], "full").where("a < b").join(lifecycle_overlap(items).withColumnRenamed("n", "overlap"), ["a", "b"], "full")
    x = x.select("a", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ab", "ba", "overlap")])
    even = (F.col("ab") > 0) & (F.col("ba") > 0) & (F.abs(F.col("ab") - F.col("ba")) < epsilon * (F.col("ab") + F.col("ba")))
    return x.withColumn("concurrent", (F.col("overlap") > 0) | even)


def replay_sample(log: EventLog, cases: int) -> DataFrame:
    """(case_id, pos, activity, t) of the first cases by id."""
    first = log.events.select("case_id").distinct().orderBy("case_id").limit(cases)
    w = in_order("case_id")
    return log.events.join(first, "case_id", "left_semi").select("case_id", F.row_number().over(w).cast("long").alias("pos"), "activity", micros("ts").alias("t"))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(value, id): ids 0, 1, ... of a column's distinct values in order, ranked inside value ranges and put end to end."""
    return numbered(df.select(F.col(column).alias("value")).distinct(), "value").select("value", (F.col("rank") - 1).alias("id"))


def footprint_similarity(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: edges of two directly-follows tables as sets, and their Jaccard similarity."""
    keys = ["source", "target"]
    x = one.select(*keys).distinct().withColumn("s", F.lit(1)).unionAll(two.select(*keys).distinct().withColumn("s", F.lit(2))).groupBy(*keys).agg(F.sum("s").alias("s"))
    return x.agg(F.count_if(F.col("s") != 2).alias("one"), F.count_if(F.col("s") != 1).alias("two"), F.count_if(F.col("s") == 3).alias("both"), (F.count_if(F.col("s") == 3) / F.count("*")).alias("jaccard"))


def context(log: OCEL, object_type: str, activity: str, most: int = 6) -> DataFrame:
    """(other, n): the commonest activities of the objects that an activity's events relate to, besides it."""
    r = relations(log).where(F.col("object_type") == object_type)
    mine = r.where(F.col("activity") == activity).select("object_id").distinct()
    return r.join(mine, "object_id", "left_semi").where(F.col("activity") != activity).groupBy(F.col("activity").alias("other")).agg(F.countDistinct("event_id").alias("n")).orderBy(F.desc("n"), "other").limit(most)


def lifetimes(log: OCEL) -> DataFrame:
    """(object_type, bin, n): objects by the whole part of the base-2 logarithm of their life in hours plus one."""
    l = relations(log).groupBy("object_type", "object_id").agg(((micros(F.max("ts")) - micros(F.min("ts"))) / 3_600_000_000).alias("h"))
    return l.groupBy("object_type", F.floor(F.log2(F.col("h") + 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def readiness(log: OCEL, object_type: str) -> DataFrame:
    """(object_id, ready_us): when the last of an object's inputs has happened."""
    r = relations(log).where(F.col("object_type") == object_type)
    return r.groupBy("object_id").agg(micros(F.max("ts")).alias("ready_us"))


def route_counts(log: EventLog, length: int) -> DataFrame:
    """(route, n): runs of ``length`` consecutive activities in all cases."""
    s = sequences(log)
    windows = F.explode(F.transform(F.sequence(F.lit(1), F.size("seq") - length + 1), lambda i: F.array_join(F.slice("seq", i, length), ">")))
    return s.where(F.size("seq") >= length).select(windows.alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def series(edges: DataFrame, metric: str, *keys: str) -> DataFrame:
    """(rank, keys, metric, scaled): cells of a metric's matrix from the greatest, scaled to it; a table of pairs of names."""
    top = F.broadcast(edges.agg(F.max(metric).alias("_top")))  # one row
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(metric), *keys)).cast("long")
    return edges.crossJoin(top).select(rank.alias("rank"), *keys, metric, F.round(F.try_divide(F.col(metric).cast("double"), F.col("_top").cast("double")), 9).alias("scaled"))


def sorted_profiles(profiles: DataFrame, metric: str, name: str) -> DataFrame:
    """Profiles with their ``rank`` by a metric from the greatest, unknown values last, ties by name."""
    return numbered(profiles, F.col(metric).desc_nulls_last(), name)
