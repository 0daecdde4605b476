"""Log-scale tables behind model discovery: directly-follows, variants, footprints, dependencies, positions, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EventLog, in_order, micros, ratio
from .declare import per_activity
from .graph import settled


def directly_follows(log: EventLog, min_frequency: int = 1) -> DataFrame:
    """(source, target, n) of direct successions that are frequent enough."""
    e = log.events.select("activity", F.lead("activity").over(in_order("case_id")).alias("target")).where("target is not null")
    return e.groupBy(F.col("activity").alias("source"), "target").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency)


def ends(log: EventLog) -> DataFrame:
    """(activity, n, starts, ends)."""
    w = in_order("case_id")
    e = log.events.select("activity", F.lag("activity").over(w).alias("a"), F.lead("activity").over(w).alias("z"))
    return e.groupBy("activity").agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull()).alias("starts"), F.count_if(F.col("z").isNull()).alias("ends"))


def sequences(log: EventLog) -> DataFrame:
    """(case_id, seq): each case's activities in order; a case without events has an empty array."""
    order = F.struct(F.col("ts").isNull().alias("n"), "ts", "event_id", "activity")
    s = log.events.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["activity"]).alias("seq"))
    if log.cases is None:
        return s
    return log.cases.join(s, "case_id", "left").select("case_id", F.coalesce("seq", F.expr("cast(array() as array<string>)")).alias("seq"))


def variants(log: EventLog) -> DataFrame:
    """(seq, n): distinct activity sequences with their numbers of cases."""
    return sequences(log).groupBy("seq").agg(F.count("*").alias("n"))


def footprint(log: EventLog, min_frequency: int = 1) -> DataFrame:
    """(a, b, relation) over all ordered pairs: -> causal, <- inverse, || parallel, # none."""
    d = directly_follows(log, min_frequency).select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(True).alias("ab"))
    names = log.events.select(F.col("activity").alias("a")).distinct()
    grid = F.broadcast(names).crossJoin(names.select(F.col("a").alias("b")))  # pairs of activity names, model-sized
    x = grid.join(d, ["a", "b"], "left").join(d.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ab").alias("ba")), ["a", "b"], "left")
    kind = F.when(F.col("ab") & F.col("ba"), "||").when(F.col("ab"), "->").when(F.col("ba"), "<-").otherwise("#")
    return x.select("a", "b", kind.alias("relation"))


def dependencies(log: EventLog, min_frequency: int = 1) -> DataFrame:
    """(source, target, n, back, dependency): (ab - ba) / (ab + ba + 1), or n / (n + 1) for a loop of one."""
    d = directly_follows(log)
    r = d.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("n").alias("back"))
    x = d.join(r, ["source", "target"], "left").select("source", "target", "n", F.coalesce("back", F.lit(0)).alias("back"))
    dep = F.when(F.col("source") == F.col("target"), F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - F.col("back")) / (F.col("n") + F.col("back") + 1))
    return x.where(F.col("n") >= min_frequency).withColumn("dependency", dep)


def kept_dependencies(log: EventLog, threshold: float = 0.9, relative: float = 0.05) -> DataFrame:
    """Dependencies over the threshold, and each activity's best one in and out within ``relative`` of its best."""
    d = dependencies(log)
    out, into = (F.max(F.when(F.col("source") != F.col("target"), F.col("dependency"))).over(Window.partitionBy(k)) for k in ("source", "target"))
    x = d.withColumn("best_out", out).withColumn("best_in", into)
    best = (F.col("source") != F.col("target")) & ((F.col("dependency") == F.col("best_out")) | (F.col("dependency") == F.col("best_in")))
    near = (F.col("dependency") >= threshold) & ((F.col("source") == F.col("target")) | (F.col("best_out") - F.col("dependency") <= relative) | (F.col("best_in") - F.col("dependency") <= relative))
    return x.where(best | near).select("source", "target", "n", "dependency")


def self_distance(log: EventLog) -> DataFrame:
    """(activity, between): activities seen between two nearest occurrences at the activity's minimum distance."""
    e = log.events.select("case_id", "activity", F.row_number().over(in_order("case_id")).alias("pos"))
    gaps = e.withColumn("prior", F.lag("pos").over(Window.partitionBy("case_id", "activity").orderBy("pos"))).where("prior is not null").withColumn("gap", F.col("pos") - F.col("prior"))
    least = gaps.groupBy("activity").agg(F.min("gap").alias("gap"))
    inner = gaps.join(least, ["activity", "gap"]).where("gap > 1").select("case_id", "activity", F.explode(F.sequence(F.col("prior") + 1, F.col("pos") - 1)).alias("pos"))
    return inner.join(e.select("case_id", "pos", F.col("activity").alias("between")), ["case_id", "pos"]).select("activity", "between").distinct()


def lookback(log: EventLog, most: int = 5) -> DataFrame:
    """(source, target, distance, n): successions over up to ``most`` steps; each distance is a lag of one window."""
    w = in_order("case_id")
    lagged = log.events.select("activity", *[F.lag("activity", k).over(w).alias(f"l{k}") for k in range(1, most + 1)])
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("distance"), F.col(f"l{k}").alias("source")) for k in range(1, most + 1)])).alias("s")
    return lagged.select("activity", steps).where("s.source is not null").groupBy(F.col("s.source").alias("source"), F.col("activity").alias("target"), F.col("s.distance").alias("distance")).agg(F.count("*").alias("n"))


def fuzzy_significance(log: EventLog, most: int = 5, radical: float = 2.7) -> DataFrame:
    """(source, target, n, frequency): attenuated counts over look-back distances, scaled to a maximum of 1.

    A succession over k steps weighs radical ** -(k - 1).
    """
    x = lookback(log, most).groupBy("source", "target").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.lit(radical), 1 - F.col("distance"))).alias("w"))
    return x.select("source", "target", "n", F.round(F.col("w") / F.max("w").over(Window.partitionBy(F.lit(1))), 6).alias("frequency"))  # one row a pair of activities


def proximity(log: EventLog) -> DataFrame:
    """(source, target, proximity): mean of 1 / ms between direct successors, 1 for none apart."""
    w = in_order("case_id")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    e = log.events.withColumn("t", t).select(F.lag("activity").over(w).alias("source"), F.col("activity").alias("target"), (F.col("t") - F.lag("t").over(w)).alias("gap")).where("source is not null")
    return e.groupBy("source", "target").agg(F.round(F.avg(F.when(F.col("gap") > 0, 1.0 / F.col("gap")).otherwise(1.0)), 12).alias("proximity"))


def positions(log: EventLog) -> DataFrame:
    """(case_id, activity, k, first, last) of each activity in a case, places counted from 1."""
    e = log.events.select("case_id", "activity", F.row_number().over(in_order("case_id")).alias("pos"))
    return e.groupBy("case_id", "activity").agg(F.count("*").alias("k"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def rule_counts(log: EventLog) -> DataFrame:
    """For every ordered pair of activities: activations and violations of response, precedence, co-existence,
    chain response and responded existence, from present pairs and totals (absent pairs need no row).

    Response a -> b is violated by each a after the last b; precedence by each b before the first a.
    """
    p = per_activity(log)
    total = p.groupBy("activity").agg(F.sum("k").alias("n"), F.count("*").alias("cases"))
    mine = p.select("case_id", F.col("activity").alias("a"), F.col("at").alias("at_a"), "k")
    other = p.select("case_id", F.col("activity").alias("b"), F.col("at").alias("at_b"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    where = lambda c: F.sum(F.size(F.filter("at_a", c)))
    sat = mine.join(other, "case_id").where("a <> b").groupBy("a", "b").agg(
        where(lambda t: t < F.col("b_last")).alias("response_ok"), where(lambda t: t > F.col("b_first")).alias("precedence_ok"),
        F.sum("k").alias("existence_ok"), F.sum(F.size(F.array_intersect(F.transform("at_a", lambda t: t + 1), "at_b"))).alias("chain_ok"), F.count("*").alias("both"),
    )
    names = total.select(F.col("activity").alias("a"), "n", "cases")
    grid = names.crossJoin(F.broadcast(total.select(F.col("activity").alias("b"), F.col("cases").alias("b_cases")))).where("a <> b")  # pairs of names
    x = grid.join(sat, ["a", "b"], "left")
    miss = lambda c: (F.col("n") - F.coalesce(c, F.lit(0)))
    return x.select("a", "b", F.col("n").alias("activations"), miss("response_ok").alias("response"), miss("precedence_ok").alias("preceded"), miss("existence_ok").alias("responded"), miss("chain_ok").alias("chain"), (F.col("cases") + F.col("b_cases") - 2 * F.coalesce("both", F.lit(0))).alias("coexistence"))


def declare_rules(log: EventLog, min_confidence: float = 0.9) -> DataFrame:
    """(template, a, b, activations, violations) of binary rules with enough confidence."""
    r = rule_counts(log)
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("template"), F.col(c).alias("violations")) for t, c in (("response", "response"), ("precedence", "preceded"), ("responded existence", "responded"), ("chain response", "chain"))])).alias("x")
    x = r.select("a", "b", "activations", kinds).select("x.template", "a", "b", "activations", "x.violations")
    return x.where(1 - F.col("violations") / F.col("activations") >= min_confidence)


def unary_rules(log: EventLog) -> DataFrame:
    """(activity, existence, exactly_once, init, last): cases in which each unary rule holds."""
    w = in_order("case_id")
    e = log.events.select("case_id", "activity", F.lag("activity").over(w).isNull().alias("i"), F.lead("activity").over(w).isNull().alias("l"))
    k = e.groupBy("case_id", "activity").agg(F.count("*").alias("k"), F.bool_or("i").alias("i"), F.bool_or("l").alias("l"))
    return k.groupBy("activity").agg(F.count("*").alias("existence"), F.count_if(F.col("k") == 1).alias("exactly_once"), F.count_if("i").alias("init"), F.count_if("l").alias("last"))


def skeleton(log: EventLog, noise: float = 0.0) -> DataFrame:
    """(relation, a, b) of the log skeleton: always-after, always-before, never-together, equivalence, directly-follows."""
    r = rule_counts(log)
    d = directly_follows(log).select(F.col("source").alias("a"), F.col("target").alias("b"))
    least = F.col("activations") * noise
    p = positions(log)
    cases = p.groupBy("activity").agg(F.count("*").alias("cases"))
    q = p.select("case_id", F.col("activity").alias("b"), F.col("k").alias("kb"))
    same = p.join(q, "case_id").where("activity <> b").groupBy(F.col("activity").alias("a"), "b").agg(F.count("*").alias("both"), F.count_if(F.col("k") == F.col("kb")).alias("same"))
    two = same.join(cases.select(F.col("activity").alias("a"), F.col("cases").alias("ca")), "a").join(cases.select(F.col("activity").alias("b"), F.col("cases").alias("cb")), "b")
    equal = two.where((F.col("same") == F.col("ca")) & (F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b"))).select(F.lit("equivalence").alias("relation"), "a", "b")
    met = same.select("a", "b")
    tag = lambda name, df: df.select(F.lit(name).alias("relation"), "a", "b")
    never = r.select("a", "b").where("a < b").join(met, ["a", "b"], "left_anti")
    return tag("always-after", r.where(F.col("response") <= least)).unionAll(tag("always-before", r.where(F.col("preceded") <= least))).unionAll(tag("never-together", never)).unionAll(equal).unionAll(tag("directly-follows", d))


def handover(log: EventLog, most: int = 1, beta: float = 0.5, once: bool = True, self_loops: bool = False) -> DataFrame:
    """(source, target, weight): handovers of work over up to ``most`` steps, a step k weighing beta ** (k - 1).

    With ``once`` a case counts its best weight only. Events without a resource are bridged.
    """
    w = in_order("case_id")
    e = log.events.where("resource is not null").select("case_id", "resource", *[F.lag("resource", k).over(w).alias(f"l{k}") for k in range(1, most + 1)])
    s = F.explode(F.array(*[F.struct(F.lit(float(beta ** (k - 1))).alias("w"), F.col(f"l{k}").alias("source")) for k in range(1, most + 1)])).alias("s")
    x = e.select("case_id", F.col("resource").alias("target"), s).select("case_id", F.col("s.source").alias("source"), "target", F.col("s.w").alias("w")).where("source is not null")
    if not self_loops:
        x = x.where("source <> target")
    per_case = x.groupBy("case_id", "source", "target").agg((F.max("w") if once else F.sum("w")).alias("w"))
    return per_case.groupBy("source", "target").agg(F.round(F.sum("w"), 9).alias("weight"))


def working_together(log: EventLog) -> DataFrame:
    """(a, b, cases, jaccard): resources in the same cases, a < b."""
    c = log.events.where("resource is not null").select("case_id", "resource").distinct()
    n = c.groupBy("resource").agg(F.count("*").alias("n"))
    both = c.select("case_id", F.col("resource").alias("a")).join(c.select("case_id", F.col("resource").alias("b")), "case_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("cases"))
    x = both.join(n.select(F.col("resource").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("resource").alias("b"), F.col("n").alias("nb")), "b")
    return x.select("a", "b", "cases", ratio(F.col("cases"), F.col("na") + F.col("nb") - F.col("cases")).alias("jaccard"))


def subcontracting(log: EventLog) -> DataFrame:
    """(source, target, n): work that goes to another resource and straight back."""
    w = in_order("case_id")
    e = log.events.where("resource is not null").select(F.col("resource").alias("back"), F.lag("resource", 1).over(w).alias("target"), F.lag("resource", 2).over(w).alias("source"))
    return e.where("source = back and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def task_profiles(log: EventLog) -> DataFrame:
    """(resource, profile, s, q): events by activity, in the order of the activities' names, their sum and sum of squares.

    Events without an activity count in the sums only.
    """
    k = settled(log.events.where("resource is not null").groupBy("resource", "activity").agg(F.count("*").cast("double").alias("x")))
    names = sorted(r[0] for r in k.where("activity is not null").select("activity").distinct().collect())  # names of activities
    counts = F.map_from_entries(F.filter(F.collect_list(F.struct("activity", "x")), lambda r: r["activity"].isNotNull()))
    p = k.groupBy("resource").agg(counts.alias("counts"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    profile = F.transform(F.array(*map(F.lit, names)).cast("array<string>"), lambda a: F.coalesce(F.try_element_at("counts", a), F.lit(0.0)))
    return settled(p.select("resource", profile.alias("profile"), "s", "q"))


def similar_task(log: EventLog) -> DataFrame:
    """(a, b, pearson, cosine, euclid) of resources' activity profiles, a < b; null where undefined.

    Each pair of resources with a common activity is a row, so the result grows with the square of their number. A pair
    is made from two rows of profiles and never shuffled; a task holds its resources and passes the others by.
    """
    p = task_profiles(log)
    m = (p.select(F.size("profile")).first() or (0,))[0]
    one, two = (p.select(F.col("resource").alias(x), F.col("profile").alias(f"p{x}"), F.col("s").alias(f"s{x}"), F.col("q").alias(f"q{x}")) for x in "ab")
    parts = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if m <= 64:
        xy = reduce(Column.__add__, [F.col("pa")[k] * F.col("pb")[k] for k in range(m)], F.lit(0.0))
    else:
        xy = F.aggregate(F.zip_with("pa", "pb", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    t = one.repartition(parts).crossJoin(two).where("a < b").withColumn("xy", xy).where("xy > 0").withColumn("m", F.lit(float(m)))
    va, vb = F.expr("m * qa - sa * sa"), F.expr("m * qb - sb * sb")
    pearson = F.when((va > 0) & (vb > 0), F.expr("m * xy - sa * sb") / F.sqrt(va * vb))
    return t.select("a", "b", F.round(pearson, 9).alias("pearson"), F.round(F.expr("xy / sqrt(qa * qb)"), 9).alias("cosine"), F.round(F.expr("1 / (1 + sqrt(greatest(qa + qb - 2 * xy, 0)))"), 9).alias("euclid"))


def resource_profiles(log: EventLog) -> DataFrame:
    """(resource, events, activities, cases, active_days, spread, top_share); spread is the entropy of activities over its maximum."""
    e = log.events.where("resource is not null")
    k = e.groupBy("resource", "activity").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("resource")))
    s = k.groupBy("resource").agg(F.round(F.when(F.count("*") > 1, F.sum(-F.col("p") * F.ln("p")) / F.ln(F.count("*"))).otherwise(0.0), 9).alias("spread"), F.max("p").alias("top_share"))
    b = e.groupBy("resource").agg(F.count("*").alias("events"), F.countDistinct("activity").alias("activities"), F.countDistinct("case_id").alias("cases"), F.countDistinct(F.date_trunc("day", "ts")).alias("active_days"))
    return b.join(s, "resource")


def busy_time(items: DataFrame) -> DataFrame:
    """(resource, busy_us, overlap_us): time covered by one and by two or more work items (resource, start, end in us)."""
    points = items.select("resource", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("s")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("s")))).alias("x")).groupBy("resource", F.col("x.t").alias("t")).agg(F.sum("x.s").alias("s"))
    w = Window.partitionBy("resource").orderBy("t")
    x = points.select("resource", F.sum("s").over(w).alias("depth"), (F.lead("t").over(w) - F.col("t")).alias("len"))
    return x.groupBy("resource").agg(F.sum(F.when(F.col("depth") >= 1, F.col("len")).otherwise(0)).alias("busy_us"), F.sum(F.when(F.col("depth") >= 2, F.col("len")).otherwise(0)).alias("overlap_us"))


def workload(items: DataFrame) -> DataFrame:
    """(resource, item, concurrent): items of the resource that are open when an item starts, itself included."""
    return _loads(items).select("resource", "item", "concurrent")


def _loads(items: DataFrame) -> DataFrame:
    """``workload`` with the items' ``start`` and ``end``."""
    rows = items.select("resource", "item", "start", "end", F.col("start").alias("t"), F.lit(1).alias("s")).unionAll(items.select("resource", "item", "start", "end", F.col("end"), F.lit(-1)))
    upto = Window.partitionBy("resource").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("open", F.sum("s").over(upto)).where("s = 1").select("resource", "item", "start", "end", F.col("open").cast("long").alias("concurrent"))


def batches(log: EventLog, gap_us: int) -> DataFrame:
    """(resource, activity, size): runs of one activity by a resource, each event within ``gap_us`` of the one before."""
    w = Window.partitionBy("resource").orderBy("ts", "event_id")
    e = log.events.where("resource is not null").withColumn("t", micros("ts"))
    new = F.coalesce((F.lag("activity").over(w) != F.col("activity")) | (F.col("t") - F.lag("t").over(w) > gap_us), F.lit(True))
    r = e.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w))
    return r.groupBy("resource", "run", "activity").agg(F.count("*").alias("size")).where("size > 1").groupBy("resource", "activity", "size").agg(F.count("*").alias("runs"))


def calendar(log: EventLog, unit: str = "month") -> DataFrame:
    """(bucket, resource, n) of events by calendar unit."""
    return log.events.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket"), "resource").agg(F.count("*").alias("n"))


def cumulative_prune(edges: DataFrame, weight: str, share: float, *ties: str) -> DataFrame:
    """The strongest edges whose weights reach ``share`` of the total; a table of pairs of names or resources."""
    w = Window.orderBy(F.desc(weight), *ties)
    before = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    total = F.broadcast(edges.agg(F.sum(weight).alias("_total")))
    return edges.withColumn("_before", before).crossJoin(total).where(F.col("_before") < share * F.col("_total")).select(*edges.columns)


def top_arcs(edges: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` heaviest edges of each type, ties by names."""
    return edges.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "source", "target"))).where(F.col("k") <= most).drop("k")


def best_edges(edges: DataFrame, weight: str) -> DataFrame:
    """Each node's strongest edge in and out."""
    rank = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy(F.desc(weight), o))
    return edges.withColumn("a", rank("source", "target")).withColumn("b", rank("target", "source")).where("a = 1 or b = 1").select(*edges.columns)


def concurrency_filter(edges: DataFrame, preserve: float = 0.6, ratio_: float = 0.7) -> DataFrame:
    """Two-way edges by relative importance: both stay over ``preserve``; else the weaker goes if it is much weaker, else both go."""
    x = edges.where("source <> target")
    out, into = F.sum("n").over(Window.partitionBy("source")), F.sum("n").over(Window.partitionBy("target"))
    rel = x.select("source", "target", "n", (F.col("n") / out + F.col("n") / into).alias("r"))
    back = rel.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("r").alias("rb"))
    y = rel.join(back, ["source", "target"], "left")
    keep = F.col("rb").isNull() | ((F.col("r") > preserve) & (F.col("rb") > preserve)) | ((F.least("r", "rb") / F.greatest("r", "rb") < ratio_) & (F.col("r") > F.col("rb")))
    return y.where(keep).select("source", "target", "n")


def reassignment(log: EventLog, once: bool = True) -> DataFrame:
    """(source, target, n): the same activity done twice in a case, by another resource later; a case counts once or each pair.

    Counted from running totals by resource, so that a case's pairs of events are never listed.
    """
    e = log.events.where("resource is not null").select("case_id", "activity", "resource", F.row_number().over(in_order("case_id")).alias("pos"))
    span = e.groupBy("case_id", "activity", "resource").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    if once:
        x, y = (span.select("case_id", "activity", F.col("resource").alias(n), F.col(c)) for n, c in (("source", "first"), ("target", "last")))
        p = x.join(y, ["case_id", "activity"]).where("source <> target and first < last").select("case_id", "source", "target").distinct()
        return p.groupBy("source", "target").agg(F.count("*").alias("n"))
    others = span.select("case_id", "activity", F.col("resource").alias("source"))
    rows = e.join(others, ["case_id", "activity"])
    before = Window.partitionBy("case_id", "activity", "source").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    c = rows.withColumn("c", F.coalesce(F.sum(F.when(F.col("resource") == F.col("source"), 1).otherwise(0)).over(before), F.lit(0)))
    return c.where("resource <> source and c > 0").groupBy("source", F.col("resource").alias("target")).agg(F.sum("c").alias("n"))


def shares(edges: DataFrame, weight: str) -> DataFrame:
    """Edges with the ``share`` of their weight in all of it; a table of pairs of resources."""
    total = F.broadcast(edges.agg(F.sum(weight).alias("_total")))  # one row
    return edges.crossJoin(total).withColumn("share", F.round(F.col(weight) / F.col("_total"), 9)).drop("_total")


def collaborators(log: EventLog) -> DataFrame:
    """(resource, collaborators): how many others took part in a resource's cases."""
    c = log.events.where("resource is not null").select("case_id", "resource").distinct()
    met = c.join(c.select("case_id", F.col("resource").alias("other")), "case_id").where("resource <> other").select("resource", "other").distinct()
    n = met.groupBy("resource").agg(F.count("*").alias("collaborators"))
    return c.select("resource").distinct().join(n, "resource", "left").fillna(0, ["collaborators"])


def top_activities_of(log: EventLog, most: int = 64) -> DataFrame:
    """(resource, activity, n, rank): each resource's commonest activities."""
    k = log.events.where("resource is not null").groupBy("resource", "activity").agg(F.count("*").alias("n"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("resource").orderBy(F.desc("n"), "activity"))).where(F.col("rank") <= most)


def load_correlation(items: DataFrame, least: int = 3) -> DataFrame:
    """(resource, items, correlation): Pearson's between items open at an item's start and its duration in seconds;
    null below ``least`` items or where one of them never varies."""
    load = _loads(items).withColumn("secs", (F.col("end") - F.col("start")) / 1e6)
    ok = (F.count("*") >= least) & (F.min("concurrent") < F.max("concurrent")) & (F.min("secs") < F.max("secs"))
    return load.groupBy("resource").agg(F.count("*").alias("items"), F.when(ok, F.round(F.corr(F.col("concurrent").cast("double"), "secs"), 9)).alias("correlation"))


# The widths of a timeline's buckets in microseconds, and the most buckets it may have.
WIDTHS = (("hour", 3_600_000_000), ("day", 86_400_000_000), ("week", 604_800_000_000), ("month", 2_592_000_000_000))
MOST_BUCKETS = 400


def timeline(log: EventLog, unit: str = "day") -> DataFrame:
    """(width, bucket, resource, n): events by buckets of ``unit``, widened until the span has at most MOST_BUCKETS."""
    e = log.events.where("resource is not null and ts is not null").withColumn("us", micros("ts"))
    span = F.greatest(F.max("us") - F.min("us"), F.lit(1))
    at = [n for n, _ in WIDTHS].index(unit)
    width = F.lit(WIDTHS[-1][1])
    for _, w in reversed(WIDTHS[at:-1]):
        width = F.when(F.ceil(span / w) <= MOST_BUCKETS, w).otherwise(width)
    chosen = F.broadcast(e.agg(width.alias("width")))  # one row
    name = F.create_map(*[F.lit(x) for n, w in WIDTHS for x in (w, n)])
    return e.crossJoin(chosen).groupBy(name[F.col("width")].alias("width"), F.floor(F.col("us") / F.col("width")).alias("bucket"), "resource").agg(F.count("*").alias("n"))


def allowed_counts(log: EventLog) -> DataFrame:
    """(activity, k, cases): how often an activity occurs in a case, none included."""
    k = positions(log).groupBy("activity", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("cases"))
    total = F.broadcast(log.all_cases().agg(F.countDistinct("case_id").alias("total")))  # one row
    none = k.groupBy("activity").agg(F.sum("cases").alias("with")).crossJoin(total).select("activity", F.lit(0).cast("long").alias("k"), (F.col("total") - F.col("with")).alias("cases"))
    return k.unionAll(none.where("cases > 0"))


def share_prune(edges: DataFrame, weight: str, share: float, *ties: str) -> DataFrame:
    """Like ``cumulative_prune``; where a weight is negative, the top ``share`` of edges by rank instead."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(weight), *ties)  # a table of pairs of names or resources
    total = F.broadcast(edges.agg(F.sum(weight).alias("_total"), F.min(weight).alias("_least"), F.count("*").alias("_rows")))
    x = edges.withColumn("_before", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)).withColumn("_rank", F.row_number().over(w)).crossJoin(total)
    keep = F.when(F.col("_least") < 0, F.col("_rank") <= F.round(F.lit(share) * F.col("_rows"))).otherwise(F.col("_before") < share * F.col("_total"))
    return x.where(keep).select(*edges.columns)
