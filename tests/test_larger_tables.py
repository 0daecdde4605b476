"""What showed on odd and on larger tables only: each test failed before its change."""

import datetime
import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F
from helpers import duck_rows, spark_rows
from test_rules_and_executions import graphs_by_search, members_by_search, ocel_of

from tracewright.model import OCEL, EventLog
from tracewright.operators import comparison, conform, executions, fields, graph, graph_repair, joins, profile, relations, repairs
from tracewright.plans import all_queries, all_sql


def test_page_rounds_halves_to_even(spark, duck, tmp_path):
    duck.execute(f"COPY (SELECT range AS o_orderkey, 'O' AS o_orderstatus, range + 0.5::DOUBLE AS o_totalprice FROM range(300)) TO '{tmp_path}/orders.parquet'")
    sql = all_sql()["a2_page"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet' orders")
    assert spark_rows(all_queries()["a2_page"](spark, str(tmp_path))) == duck_rows(duck, sql)


def test_variants_of_many_equal_events(spark):
    """Graphs whose events differ by their place only: trying the events of one label for each other takes all orders."""
    events, types = {}, {}
    for k in range(3):
        ring = [f"B{k}{i:02d}" for i in range(14)]
        types |= {f"A{k}": "A"} | dict.fromkeys(ring, "B")
        # 14 pairs of events, each pair with an object of its own; the last execution lacks one of the pairs' links.
        for i, b in enumerate(ring):
            events |= {f"e{k}{i:02d}a": (i, "x", [f"A{k}", b]), f"e{k}{i:02d}b": (50 + (i * 5 + k) % 14, "y", [f"A{k}", b if (k, i) != (2, 0) else ring[1]])}
    log = ocel_of(spark, events, types)
    members = executions.by_leading_type(log, "A")
    began = time.time()
    got = {r.execution: r.variant for r in executions.variants(log, members).collect()}
    graphs = graphs_by_search(events, types, members_by_search(events, types, "A"))
    key = lambda g: (len(g[1]), sorted(executions.refined([list(n) for n in g[0]], g[1]).values()))
    assert len(got) == 3 and time.time() - began < 120
    for x in got:
        for y in got:
            assert (got[x] == got[y]) == (key(graphs[x]) == key(graphs[y]))


def test_far_types_are_found_over_objects_that_lack_them(spark):
    """A chain of objects whose far end alone meets the last type, beside executions that meet all types at once."""
    types = {"A0": "A", "A1": "A", "A2": "A", "B0": "B", "B1": "B", "B2": "B", "C0": "C", "C1": "C", "A3": "A"}
    events = {"e0": (0, "x", ["A0", "B0"]), "e1": (1, "x", ["B0", "B1"]), "e2": (2, "x", ["B1", "B2"]), "e3": (3, "x", ["B2", "C0"]), "e4": (4, "x", ["A1", "B2", "C1"]), "e5": (5, "y", ["A2"])}
    log = ocel_of(spark, events, types)
    want = members_by_search(events, types, "A")
    assert {tuple(r) for r in executions.by_leading_type(log, "A").collect()} == want
    assert executions.surroundings(executions._pairs(log), spark.createDataFrame([("A2",)], "object_id string"), 3)[0].count() == 1


def test_candidates_are_listed_where_a_lost_object_is_one(spark):
    """e4 lost b1, which e1 has with a1; e5 lost b3, which nothing else has with a2, so its candidates aren't listed."""
    types = {"a1": "A", "a2": "A", "b1": "B", "b2": "B", "b3": "B"}
    events = {"e1": (0, "x", ["a1", "b1"]), "e2": (1, "x", ["a1", "b2"]), "e3": (2, "x", ["a2", "b2"]), "e4": (3, "x", ["a1", "b1"]), "e5": (4, "x", ["a2", "b3"])}
    log = ocel_of(spark, events, types)
    dropped = spark.createDataFrame([("e4", "b1"), ("e5", "b3")], "event_id string, object_id string")
    assert {tuple(r) for r in graph_repair.candidates(log, dropped, wanted=True).collect()} == {("e4", "b1"), ("e4", "b2")}
    assert {tuple(r) for r in conform.reconstruct(log, dropped).collect()} == {("e4", "b1", 1, 2), ("e5", "b3", None, None)}


@pytest.mark.parametrize("few", [10_000, 0])
def test_one_spelling_does_not_gather_its_rows(spark, monkeypatch, few):
    """Rows of one spelling: broadcast, or dealt out, and the same either way."""
    monkeypatch.setattr(repairs, "BROADCAST", few)
    rows = [(k, "by" if k % 3 else " BY") for k in range(3000)] + [(-1, None), (-2, "from")]
    out = repairs.one_spelling(spark.createDataFrame(rows, "k long, q string"), "q")
    assert {(r.k, r.q) for r in out.collect()} == {(k, q and q.strip().lower()) for k, q in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan if few else "_salt" in plan


def test_median_is_counted_not_sketched(spark):
    for rows, mid in (([5.0] * 7 + [1.0, 2.0, 9.0], 5.0), ([4.0, 1.0, 3.0, 2.0], 2.0), ([3.0, None, 1.0, 2.0], 2.0)):
        out = profile.numeric_summary(spark.createDataFrame([(x,) for x in rows], "x double"), "x")
        assert {(r.mid, r.distinct) for r in out.collect()} == {(mid, len({x for x in rows if x is not None}))}
        assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_similar_names_are_dealt_to_all_partitions(spark, data):
    out = all_queries()["e1_string_similarity"](spark, data)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffles(spark, result):
    """Shuffles by keys in the plan of a result where no table is small enough to broadcast."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = result()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    return plan.count("Exchange hashpartitioning(")


# Both tables of the join with the objects and of that with the events, then small tables by type.
@pytest.mark.parametrize(("name", "most"), [("f32_pair_totals", 6), ("f34_cardinality_evidence", 4), ("f23_type_signatures", 5), ("f39_interaction_patterns", 14)])
def test_events_meet_their_types_in_one_shuffle(spark, data, name, most):
    assert shuffles(spark, lambda: all_queries()[name](spark, data)) <= most


def test_totem_joins_lives_to_a_pair_once(spark, data):
    assert shuffles(spark, lambda: all_queries()["f37_totem_cardinalities"](spark, data)) <= 24


def test_types_of_odd_events(spark):
    """Events without relations, with unknown objects only and with repeated relations."""
    types = {"a1": "A", "a2": "A", "b1": "B"}
    log = ocel_of(spark, {"e1": (0, "x", ["a1", "a2", "b1"]), "e2": (1, "x", ["a1", "b1"]), "e3": (2, "y", []), "e4": (3, "y", ["a1"])}, types)
    log = log.with_(
        events=log.events.unionByName(spark.createDataFrame([("e5", "y")], "event_id string, activity string").withColumn("ts", F.lit(None).cast(log.events.schema["ts"].dataType))),
        e2o=log.e2o.unionAll(log.e2o.where("event_id = 'e2'")).unionAll(spark.createDataFrame([("e5", "gone", "q"), ("e4", "gone", "q"), ("gone", "b1", "q")], log.e2o.schema)),
    )
    assert {tuple(r) for r in profile.type_signatures(log).collect()} == {("x", "A+B", 2), ("y", "", 1), ("y", "A", 1)}
    assert {tuple(r) for r in profile.pair_totals(log).collect()} == {("A", "B", 2, 1, 0, 1, 0)}
    assert {tuple(r) for r in profile.cardinality_evidence(log).collect()} == {("A", "B", 3, 1, 1, 1, 75.0), ("B", "A", 2, 1, 2, 2, 100.0)}
    assert {tuple(r) for r in profile.repetition(log).collect()} == {("A", "x", 2, 1), ("A", "x", 1, 1), ("A", "y", 1, 1), ("B", "x", 2, 1)}
    assert {(r.activity, r.object_type, r.divergent, r.convergent, r.deficient) for r in profile.interaction_patterns(log).collect()} == {("x", "A", True, True, False), ("x", "B", True, False, False), ("y", "A", False, False, True)}


# Shuffles of the result; what is read twice is stored, so its own do not count.
@pytest.mark.parametrize(("name", "most"), [("f31_interaction_field", 20), ("v13_compare_fields", 5), ("f33_representatives", 5), ("f33_field_partition", 20)])
def test_contacts_are_found_once(spark, data, name, most):
    assert shuffles(spark, lambda: all_queries()[name](spark, data)) <= most


def task_log(spark, counts):
    """A log of resources' counts by activity."""
    rows = [(f"c{k}", a, r) for r, of in counts.items() for a, n in of.items() for k in range(n)]
    return EventLog(spark.createDataFrame(rows, "case_id string, activity string, resource string").select("*", F.lit(None).cast("timestamp").alias("ts"), F.monotonically_increasing_id().alias("event_id")))


def test_pairs_of_resources_are_not_shuffled(spark):
    """Pairs are made of two rows of profiles, at most one of which is shuffled."""
    counts = {"r1": {"a": 2, "b": 1}, "r2": {"a": 1, None: 1}, "r3": {"c": 3}, "r4": {"a": 4, "b": 2}, None: {"a": 9}}
    out = relations.similar_task(task_log(spark, counts))
    got = {(r.a, r.b): (r.pearson, r.cosine, r.euclid) for r in out.collect()}
    assert {k: v[1:] for k, v in got.items()} == {("r1", "r2"): (0.632455532, 0.366025404), ("r1", "r4"): (1.0, 0.309016994), ("r2", "r4"): (0.632455532, 0.210896722)}
    assert got["r1", "r4"][0] == 1.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize(("kinds", "clusters", "few"), [(60, 5, 1), (60, 5, 20), (60, 12, 1000), (3, 5, 2)])
def test_clusters_of_profiles_in_rounds(spark, kinds, clusters, few):
    """Joined in rounds, by blocks and after equal ones are put together: the same clusters as one pair after the other."""
    rng = random.Random(kinds)
    drawn = [[float(rng.randrange(1, 30)) for _ in range(4)] for _ in range(kinds)]
    rows = [(f"r{k:03d}", v, sum(v), sum(x * x for x in v)) for k, v in enumerate(drawn * 2)]
    p = spark.createDataFrame(rows, "resource string, profile array<double>, s double, q double")
    pairs = [(a[0], b[0], sum(x * y for x, y in zip(a[1], b[1])) / (a[3] * b[3]) ** 0.5) for a, b in itertools.combinations(rows, 2)]
    want = conform.agglomerate(spark, spark.createDataFrame(pairs, "a string, b string, similarity double"), clusters)
    got = conform.agglomerate_profiles(p, clusters, few=few, block=7)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_equal_parts_of_a_log_are_told_apart_at_once(spark):
    """Twelve equal chains under other ids, more than are singled out one by one; and logs that differ from the start."""
    def chains(ids):
        types = {ids(k, x): "A" for k in range(12) for x in "pqr"}
        return ocel_of(spark, {ids(k, "e" + e): (i, e, [ids(k, x) for x in e]) for k in range(12) for i, e in enumerate(("pq", "qr"))}, types)

    one, two = chains(lambda k, x: f"{x}{k:02d}"), chains(lambda k, x: f"{k * 7 % 12:02d}{x}")
    same, reason, pairs = comparison.equivalence(one, two, tries=1)
    assert same and reason == "a mapping" and pairs.count() == 60
    assert comparison.equivalence(one, two.with_(events=two.events.withColumn("activity", F.lit("x"))))[:2] == (False, "colours differ")


@pytest.mark.parametrize("gathered", [20_000, 3, 0])
def test_parts_of_a_graph_are_searched_alone(spark, monkeypatch, gathered):
    """Chains with cycles and a lone loop: few jobs where parts are small, and the same by joins where they are not."""
    monkeypatch.setattr(graph, "GATHERED", gathered)
    pairs = [(10 * k + i, 10 * k + i + 1) for k in range(3) for i in range(k + 2)] + [(1, 0), (22, 21), (99, 99), (50, 51), (51, 52), (52, 50), (52, 53)]
    e = spark.createDataFrame(pairs, "a long, b long")
    group = {r.vertex: r.grp for r in graph.groups_of(e.toDF("u", "v")).collect()}
    assert sorted(sorted(v for v in group if group[v] == x) for x in set(group.values())) == [[0, 1, 2], [10, 11, 12, 13], [20, 21, 22, 23, 24], [50, 51, 52, 53], [99]]
    want = {v: v for v in group} | {1: 0, 22: 21, 51: 50, 52: 50}
    assert {tuple(r) for r in graph.strong_components(e, "a", "b").collect()} == set(want.items())
    assert {tuple(r) for r in graph.condensed_paths(e, "a", "b").collect()} == {(0, 0), (2, 1), (10, 0), (11, 1), (12, 2), (13, 3), (20, 0), (21, 1), (23, 2), (24, 3), (50, 0), (53, 1)}


def test_lives_are_read_once(spark, data):
    """Variants are stored before they are mined and replayed, and lives need no pass of their own for repeated relations."""
    assert shuffles(spark, lambda: all_queries()["h6_object_replay"](spark, data)) == 0
    log = ocel_of(spark, {"e1": (0, "x", ["a1"]), "e2": (0, "y", ["a1"]), "e3": (1, "x", ["a1"])}, {"a1": "A"})
    out = profile.lives(log.with_(e2o=log.e2o.unionAll(log.e2o)))
    assert [tuple(r) for r in out.collect()] == [("A", "a1", ["x", "y", "x"])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


# Shuffles of the result: one type is joined by itself, and groups are counted once before the checks read their sizes.
@pytest.mark.parametrize(("name", "most"), [("b2_flatten_most_frequent", 4), ("h18_smells", 20)])
def test_types_and_sizes_are_counted_once(spark, data, name, most):
    assert shuffles(spark, lambda: all_queries()[name](spark, data)) <= most


def test_near_events_look_ahead_once(spark):
    """Pairs as by trying all, with ties, times before 1970, null times, double rows and several shared objects; found
    without copies of the events in neighbouring spans and without a second pass over the relations."""
    draw = random.Random(5)
    times = {f"e{k}": None if k % 17 == 0 else datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=draw.randrange(-60, 60)) for k in range(80)}
    links = [(e, f"{draw.choice('ABC')}{draw.randrange(4)}") for e in times for _ in range(3)]
    events = spark.createDataFrame([(e, "x", t) for e, t in times.items()], "event_id string, activity string, ts timestamp_ntz")
    objects = spark.createDataFrame(sorted({(o, o[0]) for _, o in links}), "object_id string, object_type string")
    log = OCEL(events, objects, spark.createDataFrame([(e, o, "q") for e, o in links], "event_id string, object_id string, qualifier string"))
    out = joins.near_in_time(log, ["A", "B"], 7 * 3_600_000_000)
    of = {e: {o for x, o in links if x == e and o[0] in "AB"} for e in times}
    near = lambda a, b: times[a] and times[b] and abs(times[a] - times[b]) <= datetime.timedelta(hours=7)
    want = {(a, b) for a in times for b in times if a < b and of[a] & of[b] and near(a, b)}
    assert want and sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 6 and "BroadcastExchange" not in plan


def test_faulty_relations_come_from_one_pass(spark, data):
    """Rows that are there twice are copied, not read a second time, and ids of lines pass no pattern: one scan of the
    lines, and one of the orders beside those of three small parts."""
    plan = all_queries()["b10_deduplicate"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey") == 1 and plan.count("Relation [o_orderkey") <= 5
    assert "StartsWith" in plan


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_profiles_count_relations_once(spark, monkeypatch, few):
    """As by hand with double relations, null ids and qualifiers, unknown ends, and events and objects that are there
    twice; of some names alone the same weights, and equal names never read the relations."""
    monkeypatch.setattr(comparison, "BROADCAST", few)
    draw = random.Random(2)
    events = [(f"e{k}", draw.choice("abc"), datetime.datetime(2020, 1, 1, k % 5)) for k in range(30)] + [("e1", "a", None), ("e2", "c", None), (None, "b", None)]
    objects = [(f"o{k}", draw.choice("PQR")) for k in range(12)] + [("o1", "P"), (None, "Q")]
    links = [(draw.choice(["e99", None] + [e for e, _, _ in events]), draw.choice(["o99", None] + [o for o, _ in objects]), draw.choice(["x", "y", "", None])) for _ in range(150)]
    e2o = spark.createDataFrame(links + links[:40], "event_id string, object_id string, qualifier string")
    log = OCEL(spark.createDataFrame(events, "event_id string, activity string, ts timestamp_ntz"), spark.createDataFrame(objects, "object_id string, object_type string"), e2o)
    pairs = {(e, o, q or "") for e, o, q in links}
    want = {}
    for kind, rows, at in (("activity", [(e, a) for e, a, _ in events], 0), ("object_type", objects, 1)):
        n = {name: sum(x == name for _, x in rows) for _, name in rows}
        want |= {(kind, name, "share"): n[name] / len(rows) for name in n}
        for p in pairs:
            for _, name in [r for r in rows if r[0] is not None and r[0] == p[at]]:
                want[kind, name, f"q:{p[2]}"] = want.get((kind, name, f"q:{p[2]}"), 0) + 1 / n[name]
        if kind == "activity":
            for _, name, ts in events:
                if ts:
                    want[kind, name, f"h:{ts.hour}"] = want.get((kind, name, f"h:{ts.hour}"), 0) + 1 / n[name]
    got = {tuple(r)[:3]: r.weight for r in comparison.profiles(log).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    only = spark.createDataFrame([("activity", "a"), ("object_type", "P")], "kind string, name string")
    some = {tuple(r)[:3]: r.weight for r in comparison.profiles(log, only=only).collect()}
    assert some == {k: v for k, v in got.items() if k[:2] in {("activity", "a"), ("object_type", "P")}}
    unread = log.with_(e2o=e2o.withColumn("qualifier", F.raise_error(F.lit("read"))))
    assert comparison.suspected_renames(unread, unread).count() == 0


def test_events_of_a_leading_type_need_no_members(spark):
    """Events belong to the leading objects in them, others by shares; the same as by all members, in few shuffles."""
    types = {"A0": "A", "A1": "A", "A2": "A", "B0": "B", "B1": "B", "C0": "C"}
    events = {"e0": (0, "x", ["A0", "B0"]), "e1": (1, "y", ["A0", "A1", "B0", "C0"]), "e2": (2, "x", ["B0", "B1"]), "e3": (2, "x", ["C0"]), "e4": (3, None, ["A0", "B0"]), "e5": (4, "z", [])}
    log = ocel_of(spark, events, types)
    members = executions.by_leading_type(log, "A")
    assert {tuple(r) for r in members.collect()} == members_by_search(events, types, "A")
    want = {tuple(r) for r in executions.events_of(log, members).collect()}
    assert {tuple(r) for r in executions.events_of(log, leading="A").collect()} == want == {("A0", "e0"), ("A0", "e1"), ("A1", "e1"), ("A0", "e4"), ("A0", "e2"), ("A0", "e3"), ("A1", "e3")} | want
    some = log.with_(events=log.events.where("event_id in ('e0', 'e1', 'e4')"))
    assert shuffles(spark, lambda: executions.events_of(some, leading="A")) <= 2
    for most in (None, 2):
        for one, two in zip(executions.graphs(log, members, most), executions.graphs(log, most_events=most, leading="A")):
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize(("exact", "gathered"), [(40, 0), (1, 2000), (40, 2000)])
def test_executions_are_drawn_alike(spark, monkeypatch, exact, gathered):
    """In a row, by joins and by colours of large ones: the same variants; one event's number is one, however often it
    is asked for."""
    monkeypatch.setattr(executions, "EXACT", exact)
    monkeypatch.setattr(executions, "GATHERED", gathered)
    types = {f"A{k}": "A" for k in range(6)} | {f"B{k}": "B" for k in range(6)} | {"C": "C", "A9": "A"}
    events = {f"e{k}{i}": (7 * i % 5 + k, "xyz"[i % 3], [f"A{k}", f"B{k if i % 2 else k // 2 * 2}"] + ["C"] * (k == 5 and i == 1)) for k in range(6) for i in range(4)}
    log = ocel_of(spark, events, types)
    got = {r.execution: (r.variant, r.n) for r in executions.variants(log, leading="A").collect()}
    graphs = graphs_by_search(events, types, members_by_search(events, types, "A"))
    same = lambda x, y: graphs[x] and executions.isomorphic(*graphs[x], *graphs[y])
    want = {x: [y for y in sorted(graphs) if same(x, y)] for x in graphs}
    assert got == {x: (ys[0], len(ys)) for x, ys in want.items()} and len({v for v, _ in got.values()}) > 2
    sizes = {(r.n_events, r.variants, r.executions) for r in executions.variant_sizes(log, "A").collect()}
    by_size = {}
    for x, (v, _) in got.items():
        by_size.setdefault(len(graphs[x][0]), []).append(v)
    assert sizes == {(n, len(set(vs)), len(vs)) for n, vs in by_size.items()}
    assert executions._events(log, True) is executions._events(log, True) and executions._pairs(log).inputFiles() == executions._pairs(log, True).inputFiles()


def test_rows_of_one_event_id_count_in_graphs(spark):
    """An id that two events have: one event of the execution, with both rows' places and counts in its graph."""
    log = ocel_of(spark, {"e1": (0, "x", ["A0", "B0"]), "e2": (1, "x", ["A0", "B0"])}, {"A0": "A", "B0": "B"})
    again = spark.createDataFrame([("e1", "x")], "event_id string, activity string").withColumn("ts", F.timestamp_seconds(F.lit(2)).cast("timestamp_ntz"))
    log = log.with_(events=log.events.unionByName(again))
    assert [tuple(r) for r in executions.events_of(log, leading="A").orderBy("event_id").collect()] == [("A0", "e1"), ("A0", "e2")]
    nodes, edges = executions.graphs(log, leading="A")
    assert {tuple(r) for r in nodes.collect()} == {("A0", "e1", "x/A=2,B=2"), ("A0", "e2", "x/A=1,B=1")}
    assert {tuple(r) for r in edges.collect()} == {("A0", "e1", "e2", "A=2,B=2"), ("A0", "e2", "e1", "A=2,B=2")}


def test_a_plan_stores_what_is_read_again(spark, monkeypatch):
    """Relations that nothing reads are not stored, others once, and all are as by each operation alone."""
    types = {"a1": "A", "a2": "A", "b1": "B"}
    log = ocel_of(spark, {"e1": (0, "x", ["a1", "b1"]), "e2": (0, "x", ["a1"]), "e3": (1, "y", []), "e4": (2, "y", ["a2"])}, types)
    more = spark.createDataFrame([("e1", "a1", " X"), ("e1", "a1", None), ("e9", "a1", "x"), ("e2", "gone", "x"), ("e2", "a1", "x"), ("e1", "b1", "x")], log.e2o.schema)
    attr = spark.createDataFrame([("e1", "k", "v"), ("e3", "k", "v")], "event_id string, name string, value string")
    log = log.with_(e2o=log.e2o.unionAll(more), event_attr=attr)
    plan = [("canonicaliseValues", {"scope": "qualifier"}), ("dropDanglingRelations", {}), ("deduplicateRelations", {}), ("dropEventsWithoutObjects", {}), ("dropImplausibleTimestamps", {"max_year": 2000}), ("disambiguateEventOrder", {"step": 1})]
    stored = []
    monkeypatch.setattr(repairs, "settled", lambda df, f=repairs.settled: stored.append(df.columns) or f(df))
    out = repairs.repaired(log, plan)
    assert len([c for c in stored if "_best" not in c]) == 2
    assert {tuple(r) for r in out.e2o.collect()} == {("e1", "a1", ""), ("e1", "a1", "x"), ("e1", "b1", ""), ("e1", "b1", "x"), ("e2", "a1", ""), ("e2", "a1", "x"), ("e4", "a2", "")}
    assert {r.event_id for r in out.events.collect()} == {"e1", "e2", "e4"}
    assert {r.event_id for r in out.event_attr.collect()} == {"e1"}


def test_gaps_are_ranked_in_one_shuffle_by_event(spark):
    """As by hand, with double relations, null ids and a lost relation that was not there; candidates meet what the event
    has and has lost in one shuffle by event."""
    draw = random.Random(3)
    links = [(f"e{k}", f"o{draw.randrange(8)}") for k in range(40) for _ in range(3)] + [("e1", "o1"), (None, "o2"), (None, "o3"), ("e0", None), ("e5", None)]
    e2o = spark.createDataFrame([(e, o, "q") for e, o in links + links[:30]], "event_id string, object_id string, qualifier string")
    log = OCEL(spark.createDataFrame([("e0", "x")], "event_id string, activity string"), spark.createDataFrame([("o0", "A")], "object_id string, object_type string"), e2o)
    gaps = sorted({(e, o) for e, o in links if e in {"e0", "e3", "e4", "e5", "e6"} and o and o < "o4"}) + [("e7", "o9")]
    kept = {x for x in links if x not in gaps}
    lost = {e for e, _ in gaps}
    train = {(e, o) for e, o in kept if e not in lost}
    n = {o: sum(x == o for _, x in train) for _, o in train}
    k = {(o, c): sum((e, o) in train and (e, c) in train for e in {e for e, _ in train if e}) for o in n for c in n if o and c and o != c}
    want = {}
    for e, gap in gaps:
        has = {o for x, o in kept if x == e}
        able = any(k.get((o, g), 0) for o in has for x, g in gaps if x == e)
        cand = {c for o in has for c in n if k.get((o, c), 0)} - has if able else set()
        score = {c: round(sum(math.log(k[o, c] / n[o] + 1e-9) - math.log(1e-9) for o in has if k.get((o, c), 0)) + len(has) * math.log(1e-9), 9) for c in cand}
        order = sorted(cand, key=lambda c: (-score[c], c))
        want[e, gap] = (order.index(gap) + 1, len(cand)) if gap in cand else (None, None)
    out = conform.reconstruct(log, spark.createDataFrame(gaps, "event_id string, object_id string"))
    assert {(r.event_id, r.object_id): (r["rank"], r.candidates) for r in out.collect()} == want and sum(v[0] is not None for v in want.values()) > 3
    # Ids of events are shuffled with the lost relations only, never with candidates.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [event_id" in line or "Window" in line and "event_id" in line for line in plan.splitlines())


def test_cohorts_are_made_in_one_pass(spark, data):
    """Both cohorts as by one after the other, from contacts that are found once and not stored; a ripple goes without
    making all relations distinct."""
    c = spark.createDataFrame([("e1", "a1", "b1", 0.1, 0.9), ("e2", "a1", "b2", 0.6, 0.2), ("e3", "a2", "b2", None, 0.8)], "event_id string, object_a string, object_b string, phase_a double, phase_b double")
    got = fields.cohorts(c, one=F.col("phase_a") < 0.5, two=F.col("phase_b") > 0.5).collect()
    assert {(r.kind, r.id) for r in got if r.one} == {tuple(r) for r in fields.cohort(c.where("phase_a < 0.5")).collect()} == {("event", "e1"), ("object", "a1"), ("object", "b1")}
    assert {(r.kind, r.id) for r in got if r.two} == {tuple(r) for r in fields.cohort(c.where("phase_b > 0.5")).collect()}
    plan = all_queries()["f33_cohort_algebra"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" in plan
    e2o = spark.createDataFrame([("e1", "a", "q"), ("e1", "a", "q"), ("e1", "b", "q"), ("e2", "b", "q")], "event_id string, object_id string, qualifier string")
    members = spark.createDataFrame([("object", "a")], "kind string, id string")
    out = fields.ripple(OCEL(e2o.select("event_id"), e2o.select("object_id"), e2o), members)
    assert [tuple(r) for r in out.collect()] == [(0, 1, 1), (1, 1, 1)]
