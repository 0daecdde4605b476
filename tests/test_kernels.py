"""Fixed examples and properties of the operators that SQL can't express."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.model import OCEL, EventLog
from tracewright.operators import conform, graph, miners, olap, profile, relations


def log_of(spark, *traces):
    rows = [(str(c), a, k, k) for c, t in enumerate(traces) for k, a in enumerate(t)]
    e = spark.createDataFrame(rows, "case_id string, activity string, t int, event_id int")
    return EventLog(e.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,t)")))


def test_directly_follows(spark):
    got = {(r.source, r.target): r.n for r in relations.directly_follows(log_of(spark, "AAB", "BB")).collect()}
    assert got == {("A", "A"): 1, ("A", "B"): 1, ("B", "B"): 1}


@pytest.mark.parametrize(
    "traces, tree",
    [
        ([], ("tau",)),
        (["a"], ("act", "a")),
        (["ab", "ab"], ("seq", ("act", "a"), ("act", "b"))),
        (["a", "b"], ("xor", ("act", "a"), ("act", "b"))),
        (["ab", "ba"], ("and", ("act", "a"), ("act", "b"))),
        (["a", "aba", "ababa"], ("loop", ("act", "a"), ("act", "b"))),
        (["", "a"], ("xor", ("tau",), ("act", "a"))),
        (["aa", "aaa"], ("loop", ("act", "a"), ("tau",))),
    ],
)
def test_inductive(traces, tree):
    assert miners.mine(Counter(map(tuple, traces))) == tree


@pytest.mark.parametrize("seed", range(15))
def test_mined_model_replays_its_own_play_out(spark, seed):
    net = miners.tree_to_net(miners.reduced(conform.random_tree(5, seed)))
    player, traces = conform.Player(net), Counter()
    runs = conform.play_out(spark, net, 20, seed, 12).where("ended and pos > 0").groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "activity"))).alias("x")).collect()
    for r in runs:
        traces[tuple(x.activity for x in r.x)] += 1
    for t in traces:
        assert player.replay(t)[2:] == (0, 0)
        assert player.align(t)[0] == 0
    mined = conform.Player(miners.tree_to_net(miners.mine(traces)))
    for t in traces:
        assert mined.align(t)[0] == 0, (t, miners.mine(traces))


def test_alignment_costs():
    player = conform.Player(miners.tree_to_net(("seq", ("act", "a"), ("act", "b"))))
    assert player.align(("a", "b"))[0] == 0
    assert player.align(("a", "x", "b")) == (1, 2, 1, 0)
    assert player.align(("a",)) == (1, 1, 0, 1)


def test_soundness(spark):
    good = miners.tree_to_net(("and", ("act", "a"), ("loop", ("act", "b"), ("act", "c"))))
    assert all(r.holds for r in conform.soundness(spark, good).collect())
    stuck = miners.Net([("a", (0,), (2,)), ("b", (2, 3), (1,))], (0,), (1,))
    assert not {r.property: r.holds for r in conform.soundness(spark, stuck).collect()}["option to complete"]


def test_reduction_keeps_the_language():
    net = miners.tree_to_net(("seq", ("act", "a"), ("and", ("act", "b"), ("act", "c")), ("loop", ("act", "d"), ("tau",))))
    small = conform.Player(conform.simplified(net))
    assert len(small.net.transitions) <= len(net.transitions)
    for t in ("abcd", "acbdd"):
        assert small.align(tuple(t))[0] == 0
    assert small.align(tuple("abd"))[0] == 1


def test_interpolated():
    assert [miners.interpolated(v, q) for v, q in (([1, 2, 3, 4], 0), ([1, 2, 3, 4], 1), ([1, 3], 0.5), ([], 0.4))] == [1, 4, 2, 0]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 7), (5, 5)], "a int, b int")
    assert {r.vertex: r.component for r in graph.connected_components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7, 9: 7}


def test_levels_and_colours(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (4, 5, "x"), (5, 6, "x")], "u int, v int, label string")
    got = {(r.source, r.vertex): r.distance for r in graph.levels(e, spark.createDataFrame([(1,)], "source int")).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2}
    nodes = spark.createDataFrame([(k, "n") for k in range(1, 7)], "vertex int, label string")
    c = {r.vertex: r.colour for r in graph.refine_colours(nodes, e).collect()}
    assert c[1] == c[4] and c[2] == c[5] and c[3] == c[6] and len(set(c.values())) == 3


@pytest.fixture(scope="module")
def ocel(spark):
    t = lambda d: F.to_timestamp_ntz(F.lit(d))
    events = spark.createDataFrame([("e1", "place order"), ("e2", "pay"), ("e3", "pay"), ("e4", "ship")], "event_id string, activity string").withColumn("ts", t("2025-01-01 00:00:00"))
    objects = spark.createDataFrame([("o1", "Order"), ("o2", "Order"), ("o3", "Order"), ("c1", "Customer"), ("s1", "Supplier")], "object_id string, object_type string")
    e2o = spark.createDataFrame([("e1", "o1", "places"), ("e2", "o1", "for"), ("e2", "c1", "by"), ("e3", "s1", "to"), ("e4", "o2", "ships")], "event_id string, object_id string, qualifier string")
    o2o = spark.createDataFrame([("o1", "c1", "belongs to")], "source_id string, target_id string, qualifier string")
    attr = spark.sql("""select * from values ('o1','priority','gold',cast(null as timestamp_ntz)), ('o2','priority','standard',null), ('o3','region','north',null),
        ('c1','priority','silver',timestamp_ntz'2025-01-01'), ('c1','priority','gold',timestamp_ntz'2025-06-01') as t(object_id, name, value, ts)""")
    return OCEL(events, objects, e2o, o2o, spark.createDataFrame([("e1", "channel", "web")], "event_id string, name string, value string"), attr)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_olap_laws(ocel):
    fine = olap.drill_down(ocel, "Order", "priority")
    assert dict(rows(fine.objects)) == {"o1": "(Order, gold)", "o2": "(Order, standard)", "o3": "Order", "c1": "Customer", "s1": "Supplier"}
    assert dict(rows(olap.drill_down(ocel, "Customer", "priority").objects))["c1"] == "(Customer, silver)"
    assert rows(olap.roll_up(fine, "Order").objects) == rows(ocel.objects)
    open_ = olap.unfold(ocel, "pay", "Customer")
    assert [r.event_id for r in open_.events.collect() if r.activity == "(pay, Customer)"] == ["e2"]
    assert rows(olap.unfold(ocel, "pay", "Customer", "for").events) == rows(ocel.events)
    assert rows(olap.fold(open_, "pay").events) == rows(ocel.events)


def test_next_after_by_queue(spark):
    import random

    rng = random.Random(5)
    ev = [(f"e{k:03}", rng.choice("ABC"), rng.randint(0, 60), f"o{rng.randint(1, 4)}") for k in range(120)]
    events = spark.createDataFrame(ev, "event_id string, activity string, t int, object_id string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,t)"))
    log = OCEL(events.select("event_id", "activity", "ts"), spark.createDataFrame([(f"o{k}", "T") for k in range(1, 5)], "object_id string, object_type string"), events.select("event_id", "object_id", F.lit("").alias("qualifier")))
    want = []
    for o in sorted({e[3] for e in ev}):
        queue, k = [], 0
        for _, a, t, _ in sorted((e for e in ev if e[3] == o and e[1] in "AB"), key=lambda e: (e[2], e[1] == "A", e[0])):
            if a == "A":
                queue.append(t)
            elif queue:
                k += 1
                want.append((o, k, (t - queue.pop(0)) * 1_000_000))
    assert rows(profile.next_after(log, "T", "A", "B")) == want


def test_catalog_round_trip(spark, ocel, tmp_path):
    from tracewright.sources import catalog

    catalog.write_ocel(ocel, str(tmp_path / "log"), {"plan": "x"})
    back = catalog.read_ocel(spark, str(tmp_path / "log"))
    assert rows(back.events) == rows(ocel.events) and rows(back.e2o) == rows(ocel.e2o)
    c = catalog.Catalog({"log": ocel})
    assert c.sql("select count(*) as n from {log.event_object}").first().n == 5
    with pytest.raises(ValueError):
        catalog.load_guarded(ocel, 2)
    catalog.export(ocel.objects, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5


def test_library_runs_without_the_subpackage():
    import re
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "tracewright").rglob("*.py"):
        if "llm" not in p.parts[len(root.parts) :]:
            assert not re.search(r"(from|import) \S*\bllm\b", p.read_text()), p
    assert subprocess.run([sys.executable, "-c", "import tracewright.plans as p; p.all_queries()"], cwd=root).returncode == 0
