"""Renames, equivalence, directed components, closure, longest paths and the refined order, by brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewright.model import OCEL
from tracewright.operators import comparison as cp, graph, views


def ocel(spark, events, objects, e2o, o2o=()):
    return OCEL(
        spark.createDataFrame(events, "event_id string, activity string, ts long").withColumn("ts", F.timestamp_seconds("ts")), spark.createDataFrame(objects, "object_id string, object_type string"),
        spark.createDataFrame([(*p, "q") for p in e2o], "event_id string, object_id string, qualifier string"), spark.createDataFrame([(*p, "q") for p in o2o], "source_id string, target_id string, qualifier string"),
    )


def small(seed, ids=lambda x: x, activity=lambda x: x, kind=lambda x: x):
    rng = random.Random(seed)
    events = [(ids(f"e{i}"), activity(rng.choice(["receive order", "ship goods", "pay"])), 1000 * (i // 2)) for i in range(24)]
    objects = [(ids(f"o{i}"), kind("Order" if i % 2 else "Box")) for i in range(8)]
    pairs = sorted({(ids(f"e{i}"), ids(f"o{rng.randrange(8)}")) for i in range(24) for _ in range(2)})
    return events, objects, pairs, [(ids("o1"), ids("o2")), (ids("o3"), ids("o2"))]


def test_verdicts(spark):
    one = ocel(spark, *small(1))
    assert tuple(cp.verdict(one, one).first())[:3] == ("strict-equal", True, True)
    other = ocel(spark, *small(1, ids=lambda x: "z" + x[::-1]))
    assert cp.verdict(one, other).first().verdict == "structurally-equivalent"
    named = ocel(spark, *small(1, ids=lambda x: "z" + x[::-1], activity=lambda x: x.upper() + "!"))
    assert cp.verdict(one, named).first().verdict == "different"
    assert cp.verdict(one, named, opaque=True).first().verdict == "equivalent-up-to-rename"
    events, objects, pairs, o2o = small(1)
    assert cp.verdict(one, ocel(spark, events, objects, pairs[1:] + [(pairs[0][0], next(o for o, _ in objects if (pairs[0][0], o) not in pairs))], o2o)).first().verdict == "different"
    assert cp.verdict(one, ocel(spark, events[1:], objects, pairs, o2o)).first().verdict == "different"


def test_mapping_renames_are_told(spark):
    one, two = ocel(spark, *small(2)), ocel(spark, *small(2, ids=lambda x: x + "'", activity=lambda x: {"pay": "settle"}.get(x, x)))
    same, _, pairs = cp.equivalence(one, two, opaque=True)
    assert same
    names = {(r.one, r.two) for r in cp.renamed_by(pairs, one, two).collect()}
    assert ("pay", "settle") in names and all(a == b or (a, b) == ("pay", "settle") for a, b in names)


def ring(spark, sizes):
    objects, links, k = [], [], 0
    for n in sizes:
        for i in range(n):
            objects.append((f"o{k + i}", "X"))
            links.append((f"o{k + i}", f"o{k + (i + 1) % n}"))
        k += n
    return ocel(spark, [("e", "a", 0)], objects, [], links)


def test_what_colours_alone_cannot_tell(spark):
    """One ring of six and two of three have the same colours; singling out a vertex tells that no mapping was found."""
    assert cp.equivalence(ring(spark, [6]), ring(spark, [6]))[0] is True
    assert cp.equivalence(ring(spark, [6]), ring(spark, [3, 3]))[0] is None
    assert cp.equivalence(ring(spark, [3, 3]), ring(spark, [3, 3]))[0] is True


def test_planted_renames(spark):
    one = ocel(spark, *small(3))
    two = ocel(spark, *small(3, activity=lambda x: {"receive order": "Receive_Order", "pay": "zzz"}.get(x, x), kind=lambda x: {"Box": "Boxes"}.get(x, x)))
    rows = {(r.kind, r.one): r for r in cp.suspected_renames(one, two).collect()}
    assert set(rows) == {("activity", "receive order"), ("activity", "pay"), ("object_type", "Box")}
    assert rows["activity", "receive order"].two == "Receive_Order" and rows["activity", "receive order"].normalized_equal
    assert rows["activity", "pay"].two == "zzz" and rows["activity", "pay"].jaro_winkler == 0 and rows["activity", "pay"].profile == 1
    assert cp.suspected_renames(one, one).count() == 0


def test_one_partner_each(spark):
    def log(names):
        return ocel(spark, [(f"e{i}", n, i) for i, n in enumerate(names)], [("o", "X")], [(f"e{i}", "o") for i in range(len(names))])

    rows = cp.suspected_renames(log(["alpha one", "alpha two", "beta"]), log(["alpha onE", "alpha 2", "alpha two."]), profile=2.0).collect()
    assert {(r.one, r.two) for r in rows} == {("alpha one", "alpha onE"), ("alpha two", "alpha two.")}


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    closed = {}
    for v in {x for e in edges for x in e}:
        seen, todo = set(), list(out.get(v, ()))
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += out.get(w, ())
        closed[v] = seen
    return closed


@pytest.mark.parametrize("seed, n, m", [(1, 12, 14), (2, 30, 45), (3, 8, 40), (4, 40, 30)])
def test_directed_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(100 + k, 101 + k) for k in range(9)] + [(109, 100)] if seed == 2 else [])
    df = spark.createDataFrame(edges, "a long, b long")
    closed = reach(edges)
    assert {tuple(r) for r in graph.closure(df, "a", "b").collect()} == {(a, b) for a, s in closed.items() for b in s}
    want = {v: min([w for w in closed if w in closed[v] and v in closed[w]] + [v]) for v in closed}
    rows = [tuple(r) for r in graph.strong_components(df, "a", "b").collect()]
    assert len(rows) == len(want) and dict(rows) == want
    acyclic = {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    assert {tuple(r) for r in graph.condensed(df, "a", "b").collect()} == acyclic
    length = {}
    for _ in range(len(closed)):
        length = {v: max([length.get(a, 0) + 1 for a, b in acyclic if b == v], default=0) for v in {x for e in acyclic for x in e}}
    assert dict(map(tuple, graph.longest_paths(spark.createDataFrame(sorted(acyclic), "u long, v long"), "u", "v").collect())) == length


def test_cycles_and_empty_graphs(spark):
    with pytest.raises(ValueError):
        graph.longest_paths(spark.createDataFrame([(1, 2), (2, 1)], "u long, v long"), "u", "v")
    none = spark.createDataFrame([], "u long, v long")
    assert graph.closure(none, "u", "v").count() == graph.strong_components(none, "u", "v").count() == graph.longest_paths(none, "u", "v").count() == 0
    assert dict(map(tuple, graph.strong_components(spark.createDataFrame([(3, 3), (4, None)], "u long, v long"), "u", "v").collect())) == {3: 3}


def test_overlaps_and_refined_order(spark):
    rng = random.Random(7)
    items = [(f"c{rng.randrange(4)}", rng.choice("abcd"), (s := rng.randrange(20)), s + rng.randrange(6)) for _ in range(80)]
    df = spark.createDataFrame(items, "case_id string, activity string, start long, end long")
    want = {}
    for (c, a, s, e), (d, b, t, f) in itertools.combinations(items, 2):
        if c == d and a != b and max(s, t) < min(e, f):
            want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 1
    for at_once in (64, 2, 1):
        assert {(r.a, r.b): r.n for r in views.lifecycle_overlap(df, at_once).collect()} == want
    events = [(c, a, p, t, f"{i:03d}{p}") for i, (c, a, s, e) in enumerate(items) for p, t in (("start", s), ("complete", e), ("enqueue", s))]
    follows = {}
    for case in {c for c, *_ in events}:
        ended = None
        for _, a, p, t, i in sorted((x for x in events if x[0] == case), key=lambda x: (x[3], x[4])):
            if p == "start" and ended not in (None, a):
                follows[ended, a] = follows.get((ended, a), 0) + 1
            ended = a if p == "complete" else ended
    got = views.refined_follows(spark.createDataFrame(events, "case_id string, activity string, phase string, t long, event_id string"))
    assert {(r.source, r.target): r.n for r in got.collect()} == follows
    assert views.lifecycle_overlap(df.limit(0)).count() == 0
