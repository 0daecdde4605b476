"""Rules, executions, ranks and timings against brute force."""

import itertools
import random

import pytest
from helpers import spark_rows
from pyspark.sql import functions as F

from tracewright.model import OCEL, EventLog
from tracewright.operators import conform, declare, executions, ordered, relations
from tracewright.plans import all_queries, all_sql
from tracewright.sources import catalog


def log_of(spark, traces):
    rows = [(f"c{i}", a, k, k) for i, t in enumerate(traces) for k, a in enumerate(t)]
    events = spark.createDataFrame(rows, "case_id string, activity string, t int, event_id int").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    return EventLog(events, spark.createDataFrame([(f"c{i}",) for i in range(len(traces))], "case_id string"))


def keeps(template, t, a, b):
    """Whether a trace keeps a rule, word for word."""
    at = lambda x: [i for i, y in enumerate(t) if y == x]
    nxt = lambda i: t[i + 1] if i + 1 < len(t) else None
    pre = lambda i: t[i - 1] if i else None
    rules = {
        "existence": lambda: a in t, "absence": lambda: a not in t, "exactlyOne": lambda: t.count(a) == 1, "init": lambda: t[:1] == a, "end": lambda: t[-1:] == a,
        "respondedExistence": lambda: a not in t or b in t,
        "response": lambda: all(b in t[i + 1 :] for i in at(a)), "precedence": lambda: all(a in t[:i] for i in at(b)),
        "altResponse": lambda: all(b in t[i + 1 :] and a not in t[i + 1 : i + 1 + t[i + 1 :].index(b)] for i in at(a)),
        "altPrecedence": lambda: all(a in t[:i] and b not in t[t[:i].rindex(a) + 1 : i] for i in at(b)),
        "chainResponse": lambda: all(nxt(i) == b for i in at(a)), "chainPrecedence": lambda: all(pre(i) == a for i in at(b)),
        "notCoExistence": lambda: not (a in t and b in t), "notSuccession": lambda: not any(b in t[i + 1 :] for i in at(a)), "notChainSuccession": lambda: all(nxt(i) != b for i in at(a)),
    }
    for name, (one, two) in {"succession": ("response", "precedence"), "altSuccession": ("altResponse", "altPrecedence"), "chainSuccession": ("chainResponse", "chainPrecedence")}.items():
        rules[name] = lambda one=one, two=two: keeps(one, t, a, b) and keeps(two, t, a, b)
    return rules[template]()


def test_rules_by_brute_force(spark):
    rng = random.Random(1)
    traces = ["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(60)] + [""]
    log = log_of(spark, traces)
    got = {(r.template, r.a, r.b): (r.activations, r.violations) for r in declare.assess(log).collect()}
    active = {"a": lambda t, a, b: a in t, "b": lambda t, a, b: b in t, "ab": lambda t, a, b: a in t or b in t}
    want = {(r, a, None): (len(traces), sum(not keeps(r, t, a, None) for t in traces)) for r in declare.UNARY for a in "abcd"}
    want |= {(r, a, b): (sum(active[k](t, a, b) for t in traces), sum(not keeps(r, t, a, b) for t in traces)) for r, k in declare.BINARY.items() for a, b in itertools.permutations("abcd", 2)}
    assert got == want
    rules = spark.createDataFrame(list(want), "template string, a string, b string")
    cases = declare.check(log, rules).groupBy("template", "a", "b").agg(F.count("*").alias("n"), F.count_if("violated").alias("bad")).collect()
    assert {(r.template, r.a, r.b): (r.n, r.bad) for r in cases} == {k: v for k, v in want.items() if v[0]}


def test_pruned_rules_imply_the_dropped_ones(spark):
    log = log_of(spark, ["ab", "abab", "ab", "cab"])
    every, kept = ({(r.template, r.a, r.b) for r in declare.discover(log, 0.9, 0.9, prune=p).collect()} for p in (False, True))
    assert kept < every and ("chainSuccession", "a", "b") in kept and ("response", "a", "b") not in kept
    assert [r.rank for r in declare.discover(log, 0.9, 0.9, limit=3).orderBy("rank").collect()] == [1, 2, 3]


def ocel_of(spark, events, types):
    """events: {event: (time, activity, objects)}"""
    e = spark.createDataFrame([(k, a, t) for k, (t, a, _) in events.items()], "event_id string, activity string, t int").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    o = spark.createDataFrame(list(types.items()), "object_id string, object_type string")
    return OCEL(e, o, spark.createDataFrame([(k, x, "") for k, (_, _, xs) in events.items() for x in xs], "event_id string, object_id string, qualifier string"))


def random_ocel(seed, n=14):
    rng = random.Random(seed)
    types = {f"{t}{k}": t for t in "ABC" for k in range(4)}
    return {f"e{k:02d}": (k, rng.choice("xy"), rng.sample(sorted(types), rng.randint(1, 3))) for k in range(n)}, types


def members_by_search(events, types, leading):
    near = {o: set() for o in types}
    for _, _, xs in events.values():
        for x in xs:
            near[x] |= set(xs) - {x}
    out = set()
    for root in (o for o, t in types.items() if t == leading):
        dist, queue = {root: 0}, [root]
        for o in queue:
            for p in near[o]:
                if p not in dist:
                    dist[p] = dist[o] + 1
                    queue.append(p)
        least = {}
        for o, d in dist.items():
            least[types[o]] = min(d, least.get(types[o], d))
        out |= {(root, o) for o, d in dist.items() if d == least[types[o]]}
    return out


def graphs_by_search(events, types, members):
    of, share = {}, {}
    for root, o in members:
        of.setdefault(root, set()).add(o)
        share[o] = share.get(o, 0) + 1
    mine = {root: set() for root in of}
    for e, (_, _, xs) in events.items():
        known = [x for x in xs if x in share]
        for x in known:
            if share[x] == min(share[y] for y in known):
                for root in of:
                    if x in of[root]:
                        mine[root].add(e)
    tally = lambda xs: ",".join(f"{t}={sum(types[x] == t for x in xs)}" for t in sorted({types[x] for x in xs}))
    out = {}
    for root, es in mine.items():
        order = sorted(es, key=lambda e: (events[e][0], e))
        touch = {e: set(events[e][2]) & of[root] for e in order}
        nodes = [[e, f"{events[e][1]}/{tally(touch[e])}"] for e in order]
        steps = {(a, b) for o in of[root] for s in [[e for e in order if o in touch[e]]] for a, b in zip(s, s[1:])}
        out[root] = (nodes, [[a, b, tally(touch[a] & touch[b])] for a, b in sorted(steps)])
    return out


def same_graph(g, h):
    """By all orders of the nodes."""
    if len(g[0]) != len(h[0]) or len(g[1]) != len(h[1]):
        return False
    label, edges = dict(map(tuple, h[0])), {(a, b): x for a, b, x in h[1]}
    for perm in itertools.permutations([n for n, _ in h[0]]):
        to = dict(zip([n for n, _ in g[0]], perm))
        if all(label[to[n]] == x for n, x in g[0]) and all(edges.get((to[a], to[b])) == x for a, b, x in g[1]):
            return True
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_executions_by_search(spark, seed):
    events, types = random_ocel(seed)
    log = ocel_of(spark, events, types)
    members = executions.by_leading_type(log, "A")
    want = members_by_search(events, types, "A")
    assert {tuple(r) for r in members.collect()} == want
    nodes, edges = executions.graphs(log, members)
    graphs = graphs_by_search(events, types, want)
    assert sorted(map(tuple, nodes.collect())) == sorted((r, *n) for r, g in graphs.items() for n in g[0])
    assert sorted(map(tuple, edges.collect())) == sorted((r, *e) for r, g in graphs.items() for e in g[1])


def test_variants_by_all_orders(spark):
    events, types = {}, {}
    rng = random.Random(5)
    for k in range(12):  # twelve separate executions of few kinds, events in several orders of time
        kind = rng.choice(["path", "fork", "two"])
        types |= {f"A{k:02d}": "A", f"B{k:02d}": "B", f"D{k:02d}": "B"}
        a, b, d = f"A{k:02d}", f"B{k:02d}", f"D{k:02d}"
        steps = {"path": [("x", [a, b]), ("y", [a, b]), ("x", [b])], "fork": [("x", [a, b, d]), ("y", [b]), ("y", [d])], "two": [("x", [a, b]), ("y", [a, d]), ("y", [a])]}[kind]
        events |= {f"e{k:02d}{i}": (rng.randint(0, 2) + 10 * i, act, xs) for i, (act, xs) in enumerate(steps)}
    log = ocel_of(spark, events, types)
    members = executions.by_leading_type(log, "A")
    got = {r.execution: (r.variant, r.n) for r in executions.variants(log, members).collect()}
    graphs = graphs_by_search(events, types, members_by_search(events, types, "A"))
    for x, y in itertools.combinations(sorted(graphs), 2):
        assert (got[x][0] == got[y][0]) == same_graph(graphs[x], graphs[y])
    assert all(n == sum(v == w for w, _ in got.values()) for v, n in got.values())
    assert {r.execution: r.variant for r in executions.partition(log, members).collect()} == {k: v for k, (v, _) in got.items()}
    parts = {tuple(r) for r in executions.by_component(log).collect()}
    assert {len({o for c, o in parts if c == r}) for r, _ in parts} == {3} or len(parts) <= len(types)


@pytest.mark.parametrize("seed", [3])
def test_attributed_edges_and_partitions_by_search(spark, seed):
    """Edges of each object inside each execution, counted one by one; ranks and sizes of the exported parts."""
    events, types = random_ocel(seed)
    log = ocel_of(spark, events, types)
    members = executions.by_leading_type(log, "A")
    pairs = members_by_search(events, types, "A")
    graphs = graphs_by_search(events, types, pairs)
    variant = {r.execution: (r.variant, r.n) for r in executions.variants(log, members).collect()}
    rank = {v: k for k, (v, n) in enumerate(sorted(set(variant.values()), key=lambda x: (-x[1], x[0])), 1)}
    want = {}
    for root, o in pairs:
        own = [e for e, _ in graphs[root][0] if o in events[e][2]]
        for a, b in zip(own, own[1:]):
            key = (types[o], events[a][1], events[b][1])
            n, least = want.get(key, (0, len(rank)))
            want[key] = (n + 1, min(least, rank[variant[root][0]]))
    got = {(r.object_type, r.source, r.target): (r.n, r.min_variant) for r in executions.attributed_edges(log, members).collect()}
    assert want and got == want
    parts = {r.execution: (r.variant, r.n_objects, r.n_events) for r in executions.partition(log, members).collect()}
    assert parts == {r: (variant[r][0], sum(x == r for x, _ in pairs), len(g[0])) for r, g in graphs.items()}


def test_equal_colours_are_not_taken_for_equal_graphs():
    ring = lambda names: [[names[i], names[(i + 1) % len(names)], ""] for i in range(len(names))]
    nodes = [[n, "x"] for n in "abcdef"]
    assert not executions.isomorphic(nodes, ring("abcdef"), nodes, ring("abc") + ring("def"))
    assert executions.isomorphic(nodes, ring("abcdef"), nodes, ring("badcfe"))


def test_numbers_and_sums_over_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9)) for k in range(500)]
    got = ordered.numbered(spark.createDataFrame(rows, "k int, v int"), F.desc("v"), "k", running="v", groups=7).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [(r.k, r.v) for r in got] == want and [r.rank for r in got] == list(range(1, 501))
    assert [r.running for r in got] == list(itertools.accumulate(v for _, v in want))
    assert ordered.numbered(spark.createDataFrame([], "k int"), "k").count() == 0


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_clusters_by_brute_force(spark, linkage):
    rng = random.Random(2)
    names = "abcdefgh"
    sim = {frozenset(p): rng.random() for p in itertools.combinations(names, 2)}
    groups, fold = [[x] for x in names], {"average": lambda v: sum(v) / len(v), "complete": min, "single": max}[linkage]
    while len(groups) > 3:
        g, h = max(itertools.combinations(groups, 2), key=lambda p: fold([sim[frozenset((x, y))] for x in p[0] for y in p[1]]))
        groups = [x for x in groups if x not in (g, h)] + [g + h]
    df = spark.createDataFrame([(*sorted(p), v) for p, v in sim.items()], "a string, b string, similarity double")
    got = {}
    for r in conform.agglomerate(spark, df, 3, linkage).collect():
        got.setdefault(r.cluster, set()).add(r.resource)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
    with pytest.raises(ValueError):
        conform.agglomerate(spark, df, 3, linkage, most=5)


def test_times_of_xes_keep_fractions_and_offsets(spark, tmp_path):
    event = '<event><string key="concept:name" value="a"/><date key="time:timestamp" value="{}"/></event>'
    times = ["2024-01-01T10:00:00.123456+02:00", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00.5"]
    (tmp_path / "log.xes").write_text(f'<log><trace><string key="concept:name" value="c"/>{"".join(map(event.format, times))}</trace></log>')
    got = [str(r.ts) for r in catalog.read_xes(spark, str(tmp_path / "log.xes")).events.orderBy("event_id").collect()]
    assert got == ["2024-01-01 08:00:00.123456", "2024-01-01 10:00:00", "2024-01-01 10:00:00.500000"]


def test_pairs_of_reassigned_work(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randint(0, 3)}", rng.choice("ab"), rng.choice("xyz"), k) for k in range(60)]
    df = spark.createDataFrame(rows, "case_id string, activity string, resource string, event_id int").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    want = {}
    for (c, a, r, k), (d, b, s, m) in itertools.permutations(rows, 2):
        if (c, a) == (d, b) and k < m and r != s:
            want[r, s] = want.get((r, s), 0) + 1
    assert {(r.source, r.target): r.n for r in relations.reassignment(EventLog(df), once=False).collect()} == want


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_queries_without_sql_have_rows(name, spark, data):
    assert len(spark_rows(all_queries()[name](spark, data))[1]) > 0


def test_alpha_places_by_all_sets(spark, data):
    from tracewright.plans.discovery import year_log

    rel = {(r.a, r.b): r.relation for r in relations.footprint(year_log(spark, data)).collect()}
    names = sorted({a for a, _ in rel if rel[a, a] == "#"})
    sets = [set(c) for k in range(1, len(names) + 1) for c in itertools.combinations(names, k) if all(rel[x, y] == "#" for x in c for y in c)]
    good = [(a, b) for a in sets for b in sets if all(rel[x, y] == "->" for x in a for y in b)]
    top = [p for p in good if not any(q != p and p[0] <= q[0] and p[1] <= q[1] for q in good)]
    got = all_queries()["g3_alpha_places"](spark, data).collect()
    assert sorted((sorted(r.inputs), sorted(r.outputs)) for r in got) == sorted((sorted(a), sorted(b)) for a, b in top) and got


@pytest.mark.parametrize("seed", range(6))
def test_trees_of_tables_are_those_of_counters(spark, seed):
    from collections import Counter

    from tracewright.operators import miners

    rng = random.Random(seed)
    if seed < 3:
        log = Counter("".join(rng.choices("abcd", k=rng.randint(0, 5))) for _ in range(25))
    else:
        log = Counter(rng.choice(["abcd", "acbd", "aed", "abcbcd", "aebcd", ""][: seed]) for _ in range(25))
    v = spark.createDataFrame([(list(t), n) for t, n in log.items()], "seq array<string>, n long")
    for noise in (0.0, 0.2):
        assert miners.mine_table(v, noise, few=0) == miners.mine(Counter({tuple(t): n for t, n in log.items()}), noise)


@pytest.mark.parametrize("seed", range(12))
def test_reduced_nets_accept_the_same_words(seed):
    from tracewright.operators import miners

    rng = random.Random(seed)
    net = miners.tree_to_net(miners.reduced(conform.random_tree(4, seed)))
    top = max(net.places()) + 1
    # Places that never matter: a copy of one with its marks, and a pool that a transition takes from and gives back.
    copy = rng.choice(sorted(net.places()))
    wide = lambda ps: (*ps, *([top] if copy in ps else []))
    k = rng.randrange(len(net.transitions))
    ts = [(x, (*wide(a), *([top + 1] if j == k else [])), (*wide(b), *([top + 1] if j == k else []))) for j, (x, a, b) in enumerate(net.transitions)]
    wider = miners.Net([*ts, (None, (0,), (0,)), ts[0]], (*wide(net.initial), top + 1), (*wide(net.final), top + 1))
    small = conform.simplified(wider)
    assert len(small.transitions) <= len(net.transitions) and len(small.places()) <= len(net.places())
    names = sorted({x for x, _, _ in net.transitions if x})
    one, two = conform.Player(net), conform.Player(small)
    for n in range(5):
        for word in itertools.product(names, repeat=n):
            assert (one.align(word)[0] == 0) == (two.align(word)[0] == 0), word
