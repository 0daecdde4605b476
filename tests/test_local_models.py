"""Local process models against brute force: every way to leave events out, every word of a model."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewright.model import OCEL, EventLog
from tracewright.operators import local_models as lm

TREES = [
    ("seq", "a", "b"), ("and", "a", "b"), ("xor", "a", "b"), ("or", "a", "b"), ("loop", "a"), ("seq", ("loop", "a"), "b"), ("and", ("loop", "a"), "b"), ("seq", "a", ("xor", "b", "c")),
    ("and", ("seq", "a", "b"), "c"), ("xor", ("seq", "a", "b"), ("loop", "c")), ("seq", ("and", "a", "b"), "c"), ("or", ("seq", "a", "b"), "c"), ("loop", ("xor", "a", "b")), ("and", ("and", "a", "b"), "c"),
]


def words(tree, most):
    """All words of one occurrence up to a length, by the operators' meanings."""
    if isinstance(tree, str):
        return {(tree,)}
    if tree[0] == "loop":
        out = once = words(tree[1], most)
        while True:
            more = out | {a + b for a in out for b in once if len(a + b) <= most}
            if more == out:
                return out
            out = more
    x, y = words(tree[1], most), words(tree[2], most)
    if tree[0] == "xor":
        return x | y
    if tree[0] == "seq":
        return {a + b for a in x for b in y}
    if tree[0] == "or":
        return x | y | {a + b for a in x for b in y} | {b + a for a in x for b in y}
    out = set()
    for a, b in itertools.product(x, y):
        for at in itertools.combinations(range(len(a) + len(b)), len(a)):
            i, j = iter(a), iter(b)
            out.add(tuple(next(i) if k in at else next(j) for k in range(len(a) + len(b))))
    return out


def best_by_brute_force(tree, events):
    """(explained events, occurrences) of the best choice of events."""
    known = words(tree, len(events))
    best = {(): 0}
    for n in range(1, len(events) + 1):  # fewest occurrences that a sequence parts into
        for s in itertools.product(sorted(set(events)), repeat=n):
            ways = [best[s[:k]] + 1 for k in range(n) if s[:k] in best and s[k:] in known]
            if ways:
                best[s] = min(ways)
    chosen = {tuple(events[i] for i in at) for n in range(len(events) + 1) for at in itertools.combinations(range(len(events)), n)}
    explained, fewest = max((len(s), -best[s]) for s in chosen if s in best)
    return explained, -fewest


@pytest.mark.parametrize("tree", TREES, ids=lm.key)
def test_explain_by_brute_force(tree):
    rng = random.Random(4)
    names = sorted(set(lm.activities(tree)))
    for _ in range(40):
        events = rng.choices(names, k=rng.randint(1, 7))
        found, fired, allowed, seen = lm.explain(tree, events)
        assert (sum(fired.values()), found) == best_by_brute_force(tree, events), events
        assert len(seen) == found and sum(map(len, seen)) == sum(fired.values()) <= allowed
        assert all(w in words(tree, len(w)) for w in seen)
        assert all(fired[a] <= events.count(a) for a in fired)


@pytest.mark.parametrize("tree", TREES, ids=lm.key)
def test_language(tree):
    one = lm.language(tree)
    assert one <= words(tree, max(map(len, one)))
    if "loop" not in str(tree):
        assert one == words(tree, 9)


def test_keys_and_growth():
    assert lm.key(("and", "a", "b")) == lm.key(("and", "b", "a")) != lm.key(("xor", "a", "b"))
    assert lm.key(("seq", "a", "b")) != lm.key(("seq", "b", "a"))
    assert lm.key(("seq", "a'", "b")) != lm.key(("seq", "a", "'b"))
    every = lm.grown(("seq", "a", "b"), ["c"], ("seq", "xor", "loop"), lambda *x: True)
    assert len(every) == 2 * 3 and ("seq", ("loop", "a"), "b") in every
    assert lm.grown(("loop", "a"), [], ("loop",), lambda *x: True) == []


def log_of(spark, cases):
    rows = [(f"c{i}", a, k, k) for i, c in enumerate(cases) for k, a in enumerate(c)]
    return EventLog(spark.createDataFrame(rows, "case_id string, activity string, ts long, event_id long").withColumn("ts", F.timestamp_seconds("ts")))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(9)
    return [rng.choices("abcd", weights=(4, 3, 2, 1), k=rng.randint(1, 8)) for _ in range(60)] + [list("abab")] * 30


def test_search_by_brute_force(spark, cases):
    got = dict(lm.search(log_of(spark, cases), size=2, least=5, operators=("seq", "xor", "and", "or", "loop"), determinism=0.0, language_fit=0.0))
    counts = {a: sum(c.count(a) for c in cases) for a in "abcd"}
    want = {}
    for op in ("seq", "xor", "and", "or"):
        for a, b in itertools.permutations("abcd", 2):
            want[lm.key((op, a, b))] = (op, a, b)
    want |= {lm.key(("loop", a)): ("loop", a) for a in "abcd"}
    both = {(a, b): sum(a in c and b in c for c in cases) for a in "abcd" for b in "abcd"}
    checked = 0
    for k, tree in want.items():
        if tree[0] in ("seq", "and") and both[tree[1:]] < 5:
            continue
        names = set(lm.activities(tree))
        parts = [[e for e in c if e in names] for c in cases]
        best = [best_by_brute_force(tree, p) for p in parts if p]
        frequency = sum(o for _, o in best)
        m = next((m for t, m in got.items() if lm.key(t) == k), None)
        if frequency < 5:
            assert m is None
            continue
        assert m["frequency"] == frequency
        assert m["fitness"] == pytest.approx(sum(e / len(p) for (e, _), p in zip(best, [p for p in parts if p])) / len(best))
        assert m["coverage"] == pytest.approx(sum(counts[a] for a in names) / sum(counts.values()))
        variants = {tuple(c) for c in cases}
        per = [e / o for e, o in (best_by_brute_force(tree, [x for x in v if x in names]) for v in variants if names & set(v)) if o]
        assert m["avg_firings"] == pytest.approx(sum(per) / len(per))
        assert all(0 <= m[c] <= 1 for c in ("support", "confidence", "determinism", "language_fit", "score"))
        checked += 1
    assert checked == len(got) > 30


def tops(spark, cases, **how):
    return [t for t, _ in lm.search(log_of(spark, cases), least=1, **how)]


def test_shapes_come_first(spark):
    assert tops(spark, ["abab", "abab", "ab"], size=2)[0] == ("seq", "a", "b")
    assert lm.key(tops(spark, ["ab", "ba", "ab", "ba"], size=2)[0]) == lm.key(("and", "a", "b"))
    assert lm.key(tops(spark, ["a", "b", "a", "b"], size=2, operators=("seq", "and", "xor"))[0]) == lm.key(("xor", "a", "b"))
    assert any("loop" in lm.key(t) for t in tops(spark, ["ab", "aab", "aaab", "aab"], size=3, determinism=0.0, language_fit=0.0)[:5])
    assert tops(spark, ["ab"], size=1) == []


def test_empty_log(spark):
    log = log_of(spark, ["a"])
    assert lm.discover(EventLog(log.events.limit(0))).count() == 0


def test_types_are_combined(spark):
    events = spark.createDataFrame([(i, "xy"[i % 2], i) for i in range(40)], "event_id long, activity string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    pairs = [(i, f"o{i // 4}", "") for i in range(40)] + [(i, f"p{i // 8}", "") for i in range(40)] + [(i, f"q{i // 8}", "") for i in range(0, 40, 2)] + [(i, f"p{9 - i // 8}", "") for i in range(0, 40, 2)]
    kinds = {"o": "Order", "p": "Parcel", "q": "Quote"}
    objects = spark.createDataFrame(sorted({(o, kinds[o[0]]) for _, o, _ in pairs}), "object_id string, object_type string")
    log = OCEL(events, objects, spark.createDataFrame(pairs, "event_id long, object_id string, qualifier string"))
    models = lm.discover_by_type(log, size=2, least=2, language_fit=0.0)
    rows = lm.combined(log, models).collect()
    by = {r.model: r for r in rows}
    both = by["seq('x', 'y')"]
    assert both.object_types == ["Order", "Parcel"] and both.variable_arcs == ["x/Parcel"]
    scores = {r.object_type: r.score for r in models.where("model = \"seq('x', 'y')\"").collect()}
    assert both.score == pytest.approx((scores["Order"] + scores["Parcel"]) / 2)
    assert "loop('x')" in by and by["loop('x')"].object_types == ["Order", "Parcel", "Quote"]
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
