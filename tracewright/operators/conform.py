"""Conformance of logs with models and of logs with each other."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import OCEL, EventLog
from ..shipping import ship
from .graph import settled
from .miners import Net
from .olap import relations
from .ordered import numbered
from .relations import positions, rule_counts


class Player:
    """Token game of a net on multisets of places."""

    def __init__(self, net: Net):
        self.net = net
        self.by_label: dict[str, list[int]] = {}
        for k, (label, _, _) in enumerate(net.transitions):
            self.by_label.setdefault(label, []).append(k)

    def enabled(self, marking: dict[int, int], t: int) -> bool:
        return all(marking.get(p, 0) > 0 for p in self.net.transitions[t][1])

    def fire(self, marking: dict[int, int], t: int) -> dict[int, int]:
        out = dict(marking)
        for p in self.net.transitions[t][1]:
            out[p] = out.get(p, 0) - 1
        for p in self.net.transitions[t][2]:
            out[p] = out.get(p, 0) + 1
        return {p: n for p, n in out.items() if n}

    def silently(self, marking: dict[int, int], done, depth: int = 12, most: int = 20_000) -> list[int] | None:
        """Shortest run of silent transitions to a marking that ``done`` accepts."""
        seen, queue = {frozenset(marking.items())}, deque([(marking, [])])
        while queue:
            m, path = queue.popleft()
            if done(m):
                return path
            if len(path) < depth:
                for t in self.by_label.get(None, ()):
                    if self.enabled(m, t):
                        n = self.fire(m, t)
                        key = frozenset(n.items())
                        if key not in seen and len(seen) < most:
                            seen.add(key)
                            queue.append((n, [*path, t]))
        return None

    def replay(self, trace: tuple[str, ...]) -> tuple[int, int, int, int]:
        """Tokens produced, consumed, missing and remaining."""
        marking: dict[int, int] = {}
        for p in self.net.initial:
            marking[p] = marking.get(p, 0) + 1
        produced, consumed, missing = len(self.net.initial), 0, 0

        def step(t: int) -> None:
            nonlocal marking, produced, consumed, missing
            for p in self.net.transitions[t][1]:
                if marking.get(p, 0) < 1:
                    missing += 1
                    marking[p] = marking.get(p, 0) + 1
            consumed += len(self.net.transitions[t][1])
            produced += len(self.net.transitions[t][2])
            marking = self.fire(marking, t)

        for a in trace:
            choices = self.by_label.get(a, [])
            if not choices:
                missing, consumed = missing + 1, consumed + 1
                continue
            t = next((t for t in choices if self.enabled(marking, t)), None)
            if t is None:
                for s in self.silently(marking, lambda m: any(self.enabled(m, t) for t in choices)) or []:
                    step(s)
                t = next((t for t in choices if self.enabled(marking, t)), None)
            if t is None:
                t = min(choices, key=lambda t: sum(marking.get(p, 0) < 1 for p in self.net.transitions[t][1]))
            step(t)
        goal = set(self.net.final)
        for s in self.silently(marking, lambda m: all(m.get(p, 0) > 0 for p in goal)) or []:
            step(s)
        for p in self.net.final:
            consumed += 1
            if marking.get(p, 0) > 0:
                marking[p] -= 1
            else:
                missing += 1
        return produced, consumed, missing, sum(marking.values())

    def align(self, trace: tuple[str, ...], most: int = 300_000) -> tuple[int, int, int, int] | None:
        """(cost, synchronous, log only, model only) of a cheapest alignment: uniform-cost search on the product."""
        start = (0, frozenset((p, 1) for p in self.net.initial))
        goal = (len(trace), frozenset((p, 1) for p in self.net.final))
        best, tie = {start: 0}, count()
        heap = [(0, next(tie), start, (0, 0, 0))]
        while heap:
            cost, _, state, moves = heapq.heappop(heap)
            if state == goal:
                return (cost, *moves)
            if cost > best.get(state, cost) or len(best) > most:
                if len(best) > most:
                    return None
                continue
            at, frozen = state
            marking = dict(frozen)
            nxt = [((at + 1, frozen), 1, (0, 1, 0))] if at < len(trace) else []
            for t, (label, _, _) in enumerate(self.net.transitions):
                if self.enabled(marking, t):
                    after = frozenset(self.fire(marking, t).items())
                    nxt.append(((at, after), 0 if label is None else 1, (0, 0, label is not None)))
                    if label is not None and at < len(trace) and trace[at] == label:
                        nxt.append(((at + 1, after), 0, (1, 0, 0)))
            for s, c, m in nxt:
                if cost + c < best.get(s, 1 << 60):
                    best[s] = cost + c
                    heapq.heappush(heap, (cost + c, next(tie), s, tuple(x + y for x, y in zip(moves, m))))
        return None


def token_replay(variants: DataFrame, net: Net) -> DataFrame:
    """(seq, n, produced, consumed, missing, remaining, fitness) of each variant."""
    ship(variants.sparkSession)
    known = variants.sparkSession.sparkContext.broadcast(net)  # model-sized

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player = Player(known.value)
        for p in parts:
            rows = [player.replay(tuple(s)) for s in p["seq"]]
            out = p.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("produced", "consumed", "missing", "remaining"))})
            out["fitness"] = 0.5 * (1 - out.missing / out.consumed) + 0.5 * (1 - out.remaining / out.produced)
            yield out[["seq", "n", "produced", "consumed", "missing", "remaining", "fitness"]]

    return variants.select("seq", "n").mapInPandas(run, "seq array<string>, n long, produced long, consumed long, missing long, remaining long, fitness double")


def alignments(variants: DataFrame, net: Net) -> DataFrame:
    """(seq, n, cost, synchronous, log_only, model_only, fitness) of each variant; nulls if the search gave up.

    Fitness is 1 - cost / (trace length + cost of the cheapest run of the model).
    """
    ship(variants.sparkSession)
    known = variants.sparkSession.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player = Player(known.value)
        floor = (player.align(()) or (0,))[0]
        for p in parts:
            rows = [player.align(tuple(s)) for s in p["seq"]]
            for k, c in enumerate(("cost", "synchronous", "log_only", "model_only")):
                p[c] = pd.array([None if r is None else int(r[k]) for r in rows], dtype="Int64")
            p["fitness"] = [None if r is None else 1 - r[0] / max(1, len(s) + floor) for r, s in zip(rows, p["seq"])]
            yield p[["seq", "n", "cost", "synchronous", "log_only", "model_only", "fitness"]]

    return variants.select("seq", "n").mapInPandas(run, "seq array<string>, n long, cost long, synchronous long, log_only long, model_only long, fitness double")


def explored(net: Net, most: int = 200_000) -> tuple[dict[frozenset, list[tuple[int, frozenset]]], bool, bool]:
    """(successors by marking, whether a marking grows without bound, whether the search was cut off)."""
    player, start = Player(net), frozenset((p, 1) for p in net.initial)
    graph: dict[frozenset, list[tuple[int, frozenset]]] = {}
    above: dict[frozenset, frozenset | None] = {start: None}
    queue, unbounded = deque([start]), False
    while queue:
        if len(above) > most:
            return graph, unbounded, True
        m = queue.popleft()
        graph[m] = []
        for t in range(len(net.transitions)):
            if player.enabled(dict(m), t):
                n = frozenset(player.fire(dict(m), t).items())
                tokens, up = dict(n), m
                while up is not None:  # a marking that covers one on its own way
                    if up != n and all(tokens.get(p, 0) >= k for p, k in up):
                        return graph, True, False
                    up = above[up]
                graph[m].append((t, n))
                if n not in above:
                    above[n] = m
                    queue.append(n)
    return graph, unbounded, False


def soundness(spark: SparkSession, net: Net) -> DataFrame:
    """(property, holds): bounded, option to complete, proper completion and no dead transitions; null if unknown."""
    graph, unbounded, cut = explored(net)
    goal = frozenset((p, 1) for p in net.final)
    back: dict[frozenset, set[frozenset]] = {}
    for m, steps in graph.items():
        for _, n in steps:
            back.setdefault(n, set()).add(m)
    good, todo = {goal}, [goal]
    while todo:
        for m in back.get(todo.pop(), ()):
            if m not in good:
                good.add(m)
                todo.append(m)
    fired = {t for steps in graph.values() for t, _ in steps}
    known = lambda holds: None if cut and holds else holds and not unbounded
    covers = any(m != goal and all(dict(m).get(p, 0) >= k for p, k in goal) for m in graph)
    rows = [("bounded", None if cut else not unbounded), ("option to complete", known(all(m in good for m in graph))), ("proper completion", known(not covers)), ("no dead transitions", known(len(fired) == len(net.transitions)))]
    return spark.createDataFrame(rows, "property string, holds boolean")


Arcs = list[tuple[str | None, tuple[int, ...], tuple[int, ...]]]


def _no_ops_and_doubles(ts: Arcs, fixed: tuple[Counter, Counter]) -> Arcs | None:
    """Without silent transitions that change nothing, and transitions that another equals."""
    out = list(dict.fromkeys(t for t in ts if t[0] is not None or t[1] != t[2]))
    return out if len(out) < len(ts) else None


def _series_places(ts: Arcs, fixed: tuple[Counter, Counter]) -> Arcs | None:
    """A place whose tokens can only go on, silently, to one other place is that place."""
    for k, (label, a, b) in enumerate(ts):
        if label is not None or len(a) != 1 or len(b) != 1 or a == b or a[0] in fixed[0] or a[0] in fixed[1]:
            continue
        rest = ts[:k] + ts[k + 1 :]
        if any(a[0] in t[1] or {a[0], b[0]} <= set(t[2]) for t in rest):
            continue
        return [(x, i, tuple(sorted(b[0] if p == a[0] else p for p in o))) for x, i, o in rest]
    return None


def _series_transitions(ts: Arcs, fixed: tuple[Counter, Counter]) -> Arcs | None:
    """Two transitions that only ever fire one after the other, one of them silent, are one."""
    for p in sorted({p for t in ts for p in (*t[1], *t[2])} - set(fixed[0]) - set(fixed[1])):
        makers, users = ([t for t in ts if p in t[side]] for side in (2, 1))
        if len(makers) == len(users) == 1 and makers[0] is not users[0] and makers[0][2] == (p,) == users[0][1] and None in (makers[0][0], users[0][0]):
            one = (makers[0][0] or users[0][0], makers[0][1], users[0][2])
            return [one if t is makers[0] else t for t in ts if t is not users[0]]
    return None


def _needless_places(ts: Arcs, fixed: tuple[Counter, Counter]) -> Arcs | None:
    """Without a place that never matters: always held by all that use it, or never holding less than another place
    that constrains at least as much, at a fixed distance and marked alike at the end (equal places among them)."""
    initial, final = fixed
    places = sorted({p for t in ts for p in (*t[1], *t[2])})

    def gone(p: int) -> Arcs:
        for c in fixed:
            del c[p]
        return [(x, tuple(q for q in i if q != p), tuple(q for q in o if q != p)) for x, i, o in ts]

    for p in places:
        mine = [(t[1].count(p), t[2].count(p)) for t in ts]
        more = lambda c: any(q != p for q in c) or p not in c  # noqa: B023, E731
        if not more(initial) or not more(final):
            continue  # some place has to be marked
        if initial[p] == final[p] >= 1 and all(i == o <= initial[p] for i, o in mine) and all(len(set(t[1])) > 1 or p not in t[1] for t in ts):
            return gone(p)
        for q in places:
            if q != p and initial[p] - initial[q] == final[p] - final[q] >= 0 and all(i <= t[1].count(q) and o - i == t[2].count(q) - t[1].count(q) for (i, o), t in zip(mine, ts)):
                return gone(p)
    return None


def simplified(net: Net) -> Net:
    """The same language with fewer places and transitions: silent no-ops, equal transitions, series of places and of
    transitions, places that never matter (self-loops, equal and implicit ones), until no rule fires. Places without
    arcs are not part of a net."""
    ts = [(label, tuple(sorted(a)), tuple(sorted(b))) for label, a, b in net.transitions]
    fixed = Counter(net.initial), Counter(net.final)
    rules = (_no_ops_and_doubles, _series_places, _series_transitions, _needless_places)
    while (new := next((x for rule in rules if (x := rule(ts, fixed)) is not None), None)) is not None:
        ts = new
    return Net(ts, tuple(sorted(fixed[0].elements())), tuple(sorted(fixed[1].elements())))


def check_rules(log: EventLog, rules: DataFrame) -> DataFrame:
    """(template, a, b, activations, violations, holds) of given binary rules (template, a, b) on a log."""
    r = rule_counts(log)
    x = rules.join(r, ["a", "b"], "left")
    v = F.when(F.col("template") == "response", F.col("response")).when(F.col("template") == "precedence", F.col("preceded")).when(F.col("template") == "chain response", F.col("chain")).otherwise(F.col("responded"))
    v = F.coalesce(v, F.lit(0))
    return x.select("template", "a", "b", F.coalesce("activations", F.lit(0)).alias("activations"), v.alias("violations"), (v == 0).alias("holds"))


def skeleton_violations(log: EventLog, skeleton: DataFrame) -> DataFrame:
    """(relation, a, b, cases): cases that break always-after, always-before, never-together and equivalence rules."""
    p = positions(log)
    a = p.select("case_id", F.col("activity").alias("a"), F.col("first").alias("fa"), F.col("last").alias("la"), F.col("k").alias("ka"))
    b = p.select("case_id", F.col("activity").alias("b"), F.col("first").alias("fb"), F.col("last").alias("lb"), F.col("k").alias("kb"))
    rules = F.broadcast(skeleton.where("relation <> 'directly-follows'"))  # pairs of names
    x = rules.join(a, "a").join(b, ["case_id", "b"], "left")
    one = F.expr("""case relation when 'always-after' then lb is null or lb < la when 'always-before' then fb is null or fb > fa
        when 'never-together' then kb is not null else kb is null or ka <> kb end""")
    alone = rules.where("relation = 'equivalence'").join(b, "b").join(a, ["case_id", "a"], "left_anti").select("relation", "a", "b", "case_id")
    return x.where(one).select("relation", "a", "b", "case_id").unionAll(alone).groupBy("relation", "a", "b").agg(F.countDistinct("case_id").alias("cases"))


def compare(one: OCEL, two: OCEL) -> DataFrame:
    """(relation, only_one, only_two, both, jaccard) of each relation's rows as sets."""
    out = None
    for name, cols in (("events", ["event_id", "activity", "ts"]), ("objects", ["object_id", "object_type"]), ("e2o", ["event_id", "object_id", "qualifier"])):
        rows = getattr(one, name).select(*cols).distinct().withColumn("s", F.lit(1)).unionAll(getattr(two, name).select(*cols).distinct().withColumn("s", F.lit(2)))
        m = rows.groupBy(*cols).agg(F.sum("s").alias("s")).agg(F.count_if(F.col("s") == 1).alias("only_one"), F.count_if(F.col("s") == 2).alias("only_two"), F.count_if(F.col("s") == 3).alias("both"))
        m = m.select(F.lit(name).alias("relation"), "*", F.try_divide(F.col("both").cast("double"), F.expr("only_one + only_two + both").cast("double")).alias("jaccard"))
        out = m if out is None else out.unionAll(m)
    return out


def type_count_deltas(one: OCEL, two: OCEL) -> DataFrame:
    """(kind, name, n_one, n_two, delta) of activities and object types."""
    def counts(log: OCEL, n: str) -> DataFrame:
        e = log.events.groupBy(F.lit("activity").alias("kind"), F.col("activity").alias("name")).agg(F.count("*").alias(n))
        return e.unionAll(log.objects.groupBy(F.lit("type"), "object_type").agg(F.count("*")))

    x = counts(one, "n_one").join(counts(two, "n_two"), ["kind", "name"], "full")
    a, b = F.coalesce("n_one", F.lit(0)), F.coalesce("n_two", F.lit(0))
    return x.select("kind", "name", a.alias("n_one"), b.alias("n_two"), (b - a).alias("delta"))


def reconstruct(log: OCEL, dropped: DataFrame) -> DataFrame:
    """(event_id, object_id, rank, candidates): where each dropped relation's object ranks among the objects that
    co-occur elsewhere with what the event still has, by the sum of log co-occurrence probabilities (floor 1e-9).

    The model is fitted on the events that lost nothing. A gap whose object never co-occurred has a null rank.
    """
    dropped = settled(dropped)
    # One pass by event; events go by the number of their first row afterwards. A lost relation without an object is none.
    one = log.e2o.select("event_id", "object_id", F.lit(0).alias("gap"), F.lit(0).alias("lost"))
    rows = one.unionAll(dropped.select("event_id", "object_id", F.col("object_id").isNotNull().cast("int"), F.lit(1))).repartition("event_id")
    rows = rows.groupBy("event_id", "object_id").agg(F.max("gap").alias("gap"), F.max("lost").alias("lost")).withColumn("_id", F.monotonically_increasing_id())
    of = Window.partitionBy("event_id")
    rows = rows.select("event_id", "object_id", "gap", F.max("lost").over(of).alias("lost"), F.min("_id").over(of).alias("e"))
    rows = settled(rows.select("e", "object_id", "gap", "lost", F.col("event_id").isNotNull().alias("known"), F.when(F.col("lost") == 1, F.col("event_id")).alias("event_id")))
    train = rows.where("lost = 0")
    left, gaps = (rows.where(f"lost = 1 and gap = {k} and known").select(F.col("e").alias("event_id"), "object_id") for k in (0, 1))
    n = train.groupBy(F.col("object_id").alias("o")).agg(F.count("*").alias("n"))
    known = train.where("known")
    pair = known.select("e", F.col("object_id").alias("o")).join(known.select("e", F.col("object_id").alias("c")), "e").where("o <> c").groupBy("o", "c").agg(F.count("*").alias("k"))
    pair = settled(pair)
    floor = F.ln(F.lit(1e-9))
    left = rankable(left, gaps, pair.select("o", "c")).select(F.col("event_id").alias("e"), "object_id")
    # Every known object of the event gives each candidate log(p + 1e-9); unseen pairs give the floor. What the event has
    # and has lost comes along, so that one shuffle by event does for sums, exclusion and ranks.
    w = F.ln(F.col("k") / F.col("n") + 1e-9) - floor
    given = left.select("e", F.col("object_id").alias("o")).join(n, "o").join(pair, "o").select("e", "c", w.alias("v"), F.lit(0).alias("held"), F.lit(0).alias("gap"))
    held = left.select("e", F.col("object_id").alias("c"), F.lit(None).cast("double"), F.lit(1), F.lit(0))
    asked = gaps.select(F.col("event_id").alias("e"), F.col("object_id").alias("c"), F.lit(None).cast("double"), F.lit(0), F.lit(1)).join(left.select("e").distinct(), "e", "left_semi")
    s = given.unionAll(held).unionAll(asked).repartition("e").groupBy("e", "c").agg(F.sum("v").alias("gain"), F.max("held").alias("held"), F.max("gap").alias("gap"))
    by = Window.partitionBy("e")
    s = s.withColumn("m", F.sum("held").over(by)).where("held = 0 and gain is not null").select("e", "c", "gap", F.round(F.col("gain") + F.col("m") * floor, 9).alias("score"))
    ranked = s.select("e", F.col("c").alias("object_id"), "gap", F.row_number().over(by.orderBy(F.desc("score"), "c")).alias("rank"), F.count("*").over(by).alias("candidates")).where("gap = 1")
    found = ranked.join(rows.where("gap = 1").select("e", "object_id", "event_id"), ["e", "object_id"]).select("event_id", "object_id", "rank", "candidates")
    return dropped.join(found, ["event_id", "object_id"], "left").select("event_id", "object_id", F.col("rank").cast("long").alias("rank"), "candidates")


def rankable(left: DataFrame, dropped: DataFrame, pairs: DataFrame) -> DataFrame:
    """What is left (event_id, object_id) of the events that lost an object which is together, in ``pairs`` (o, c), with
    one that is left: elsewhere no lost object is a candidate, so that no candidates need be listed."""
    tried = left.select("event_id", F.col("object_id").alias("o")).join(dropped.select("event_id", F.col("object_id").alias("c")), "event_id")
    return settled(left.join(settled(tried.join(pairs, ["o", "c"], "left_semi").select("event_id").distinct()), "event_id", "left_semi"))


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """One row: gaps, hits at 1, 3, 5 and 10, and the mean reciprocal rank; gaps without a rank count as misses."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hits_{k}")
    return ranks.agg(F.count("*").alias("gaps"), hit(1), hit(3), hit(5), hit(10), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def ranking_by_type(ranks: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_type, gaps, hits_1, hits_10, mrr) of ranked gaps by the type of the missing object."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hits_{k}")
    return ranks.join(objects, "object_id").groupBy("object_type").agg(F.count("*").alias("gaps"), hit(1), hit(10), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """(bucket, n): gaps by the rank of their object: 1, 2-3, 4-5, 6-10, over 10, none."""
    r = F.col("rank")
    bucket = F.when(r.isNull(), "none").when(r <= 1, "1").when(r <= 3, "2-3").when(r <= 5, "4-5").when(r <= 10, "6-10").otherwise("over 10")
    return ranks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def precision_at(ranks: DataFrame, k: int) -> DataFrame:
    """One row: precision, recall and F1 of the first ``k`` candidates of every event against the objects it lost."""
    e = ranks.groupBy("event_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.count("*").alias("lost"))
    s = e.agg(F.sum("hits").alias("h"), (F.count("*") * k).alias("shown"), F.sum("lost").alias("lost"))
    p, r = F.col("h") / F.col("shown"), F.col("h") / F.col("lost")
    return s.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def play_out(spark: SparkSession, net: Net, cases: int, seed: int = 42, most: int = 200) -> DataFrame:
    """(case_id, pos, activity, ended): random runs of a net, each from its own seed.

    Runs that get stuck or don't end in time keep their events, with ``ended`` false; a run without events has one row
    of position 0.
    """
    ship(spark)
    known = spark.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        player = Player(known.value)
        goal = frozenset((p, 1) for p in player.net.final)
        for part in parts:
            rows = []
            for case in part["id"]:
                rng, marking, trace, done = random.Random(f"{seed}:{case}"), {p: 1 for p in player.net.initial}, [], False
                for _ in range(4 * most):
                    if frozenset(marking.items()) == goal:
                        done = True
                        break
                    able = [t for t in range(len(player.net.transitions)) if player.enabled(marking, t)]
                    if not able or len(trace) >= most:
                        break
                    t = rng.choice(able)
                    marking = player.fire(marking, t)
                    if player.net.transitions[t][0] is not None:
                        trace.append(player.net.transitions[t][0])
                rows += [(str(case), k, a, done) for k, a in enumerate(trace, 1)] or [(str(case), 0, None, done)]
            yield pd.DataFrame(rows, columns=["case_id", "pos", "activity", "ended"])

    return spark.range(cases).mapInPandas(run, "case_id string, pos int, activity string, ended boolean")


def random_tree(activities: int, seed: int = 42, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), silent: float = 0.2) -> tuple:
    """A random process tree with that many activities; leaves of choices and loops are silent with some probability."""
    import random

    rng = random.Random(seed)
    names = count(1)

    def grow(n: int) -> tuple:
        if n <= 1:
            return ("act", f"a{next(names)}")
        op = rng.choices(("seq", "xor", "and", "loop"), weights)[0]
        k = 2 if op == "loop" else rng.randint(2, min(n, 4))
        cuts = sorted(rng.sample(range(1, n), k - 1))
        sizes = [b - a for a, b in zip([0, *cuts], [*cuts, n])]
        children = [grow(s) for s in sizes]
        if op in ("xor", "loop") and rng.random() < silent:
            children = [*children, ("tau",)] if op == "xor" else [children[0] if n < 3 else ("seq", *children), ("tau",)]
        return (op, *children)

    return grow(activities)


def agglomerate(spark: SparkSession, similarity: DataFrame, clusters: int, linkage: str = "average", most: int = 2000) -> DataFrame:
    """(resource, cluster): resources joined by similarity (a, b, similarity), pairs not listed having 0, to that many clusters."""
    names = sorted(r[0] for r in similarity.select(F.explode(F.array("a", "b"))).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} resources")
    at = {x: k for k, x in enumerate(names)}
    near = np.zeros((len(names), len(names)))
    for a, b, s in similarity.select("a", "b", "similarity").collect():  # one row a pair of at most ``most`` names
        near[at[a], at[b]] = near[at[b], at[a]] = s or 0.0
    groups = [[x] for x in names]
    for i, j, _ in merges(near, [1] * len(names), linkage, len(names) - clusters):
        groups[i] += groups[j]
        groups[j] = []
    return spark.createDataFrame([(x, k) for k, g in enumerate(sorted(sorted(g) for g in groups if g)) for x in g], "resource string, cluster int")


def merges(near: np.ndarray, sizes: list[int], linkage: str, steps: int) -> Iterator[tuple[int, int, float]]:
    """(i, j, similarity) of clusters joined one after the other, i < j: j becomes part of i. ``near`` is used up."""
    sizes, alive = list(sizes), np.ones(len(sizes), bool)
    np.fill_diagonal(near, -np.inf)
    for _ in range(steps):
        i, j = divmod(int(near.argmax()), len(sizes))  # the first pair of the greatest similarity
        i, j = min(i, j), max(i, j)
        yield i, j, float(near[i, j])
        if linkage == "average":
            row = (near[i] * sizes[i] + near[j] * sizes[j]) / (sizes[i] + sizes[j])
        else:
            row = (np.minimum if linkage == "complete" else np.maximum)(near[i], near[j])
        sizes[i] += sizes[j]
        alive[j] = False
        row[i] = row[~alive] = -np.inf
        near[i], near[:, i], near[j], near[:, j] = row, row, -np.inf, -np.inf


def nearest(clusters: DataFrame, block: int) -> DataFrame:
    """(id, other, similarity): of each cluster (id, vec, n) the one with the greatest mean cosine, ties to the smaller id.

    Clusters meet in pairs of blocks, a pair in a task; only the nearest of each block leaves it.
    """
    packed = clusters.withColumn("block", F.expr(f"id div {block}")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "vec", "n"))).alias("rows"))  # ``block`` rows a block
    packed = settled(packed)
    one, two = packed.select(F.col("block").alias("i"), F.col("rows").alias("one")), packed.select(F.col("block").alias("j"), F.col("rows").alias("two"))
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pairs:
            for i, j, *sides in p[["i", "j", "one", "two"]].itertuples(index=False):
                ids, means = zip(*[(np.array([r["id"] for r in s]), np.array([np.asarray(r["vec"]) / r["n"] for r in s])) for s in sides])
                near = means[0] @ means[1].T
                if i == j:  # the same from either end
                    near = np.maximum(near, near.T)
                    np.fill_diagonal(near, -np.inf)
                for s, o, m in ((0, 1, near), (1, 0, near.T))[: 1 if i == j else 2]:
                    at = m.argmax(axis=1)
                    found = pd.DataFrame({"id": ids[s], "other": ids[o][at], "similarity": m[np.arange(len(at)), at]})
                    yield found[found["similarity"] > -np.inf]

    met = one.crossJoin(two).where("i <= j").repartition(parts).mapInPandas(run, "id long, other long, similarity double")
    return met.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("m")).select("id", (-F.col("m.o")).alias("other"), "m.similarity")


def agglomerate_profiles(profiles: DataFrame, clusters: int, few: int = 2000, block: int = 2000) -> DataFrame:
    """(resource, cluster): resources (resource, profile, q) joined to that many clusters by the mean cosine of their
    profiles; ``q`` is a profile's sum of squares.

    Equal profiles are one cluster from the start. Clusters that are each other's nearest are joined all at once, round
    by round, until ``few`` are left, and those are joined one after the other: with mean similarities either way gives
    the same tree. Of the tree the joins of least similarity are taken back. A mean is a product of summed unit vectors.
    """
    spark = profiles.sparkSession
    ship(spark)
    of = settled(profiles.select("resource", "profile", "q"))
    kinds = of.groupBy("profile", "q").agg(F.min("resource").alias("first"), F.count("*").alias("n"))
    kinds = settled(numbered(kinds, "first").withColumn("id", F.col("rank") - 1))
    labels = of.join(kinds.select("profile", "q", "first", "id"), ["profile", "q"]).select("resource", "first", "id")
    live = kinds.select("id", F.transform("profile", lambda x: x / F.sqrt("q") * F.col("n")).alias("vec"), "n")
    left, rounds, joins = kinds.count(), [], []
    if left < clusters:  # the last of the equal ones stay alone
        alone = labels.where("resource <> first").orderBy(F.desc("first"), F.desc("resource")).limit(clusters - left).select("resource", F.lit(True).alias("alone"))
        return nth_cluster(labels.join(F.broadcast(alone), "resource", "left").select("resource", F.when(F.col("alone"), F.col("resource")).otherwise(F.col("first")).alias("label")))
    while left > few:
        near = settled(nearest(live, block))
        back = near.select(F.col("other").alias("id"), F.col("id").alias("other"))
        new = settled(near.where("id < other").join(back, ["id", "other"]).select("id", "other", "similarity"))
        gone = new.select("id", "other").join(live.select(F.col("id").alias("other"), F.col("vec").alias("more"), F.col("n").alias("k")), "other")
        both = live.join(gone.drop("other"), "id", "left").select("id", F.when(F.col("k").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "more", lambda x, y: x + y)).alias("vec"), (F.col("n") + F.coalesce("k", F.lit(0))).alias("n"))
        live = settled(both.join(new.select(F.col("other").alias("id")), "id", "left_anti"))
        rounds.append(new)
        left = live.count()
    rest = sorted(live.collect())  # ``few`` rows
    means = np.array([np.asarray(r.vec) / r.n for r in rest])
    near = means @ means.T
    joins = [(rest[i].id, rest[j].id, s) for i, j, s in merges(np.maximum(near, near.T), [r.n for r in rest], "average", len(rest) - 1)]
    step = "id long, other long, similarity double, round int, nth int"
    tree = spark.createDataFrame([(*x, len(rounds), k) for k, x in enumerate(joins)], step)
    for k, new in enumerate(rounds):
        tree = tree.unionAll(new.select("id", "other", "similarity", F.lit(k), F.lit(0)))
    # Of equal ones the later join first: it may contain the earlier.
    undone = {r.other for r in tree.orderBy("similarity", F.desc("round"), F.desc("nth"), F.desc("id")).limit(clusters - 1).collect()}
    for new in rounds:
        kept = new.where(~F.col("other").isin(list(undone))).select(F.col("other").alias("id"), F.col("id").alias("into"))
        labels = labels.join(kept, "id", "left").select("resource", F.coalesce("into", "id").alias("id"))
    into = {r.id: r.id for r in rest}
    for i, j, _ in reversed(joins):  # a cluster's own root is known before what it took in
        if j not in undone:
            into[j] = into[i]
    last = F.broadcast(spark.createDataFrame(sorted(into.items()), "id long, into long"))
    return nth_cluster(labels.join(last, "id", "left").select("resource", F.coalesce("into", "id").alias("label")))


def nth_cluster(labels: DataFrame) -> DataFrame:
    """(resource, cluster): labels numbered from 0 in the order of their smallest resources."""
    labels = settled(labels)
    first = labels.groupBy("label").agg(F.min("resource").alias("first"))  # a row a cluster
    return labels.join(F.broadcast(first.select("label", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))), "label").select("resource", "cluster")
