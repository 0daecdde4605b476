"""Local process models: small trees that explain parts of many cases, found level by level with counts by Spark.

A tree is an activity's name or a tuple: ("seq", x, y), ("xor", x, y), ("and", x, y), ("or", x, y) (one or both, in
either order) or ("loop", x) (once or more). A model explains a case by disjoint occurrences, one after the other, in the
case's events of the model's activities; as few of those as possible are left out, of such ways one with the fewest
(so the longest) occurrences is taken, and of those the one that explains earlier events.

The search goes in waves. Spark projects the variants on each wave's sets of activities and counts equal projections;
each distinct projection is explained once by each model of its set, and what comes back is one row of sums a model and
each model's seen words. Models of too little support, language fit or determinism are not grown, nor are pairs of
activities that too few cases have both of.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import OCEL, EventLog
from ..shipping import mapped
from .graph import settled
from .olap import relations
from .relations import variants

Tree = str | tuple
DONE = ("done",)
#: Shares of each measure in the score; fixed values.
WEIGHTS = {"support": 0.1, "confidence": 0.4, "determinism": 0.3, "coverage": 0.0, "language_fit": 0.1, "firings": 0.1}
#: A loop's repeats in a model's language.
REPEATS = 3
OPERATORS = ("seq", "xor", "and", "loop")


def activities(tree: Tree) -> tuple[str, ...]:
    return (tree,) if isinstance(tree, str) else tuple(a for x in tree[1:] for a in activities(x))


def key(tree: Tree) -> str:
    """One text for trees that differ in the order of sides where it doesn't matter."""
    if isinstance(tree, str):
        return "'" + tree.replace("\\", "\\\\").replace("'", "\\'") + "'"
    sides = [key(x) for x in tree[1:]]
    return f"{tree[0]}({', '.join(sides if tree[0] == 'seq' else sorted(sides))})"


def may_end(rest: Tree) -> bool:
    """Whether what is left of an occurrence may be nothing."""
    if isinstance(rest, str):
        return False
    if rest[0] in ("done", "maybe"):
        return True
    if rest[0] in ("xor", "or"):
        return any(map(may_end, rest[1:]))
    return all(map(may_end, rest[1:]))


def _then(x: Tree, y: Tree) -> Tree:
    return y if x == DONE else x if y == DONE else ("seq", x, y)


def _beside(x: Tree, y: Tree) -> Tree:
    return y if x == DONE else x if y == DONE else ("and", x, y)


def steps(rest: Tree) -> list[tuple[str, Tree, int]]:
    """(activity, what is left after it, activities that the model allows where it happens)."""
    if isinstance(rest, str):
        return [(rest, DONE, 1)]
    kind = rest[0]
    if kind == "done":
        return []
    if kind in ("loop", "maybe"):
        return [(a, _then(r, ("maybe", rest[1])), n) for a, r, n in steps(rest[1])]
    x, y = rest[1:]
    left, right = steps(x), steps(y)
    if kind == "seq":  # leaving an optional part is a choice made before
        return [(a, _then(r, y), n) for a, r, n in left] + (right if may_end(x) else [])
    if kind == "and":
        return [(a, _beside(r, y), n + len(right)) for a, r, n in left] + [(a, _beside(x, r), n + len(left)) for a, r, n in right]
    if kind == "xor":
        return [(a, r, n + len(right)) for a, r, n in left] + [(a, r, n + len(left)) for a, r, n in right]
    either = 2 * (len(left) + len(right))  # or: both in either order, or one of them
    both = [(a, _then(r, y)) for a, r, _ in left] + [(a, _then(r, x)) for a, r, _ in right]
    return [(a, r, either) for a, r in both] + [(a, r, either) for a, r, _ in left + right]


@lru_cache(maxsize=20_000)
def automaton(tree: Tree) -> tuple[dict[str, list], list[bool]]:
    """Moves by activity, (from, to, allowed), between states numbered from 0 (the start); and which states may end."""
    states, todo, moves = {tree: 0}, [tree], {}
    while todo:
        rest = todo.pop()
        for a, r, n in steps(rest):
            if r not in states:
                states[r] = len(states)
                todo.append(r)
            moves.setdefault(a, []).append((states[rest], states[r], n))
    return moves, [may_end(r) for r in states]


@lru_cache(maxsize=20_000)
def language(tree: Tree) -> frozenset[tuple[str, ...]]:
    """The words of one occurrence, with at most REPEATS repeats of a loop."""
    if isinstance(tree, str):
        return frozenset([(tree,)])
    if tree[0] == "loop":
        once = language(tree[1])
        out = words = once
        for _ in range(REPEATS - 1):
            words = frozenset(a + b for a in words for b in once)
            out |= words
        return out
    x, y = language(tree[1]), language(tree[2])
    if tree[0] == "xor":
        return x | y
    ordered = frozenset(a + b for a in x for b in y)
    if tree[0] == "seq":
        return ordered
    if tree[0] == "or":
        return x | y | ordered | frozenset(b + a for a in x for b in y)
    return frozenset(w for a in x for b in y for w in _shuffles(a, b))


def _shuffles(a: tuple, b: tuple) -> set[tuple]:
    if not a or not b:
        return {a + b}
    return {(a[0], *w) for w in _shuffles(a[1:], b)} | {(b[0], *w) for w in _shuffles(a, b[1:])}


def explain(tree: Tree, events: list[str]) -> tuple[int, dict[str, int], int, list[tuple[str, ...]]]:
    """(occurrences, explained events by activity, sum of allowed activities where they happen, occurrences' words)."""
    moves, ends = automaton(tree)
    # Of each state the best way there: (explained, -occurrences), then the way itself as linked steps.
    best: list = [None] * len(ends)
    best[0] = (0, 0, None)
    for a in events:
        new = list(best)  # leaving the event out
        for s, t, n in moves.get(a, ()):
            was = best[s]
            if was is None:
                continue
            way = (was[2], a, n, False)
            if new[t] is None or (was[0] + 1, was[1]) > new[t][:2]:
                new[t] = (was[0] + 1, was[1], way)
            if ends[t] and (was[0] + 1, was[1] - 1) > new[0][:2]:
                new[0] = (was[0] + 1, was[1] - 1, (was[2], a, n, True))
        best = new
    fired: dict[str, int] = {}
    allowed, words, word, way = 0, [], [], best[0][2]
    while way is not None:
        way, a, n, last = way[0], *way[1:]
        if last and word:
            words.append(tuple(reversed(word)))
            word = []
        word.append(a)
        fired[a] = fired.get(a, 0) + 1
        allowed += n
    if word:
        words.append(tuple(reversed(word)))
    return -best[0][1], fired, allowed, words


def grown(tree: Tree, others: list[str], operators: tuple[str, ...], pair_ok, under_loop: bool = False) -> list[Tree]:
    """Trees with one activity replaced by an operator over it and, but for a loop, another activity."""
    if isinstance(tree, str):
        out = [("loop", tree)] if "loop" in operators and not under_loop else []
        for op in operators:
            out += [] if op == "loop" else [(op, tree, b) for b in others if pair_ok(op, tree, b)]
        return out
    if tree[0] == "loop":
        return [("loop", x) for x in grown(tree[1], others, operators, pair_ok, True)]
    return [(tree[0], x, tree[2]) for x in grown(tree[1], others, operators, pair_ok, under_loop)] + [(tree[0], tree[1], y) for y in grown(tree[2], others, operators, pair_ok, under_loop)]


def projections(table: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """(set, seq, n, variants): distinct projections of the variants on each set of activities, where not empty."""
    spark = table.sparkSession
    wave = spark.createDataFrame([([(i, list(s)) for i, s in enumerate(sets)],)], "sets array<struct<set: int, names: array<string>>>")
    each = table.crossJoin(F.broadcast(wave)).select("seq", "n", F.explode(F.filter("sets", lambda s: F.arrays_overlap(s["names"], F.col("seq")))).alias("_s"))  # one row of names
    seq = F.filter("seq", lambda a: F.array_contains(F.col("_s.names"), a))
    return each.select(F.col("_s.set").alias("set"), seq.alias("seq"), "n").groupBy("set", "seq").agg(F.sum("n").alias("n"), F.count("*").alias("variants"))


def explained(table: DataFrame, trees: list[Tree]) -> dict[Tree, dict]:
    """What each tree explains: sums over the variants, by tree."""
    sets = sorted({tuple(sorted(set(activities(t)))) for t in trees})
    of = {s: i for i, s in enumerate(sets)}
    by_set: dict[int, list[int]] = {}
    for k, t in enumerate(trees):
        by_set.setdefault(of[tuple(sorted(set(activities(t))))], []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        fires: dict[tuple[int, str], int] = {}
        seen: dict[int, set] = {}
        for b in batches:
            for s, seq, n, n_variants in zip(*(b.column(c).to_pylist() for c in ("set", "seq", "n", "variants"))):
                for k in by_set[s]:
                    found, fired, allowed, words = explain(trees[k], seq)
                    count = sum(fired.values())
                    x = sums.setdefault(k, [0, 0, 0, 0, 0.0, 0.0, 0])
                    x[0] += found * n
                    x[1] += count * n
                    x[2] += allowed * n
                    x[3] += n
                    x[4] += n * (count / len(seq))
                    x[5] += n_variants * (count / found) if found else 0.0
                    x[6] += n_variants if found else 0
                    for a, f in fired.items():
                        fires[k, a] = fires.get((k, a), 0) + f * n
                    seen.setdefault(k, set()).update(w for w in words if w in language(trees[k]))
        rows = [(k, "sums", None, *x) for k, x in sums.items()]
        rows += [(k, "fired", a, f, 0, 0, 0, 0.0, 0.0, 0) for (k, a), f in fires.items()]
        rows += [(k, "word", "\x1f".join(w), 1, 0, 0, 0, 0.0, 0.0, 0) for k, words in seen.items() for w in words]
        cols = list(zip(*rows)) or [[] for _ in NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS)], names=NAMES)

    found = mapped(projections(table, sets), run, "tree int, what string, name string, found long, count long, allowed long, cases long, fitness double, firings double, variants long")
    total = found.groupBy("tree", "what", "name").agg(*[F.sum(c).alias(c) for c in NAMES[3:]])
    out: dict[Tree, dict] = {t: {"fired": {}, "words": 0} for t in trees}
    for r in total.collect():  # a few rows a tree
        if r.what == "sums":
            out[trees[r.tree]] |= r.asDict()
        elif r.what == "fired":
            out[trees[r.tree]]["fired"][r.name] = r.found
        else:
            out[trees[r.tree]]["words"] += 1
    return out


NAMES = ["tree", "what", "name", "found", "count", "allowed", "cases", "fitness", "firings", "variants"]
KINDS = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]


def measures(tree: Tree, x: dict, counts: dict[str, int]) -> dict | None:
    """A model's measures from its sums; none if it never occurs."""
    from math import log10

    f = x.get("found", 0)
    if not f:
        return None
    shares = [n / counts[a] for a, n in x["fired"].items()]
    per = x["firings"] / x["variants"]
    out = {
        "frequency": f, "support": log10(f) / (log10(f) + 1), "confidence": len(shares) / sum(1 / s for s in shares), "determinism": x["count"] / x["allowed"],
        "coverage": sum(counts[a] for a in set(activities(tree))) / sum(counts.values()), "language_fit": x["words"] / len(language(tree)), "avg_firings": per, "fitness": x["fitness"] / x["cases"],
    }
    worth = {**out, "firings": per / (per + 1)}
    return out | {"score": sum(w * worth[k] for k, w in WEIGHTS.items()) / sum(WEIGHTS.values())}


def search(log: EventLog, size: int = 3, least: int = 10, operators: tuple[str, ...] = OPERATORS, determinism: float = 0.49, language_fit: float = 0.49, confidence: float = 0.0, coverage: float = 0.0) -> list[tuple[Tree, dict]]:
    """(tree, measures) of the models found in ``size - 1`` waves of growing, each of one operator, the best score first;
    what is held on the driver is names and candidate trees."""
    table = settled(variants(log).where(F.size("seq") > 0))
    counts = {r.a: r.n for r in table.select(F.explode("seq").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    names = table.select(F.array_distinct("seq").alias("a"), F.array_distinct("seq").alias("b"), "n")
    pairs = names.select(F.explode("a").alias("a"), "b", "n").select("a", F.explode("b").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
    together = {(r.a, r.b) for r in pairs.where(F.col("n") >= least).collect()}  # pairs of names
    often = sorted(a for a, n in counts.items() if n >= least)

    front, known, found = [(a, True, 1.0, True) for a in sorted(counts)], set(), []
    for _ in range(size - 1):
        new: dict[str, Tree] = {}
        for tree, supported, certain, fits in front:
            rest = [b for b in sorted(counts) if b not in activities(tree)]
            usable = []
            for op in operators:
                ready = {"seq": supported, "loop": supported and fits and certain >= determinism}
                if ready.get(op, certain >= determinism):
                    usable.append(op)

            def pair_ok(op: str, a: str, b: str) -> bool:
                return op in ("xor", "or") or (a, b) in together and counts[b] >= least

            for t in grown(tree, rest, tuple(usable), pair_ok):
                if (k := key(t)) not in known:
                    known.add(k)
                    new[k] = t
        if not new or not often:
            break
        front = []
        for tree, x in explained(table, list(new.values())).items():
            m = measures(tree, x, counts)
            if m is None:
                front.append((tree, False, 1.0, True))
                continue
            ok = m["frequency"] >= least
            front.append((tree, ok, m["determinism"], m["language_fit"] >= language_fit))
            if ok and m["determinism"] >= determinism and m["language_fit"] >= language_fit and m["confidence"] >= confidence and m["coverage"] >= coverage:
                found.append((tree, m))
    return sorted(found, key=lambda x: (-x[1]["score"], key(x[0])))


MODEL = "rank long, model string, activities array<string>, frequency long, support double, confidence double, determinism double, coverage double, language_fit double, avg_firings double, fitness double, score double"


def discover(log: EventLog, **how) -> DataFrame:
    """(rank, model, activities, measures, score) of the models that ``search`` finds."""
    rows = [(n, key(t), list(activities(t)), *[m[c] for c in ("frequency", "support", "confidence", "determinism", "coverage", "language_fit", "avg_firings", "fitness", "score")]) for n, (t, m) in enumerate(search(log, **how), 1)]
    return log.events.sparkSession.createDataFrame(rows, MODEL)


def discover_by_type(log: OCEL, **how) -> DataFrame:
    """The models of each object type, its objects as cases: ``discover`` with the ``object_type``."""
    out = None
    for kind in [r.object_type for r in log.objects.select("object_type").distinct().orderBy("object_type").collect()]:
        r = relations(log).where(F.col("object_type") == kind).select(F.col("object_id").alias("case_id"), "activity", "ts", "event_id").distinct()
        one = discover(EventLog(r), **how).withColumn("object_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def combined(log: OCEL, models: DataFrame, variable: float = 0.95) -> DataFrame:
    """(rank, model, object_types, measures, score, variable_arcs): models that several types have, measures averaged;
    an arc (activity, type) is variable where that share of the activity's events relates to several objects of it."""
    per = relations(log).groupBy("event_id", "activity", "object_type").agg(F.count("*").alias("n"))
    arcs = per.groupBy("activity", "object_type").agg(F.avg((F.col("n") > 1).cast("double")).alias("share")).where(F.col("share") >= variable)
    cols = ["frequency", "support", "confidence", "determinism", "coverage", "language_fit", "avg_firings", "fitness", "score"]
    many = models.groupBy("model").agg(F.array_sort(F.collect_set("object_type")).alias("object_types"), F.first("activities").alias("activities"), *[F.avg(c).alias(c) for c in cols]).where(F.size("object_types") > 1)
    wide = many.select("model", F.explode("activities").alias("activity"), "object_types").select("model", "activity", F.explode("object_types").alias("object_type")).distinct()
    found = wide.join(arcs, ["activity", "object_type"]).groupBy("model").agg(F.array_sort(F.collect_list(F.concat_ws("/", "activity", "object_type"))).alias("variable_arcs"))
    out = many.join(found, "model", "left").withColumn("variable_arcs", F.coalesce("variable_arcs", F.array().cast("array<string>")))
    rows = out.select("model", "object_types", *cols, "variable_arcs").collect()  # models, not events
    rows = [(n, *r) for n, r in enumerate(sorted(rows, key=lambda r: (-r.score, r.model)), 1)]
    return log.events.sparkSession.createDataFrame(rows, f"rank long, model string, object_types array<string>, {', '.join(f'{c} double' for c in cols)}, variable_arcs array<string>")
