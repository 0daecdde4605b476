"""Iterative graph primitives on DataFrames: components, reachability levels and colour refinement."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Edges of a connected part that one task may gather; larger parts are searched by joins.
GATHERED = 20_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder and read back, which ends its lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """(vertex, component): the smallest vertex that each can reach, by label spreading with pointer jumping."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = settled(e.unionAll(e.select(F.col("v"), F.col("u"))).distinct())
    labels = settled(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")))
    for _ in range(most_rounds):
        heard = e.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        near = labels.join(heard, "u").select("u", F.least("label", "other").alias("mid"), F.col("label").alias("was"))
        jump = near.join(labels.select(F.col("u").alias("mid"), F.col("label").alias("far")), "mid")
        step = settled(jump.select("u", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("was")).alias("moved")))
        labels = step.select("u", "label")
        if step.where("moved").isEmpty():
            return labels.select(F.col("u").alias("vertex"), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def component_sizes(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the number of components and the size of the largest."""
    return connected_components(edges, a, b).groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest"))


def levels(edges: DataFrame, sources: DataFrame, most: int = 1000) -> DataFrame:
    """(source, vertex, distance): breadth-first distances from each source over undirected edges (u, v)."""
    e = edges.select("u", "v").unionAll(edges.select(F.col("v"), F.col("u"))).distinct()
    seen = front = settled(sources.select("source", F.col("source").alias("vertex"), F.lit(0).alias("distance")))
    for k in range(1, most + 1):
        step = front.join(e, F.col("vertex") == F.col("u")).select("source", F.col("v").alias("vertex"), F.lit(k).alias("distance")).distinct()
        front = settled(step.join(seen, ["source", "vertex"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
    raise RuntimeError("vertices lie farther apart than that many steps")


def refine_colours(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(vertex, colour): Weisfeiler-Leman refinement of labelled vertices over directed, labelled edges (u, v, label)."""
    c = nodes.select("vertex", F.sha2(F.col("label"), 256).alias("colour"))
    classes = -1
    for _ in range(rounds):
        out = edges.join(c.select(F.col("vertex").alias("v"), "colour"), "v").select(F.col("u").alias("vertex"), F.concat_ws("|", F.lit("o"), "label", "colour").alias("n"))
        into = edges.join(c.select(F.col("vertex").alias("u"), "colour"), "u").select(F.col("v").alias("vertex"), F.concat_ws("|", F.lit("i"), "label", "colour").alias("n"))
        around = out.unionAll(into).groupBy("vertex").agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("around"))
        c = settled(c.join(around, "vertex", "left").select("vertex", F.sha2(F.concat_ws("#", "colour", F.coalesce("around", F.lit(""))), 256).alias("colour")))
        now = c.select("colour").distinct().count()
        if now == classes:
            return c
        classes = now
    raise RuntimeError("colours did not settle")


def released(*tables: DataFrame) -> None:
    """Delete tables that ``settled`` gave and that nothing reads any more."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def least_reaching(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(vertex, label): of each vertex the smallest that can reach it, itself included, over directed edges (u, v)."""
    labels = settled(edges.select(F.col("u").alias("vertex")).union(edges.select("v")).distinct().withColumn("label", F.col("vertex")))
    for _ in range(most):
        heard = edges.join(labels.select(F.col("vertex").alias("u"), "label"), "u").groupBy(F.col("v").alias("vertex")).agg(F.min("label").alias("other"))
        # A label's own label is as good: what reaches the label reaches the vertex.
        near = labels.join(heard, "vertex", "left").select("vertex", F.col("label").alias("was"), F.least("label", "other").alias("mid"))
        far = labels.select(F.col("vertex").alias("mid"), F.col("label").alias("far"))
        step = settled(near.join(far, "mid", "left").select("vertex", "was", F.least("mid", "far").alias("label")))
        still = step.where("label <> was").isEmpty()
        released(labels)
        labels = step.select("vertex", "label")
        labels.settled_at = step.settled_at
        if still:
            return labels
    raise RuntimeError("labels did not settle")


def groups_of(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(vertex, grp): a number for each part of a graph (u, v) that is connected when directions don't count.

    Each round every vertex goes to the one with the smallest hash beside it or itself and the edges go along, so that
    vertices get fewer by a share and rounds by joins of less and less; hashes change, so that no order is a long one.
    """
    e = settled(edges.select("u", "v").where("u <> v").unionAll(edges.select(F.col("v"), F.col("u")).where("u <> v")).distinct())
    steps = []
    for k in range(most):
        if e.isEmpty():
            break
        best = e.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.lit(k), "v").alias("h"), F.col("v").alias("to"))).alias("b"))
        own = F.struct(F.xxhash64(F.lit(k), "u").alias("h"), F.col("u").alias("to"))
        step = settled(best.select("u", F.least("b", own)["to"].alias("to")))
        steps.append(step)
        x = e.join(step, "u").select(F.col("to").alias("u"), "v")
        x = x.join(step.select(F.col("u").alias("v"), F.col("to").alias("w")), "v").select("u", F.col("w").alias("v")).where("u <> v").distinct()
        was, e = e, settled(x)
        released(was)
    else:
        raise RuntimeError("parts did not settle")
    out = None
    for step in reversed(steps):
        to = step if out is None else step.join(out.select(F.col("u").alias("to"), "grp"), "to", "left")
        out = settled(to.select("u", (F.col("to") if out is None else F.coalesce("grp", "to")).alias("grp")))
    alone = edges.select(F.col("u").alias("vertex")).union(edges.select("v")).distinct()
    return alone.select("vertex", F.col("vertex").alias("grp")) if out is None else alone.join(out.withColumnRenamed("u", "vertex"), "vertex", "left").select("vertex", F.coalesce("grp", "vertex").alias("grp"))


def by_group(edges: DataFrame, small: Callable[[list[tuple]], list[tuple]], large: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(vertex, ``name``) of a graph's edges (u, v): ``small`` answers a connected part from its list of edges, ``large``
    the parts with more than ``GATHERED`` edges by joins."""
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)["u"]
    g = groups_of(edges).withColumnRenamed("vertex", "u")
    e = settled(edges.join(g, "u").select("grp", "u", "v"))
    big = settled(e.groupBy("grp").agg(F.count("*").alias("k")).where(F.col("k") > GATHERED).select("grp"))
    out_type = kind if name == "component" else "long"

    def run(parts):
        held, group = [], None
        for p in parts:
            rows = []
            for g_, u, v in zip(p["grp"], p["u"], p["v"]):
                if g_ != group:
                    rows += small(held)
                    held, group = [], g_
                held.append((u, v))
            yield pd.DataFrame(rows, columns=["vertex", name])
        yield pd.DataFrame(small(held), columns=["vertex", name])

    few = e.join(big, "grp", "left_anti").repartition("grp").sortWithinPartitions("grp")
    out = few.mapInPandas(run, f"vertex {kind}, {name} {out_type}")
    if big.isEmpty():
        return out
    return out.unionAll(large(e.join(big, "grp", "left_semi").select("u", "v")).select("vertex", name))


def small_components(edges: list[tuple]) -> list[tuple]:
    """(vertex, component) of a small graph: a depth-first search with a stack."""
    after: dict = {}
    for u, v in edges:
        after.setdefault(u, []).append(v)
        after.setdefault(v, [])
    at, low, on, out = {}, {}, {}, []
    for root in after:
        if root in at:
            continue
        at[root] = low[root] = len(at)
        on[root], work = True, [(root, iter(after[root]))]
        path = [root]
        while work:
            x, rest = work[-1]
            y = next(rest, None)
            if y is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == at[x]:
                    part = [path.pop()]
                    while part[-1] != x:
                        part.append(path.pop())
                    first = min(part)
                    for z in part:
                        on[z] = False
                        out.append((z, first))
            elif y not in at:
                at[y] = low[y] = len(at)
                on[y] = True
                path.append(y)
                work.append((y, iter(after[y])))
            elif on[y]:
                low[x] = min(low[x], at[y])
    return out


def small_paths(edges: list[tuple]) -> list[tuple]:
    """(vertex, length) of ``longest_paths`` in a small graph, of which cycles are one vertex each."""
    of = dict(small_components(edges))
    after: dict = {}
    into: dict = {}
    for u, v in {(of[u], of[v]) for u, v in edges if of[u] != of[v]}:
        after.setdefault(u, []).append(v)
        into[v] = into.get(v, 0) + 1
    length = {x: 0 for x in after if x not in into}
    todo = list(length)
    for x in todo:  # grows
        for y in after.get(x, ()):
            length[y] = max(length.get(y, 0), length[x] + 1)
            into[y] -= 1
            if not into[y]:
                todo.append(y)
    return list(length.items())


def condensed_paths(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, length): ``longest_paths`` of ``condensed``."""
    e = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    return by_group(e, small_paths, lambda x: longest_paths(condensed(x.toDF("a", "b"), "a", "b"), "u", "v"), "length")


def strong_components(edges: DataFrame, a: str, b: str, most: int = 10_000) -> DataFrame:
    """(vertex, component): the smallest vertex of each vertex's strongly connected component, connected part by part."""
    e = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    return by_group(e, small_components, lambda x: trimmed_components(x, "u", "v", most), "component")


def trimmed_components(edges: DataFrame, a: str, b: str, most: int = 10_000) -> DataFrame:
    """(vertex, component): the smallest vertex of each vertex's strongly connected component.

    Vertices that nothing enters or leaves are trimmed, one layer after the other. Of the rest every vertex gets the
    smallest that reaches it forwards and backwards; where the two agree they are a component, and edges between vertices
    with different labels go, as no cycle has them.
    """
    e = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    done = settled(e.select(F.col("u").alias("vertex")).union(e.select("v")).distinct().withColumn("component", F.col("vertex")))
    e, found = settled(e.where("u <> v")), None
    for _ in range(most):
        while True:  # trim
            inner = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
            inner = settled(inner)
            if inner.count() == e.count():
                break
            e = inner
        if e.isEmpty():
            break
        forth, back = least_reaching(e), least_reaching(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        labels = settled(forth.join(back.select("vertex", F.col("label").alias("other")), "vertex"))
        part = settled(labels.where("label = other").select("vertex", F.col("label").alias("component")))
        found = part if found is None else found.unionAll(part)
        left = labels.select(F.col("vertex").alias("u"), F.struct("label", "other").alias("lu"))
        right = labels.select(F.col("vertex").alias("v"), F.struct("label", "other").alias("lv"))
        e = settled(e.join(left, "u").join(right, "v").where("lu = lv").join(part.select(F.col("vertex").alias("u")), "u", "left_anti").select("u", "v"))
    else:
        raise RuntimeError("components did not settle")
    if found is None:
        return done
    return done.select("vertex").join(found, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def condensed(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v): edges between strongly connected components, which have no cycle."""
    c = settled(strong_components(edges, a, b))
    u, v = (c.select(F.col("vertex").alias(x), F.col("component").alias(n)) for x, n in ((a, "u"), (b, "v")))
    return edges.select(a, b).join(u, a).join(v, b).where("u <> v").select("u", "v").distinct()


def closure(edges: DataFrame, a: str, b: str, most: int = 64) -> DataFrame:
    """(u, v): pairs that a path of one or more edges joins, by doubling the paths' lengths."""
    pairs = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    n = pairs.count()
    for _ in range(most):
        twice = pairs.select("u", F.col("v").alias("m")).join(pairs.select(F.col("u").alias("m"), "v"), "m").select("u", "v")
        more = settled(pairs.unionAll(twice).distinct())
        now = more.count()
        released(pairs)
        pairs = more
        if now == n:
            return pairs
        n = now
    raise RuntimeError("the closure did not settle")


def longest_paths(edges: DataFrame, a: str, b: str, most: int = 1_000_000) -> DataFrame:
    """(vertex, length): edges on the longest path that ends in each vertex of a graph without cycles (``condensed``).

    Layer by layer: a vertex goes in the round after the last that enters it, which is that length.
    """
    e = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    rest, out = settled(e.select(F.col("u").alias("vertex")).union(e.select("v")).distinct()), None
    for k in range(most):
        first = settled(rest.join(e.select(F.col("v").alias("vertex")).distinct(), "vertex", "left_anti").withColumn("length", F.lit(k).cast("long")))
        if first.isEmpty():
            if not rest.isEmpty():
                raise ValueError("the graph has a cycle")
            return out if out is not None else first
        out = first if out is None else out.unionAll(first)
        gone = first.select("vertex")
        was = rest, e
        rest = settled(rest.join(gone, "vertex", "left_anti"))
        e = settled(e.join(gone.withColumnRenamed("vertex", "u"), "u", "left_anti").select("u", "v"))
        released(*was)
    raise RuntimeError("paths are longer than that many edges")
