"""Approximate nearest neighbours by inner product: a forest of random-projection trees, searched through one queue.

Vectors are divided by the largest length L and get one more component, sqrt(1 - |x|^2), so that the largest inner
product is the smallest distance. Each tree has orthogonal random directions, one a level; a node parts its vectors at
the median of their projections. A query's walk puts the far sides that it passes into one priority queue for all trees,
nearest first (by the squared margins passed so far, a lower bound of the distance in a tree's directions), and takes
leaves from it. Candidates of the leaves are scored exactly, in double precision.

Medians come from a sample of about ``FIT`` vectors; below the levels that it can tell, nodes take their level's median.
Every vector has its leaf in every tree. Trees have about the square root of n leaves, so that a query's way through
them and a leaf's scan grow alike. How many leaves a query takes is measured: the true neighbours of about ``CHECKED``
queries are found by scoring every vector, and the number of leaves is the least that holds ``TARGET`` of them. That
follows the data: clustered vectors need few leaves, vectors without structure a large part of them.

Equal vectors are one class with its smallest ids, which is all that a list of ``k`` can show. A first look at an eighth
of the leaves gives each query a bound, below which the rest returns nothing. Units of bounded size hold the candidates
and queries of a leaf.

Nulls: a vector that is null, empty or zero, or holds a null or non-finite component, takes no part, nor does a row with
a null id; a product too large for a double gives no candidate where it is no number. Only vectors of one length are
compared. Rows that repeat id and vector count once; rows that repeat an id with other vectors are candidates and
queries of their own, but none of those with its own id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import parts_of, popular_join, runs, stored
from .vectors import by_length, classes, finite, keyed, matrix, met, narrow, norm, samples

K, TREES, FIT, CHECKED, TARGET = 20, 4, 8192, 128, 0.95
#: Fewest sampled vectors that tell a node's median; deepest trees; and the share of the leaves in the first look.
LEAST, DEEPEST, FIRST = 32, 20, 8


class Forest:
    """Trees for vectors of one length whose largest norm is ``top``, with medians from a sample."""

    def __init__(self, dim: int, top: float, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.top, self.depth, self.trees = top, depth, trees
        lengths = np.sqrt(((sample / top) ** 2).sum(axis=1)) if len(sample) else np.ones(1)
        self.reach = max(float(np.median(lengths)), 1e-12)
        self.turns = []
        for _ in range(trees):
            turns = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0] for _ in range(-(-depth // (dim + 1)) or 1)]
            self.turns.append(np.concatenate(turns, axis=1)[:, :depth])
        self.cuts = [self._medians(self._placed(sample) @ w) for w in self.turns]

    def _placed(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def _medians(self, p: np.ndarray) -> list[np.ndarray]:
        """For each level the cut of each of its nodes."""
        node, out = np.zeros(len(p), np.int64), []
        for level in range(self.depth):
            cuts = np.full(1 << level, np.median(p[:, level]) if len(p) else 0.0)
            order = np.argsort(node, kind="stable")
            seen, at, n = np.unique(node[order], return_index=True, return_counts=True)
            for v, a, k in zip(seen.tolist(), at.tolist(), n.tolist()):
                if k >= LEAST:
                    cuts[v] = np.median(p[order[a : a + k], level])
            out.append(cuts)
            node = 2 * node + (p[:, level] > cuts[node])
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        x, out = self._placed(x), np.zeros((len(x), self.trees), np.int32)
        for t, (turn, cuts) in enumerate(zip(self.turns, self.cuts)):
            p, node = x @ turn, np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (p[:, level] > cuts[level][node])
            out[:, t] = node
        return out

    def search(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) of all trees, nearest first."""
        q = query / np.sqrt(((query / np.abs(query).max()) ** 2).sum()) / np.abs(query).max() * self.reach
        sides = [(q @ turn[:-1]).tolist() for turn in self.turns]
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        while queue:
            bound, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = sides[t][level] - float(self.cuts[t][level][node])
                near = int(margin > 0)
                level += 1
                heapq.heappush(queue, (bound + margin * margin, t, level, 2 * node + 1 - near))
                node = 2 * node + near
            yield t, node


def best(score: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's ``k`` largest scores that reach its bound, with those that tie by rounding."""
    low = bound
    if score.shape[1] > k:
        low = np.maximum(low, np.partition(score, -k, axis=1)[:, -k])
    with np.errstate(invalid="ignore"):
        slack = 1e-12 * np.abs(score).max(axis=1)
        return np.nonzero(score >= (low - np.where(np.isfinite(slack), slack, 0.0))[:, None])


def scored(units: DataFrame, k: int) -> DataFrame:
    """(ask, id, first, score) of each unit's best ``k`` for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "unit"):
            asking = t.column("asks").to_numpy()
            m, a = t.filter(pa.array(~asking)), t.filter(pa.array(asking))
            if not m.num_rows or not a.num_rows:
                continue
            x, q = matrix(m.column("vector")), matrix(a.column("vector"))
            with np.errstate(over="ignore", invalid="ignore"):
                i, j = best(np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf), k, a.column("bound").to_numpy())
                score = (q[i] * x[j]).sum(axis=1)
            real = ~np.isnan(score)
            yield pa.RecordBatch.from_arrays([pa.array(a.column("ask").to_numpy()[i][real]), pa.array(m.column("id").to_numpy()[j][real]), pa.array(m.column("first").to_numpy()[j][real]), pa.array(score[real])], names=["ask", "id", "first", "score"])

    return mapped(units, run, "ask long, id long, first long, score double")


def top_classes(hits: DataFrame, k: int) -> DataFrame:
    """Each query's best ``k`` classes, ties to the smaller first id; a class can come from several trees."""
    once = hits.groupBy("ask", "id").agg(F.max("first").alias("first"), F.max("score").alias("score"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "first", "id"))).where(F.col("nth") <= k)


def truth(placed: DataFrame, checked: dict[int, list], k: int, trees: int) -> DataFrame:
    """(ask, leaves): in which leaves the true ``k`` best of each checked query lie, by scoring every class."""
    asks = {dim: (np.array([r.id for r in rows], np.int64), np.array([r.vector for r in rows], np.float64)) for dim, rows in checked.items() if rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for dim, part in by_length(b, "vector"):
                if dim not in asks:
                    continue
                ids, q = asks[dim]
                own, first = part.column(0).to_numpy(), part.column(1).to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.nan_to_num(q @ matrix(part.column(2)).T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                score[ids[:, None] == own[None, :]] = -np.inf
                new = (score, np.tile(own, (len(q), 1)), np.tile(first, (len(q), 1)), np.tile(matrix(part.column(3)).astype(np.int32)[None], (len(q), 1, 1)))
                if dim in held:
                    new = tuple(np.concatenate([x, y], axis=1) for x, y in zip(held[dim], new))
                keep = np.argsort(-new[0], axis=1, kind="stable")[:, :k]
                held[dim] = tuple(np.take_along_axis(x, keep if x.ndim == 2 else keep[..., None], axis=1) for x in new)
        for dim, (score, own, first, leaves) in held.items():
            rows = np.isfinite(score)
            ask = np.repeat(asks[dim][0], score.shape[1]).reshape(score.shape)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(rows.sum() + 1, dtype=np.int32) * trees), pa.array(leaves[rows].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ask[rows]), pa.array(own[rows]), pa.array(first[rows]), pa.array(score[rows]), flat], names=["ask", "id", "first", "score", "leaves"])

    got = mapped(placed.select("id", "first", "vector", "leaves"), run, "ask long, id long, first long, score double, leaves array<int>")
    ranked = got.withColumn("nth", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "first"))).where(F.col("nth") <= k)
    return ranked.groupBy("ask").agg(F.collect_list("leaves").alias("leaves"))


def needed(placed: DataFrame, queries: DataFrame, forests: dict[int, Forest], counts: dict[int, int], k: int, checked: int, target: float) -> dict[int, int]:
    """For each length the number of leaves that hold ``target`` of the checked queries' true neighbours."""
    share = F.element_at(F.create_map(*[F.lit(x) for dim, n in counts.items() for x in (dim, min(1.0, checked / n))]), F.col("dim"))
    chosen = queries.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 40)) < share * float(1 << 40)).select("id", "dim", "vector")
    by_dim: dict[int, list] = {dim: [] for dim in counts}
    for r in chosen.collect():  # about ``checked`` rows a length
        by_dim[r.dim].append(r)
    asks = {r.id: (r.dim, np.array(r.vector, np.float64)) for rows in by_dim.values() for r in rows}
    trees = next(iter(forests.values())).trees

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ask, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                dim, q = asks[ask]
                open_ = {}
                for n, leaves in enumerate(lists):
                    for t, leaf in enumerate(leaves):
                        open_.setdefault((t, leaf), []).append(n)
                at: dict[int, int] = {}
                for visit, place in enumerate(forests[dim].search(q), 1):
                    for n in open_.pop(place, ()):
                        at.setdefault(n, visit)
                    if len(at) == len(lists):
                        break
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), pa.array(list(at.values()), pa.int64())], names=["dim", "visit"])

    found = mapped(truth(placed, by_dim, k, trees).repartition(max(8, len(asks) // 4)), walk, "dim int, visit long").groupBy("dim").agg(F.array_sort(F.collect_list("visit")).alias("visits"))
    at = {r.dim: r.visits for r in found.collect()}  # checked * k numbers a length
    every = {dim: trees << f.depth for dim, f in forests.items()}
    return {dim: at[dim][min(len(at[dim]) - 1, int(np.ceil(target * len(at[dim]))) - 1)] if at.get(dim) else every[dim] for dim in counts}


def neighbours(vectors: DataFrame, queries: Column | None = None, k: int = K, trees: int = TREES, target: float = TARGET, checked: int = CHECKED, fit: int = FIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that is a query (by default those whose
    vec_id is divisible by 20), by inner product among all other rows."""
    spark, parts = vectors.sparkSession, parts_of(vectors)
    asked = F.col("vec_id") % 20 == 0 if queries is None else queries
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(narrow(vectors, "embedding")).alias("vector"))
    rows = keyed(rows.where(F.col("vec_id").isNotNull() & finite("vector")).where(F.exists("vector", lambda x: x != 0)))
    about = {r.dim: r for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(norm("vector")).alias("top"), F.sum(asked.cast("int")).alias("m")).collect()}  # a row a length
    if not about:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = samples(rows, {dim: r.n for dim, r in about.items()}, fit)
    forests = {
        dim: Forest(dim, r.top, np.array([x.vector for x in sample[dim]], np.float64).reshape(-1, dim), int(np.clip(round(np.log2(r.n) / 2), 0, DEEPEST)), trees) for dim, r in about.items()
    }

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in by_length(b, "vector"):
                leaves = forests[dim].leaves(matrix(part.column(2)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * trees), pa.array(leaves.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], names=["fp1", "fp2", "vector", "ids", "leaves"])

    kind = dict(rows.dtypes)["vector"]
    placed = mapped(classes(rows, k + 1).select("fp1", "fp2", "vector", "ids"), place, f"fp1 long, fp2 long, vector {kind}, ids array<long>, leaves array<int>")
    placed = stored(placed.select(F.monotonically_increasing_id().alias("id"), F.size("vector").alias("dim"), F.element_at("ids", 1).alias("first"), "*"), "placed")
    own = rows.where(asked).select(F.col("vec_id").alias("query_id"), "fp1", "fp2").distinct()
    asks = stored(placed.join(own.select("fp1", "fp2").distinct(), ["fp1", "fp2"]).select(F.col("id"), "dim", "vector", "fp1", "fp2"), "asks")
    counts = {r.dim: r.n for r in asks.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = needed(placed, asks, forests, counts, k, checked, target)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in by_length(b, "vector", 100):
                most, rows = visits[dim], []
                for ask, q in zip(part.column(0).to_pylist(), matrix(part.column(1))):
                    rows += [(ask, n, *place) for n, place in zip(range(most), forests[dim].search(q))]
                ask, n, tree, leaf = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(ask), pa.array(np.full(len(ask), dim, np.int32)), pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(n < max(trees, most // FIRST))], names=["ask", "dim", "tree", "leaf", "early"])

    way = stored(mapped(asks.select("id", "vector").repartition(parts), walk, "ask long, dim int, tree int, leaf int, early boolean"), "visits")
    members = placed.select("id", "dim", "first", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    question = asks.select(F.col("id").alias("ask"), "vector")
    key, most = ["dim", "tree", "leaf"], k + 1
    early = way.where("early").drop("early").join(question, "ask").withColumn("bound", F.lit(float("-inf")))
    hits = stored(scored(met(members, early, key, parts), most), "hits")
    bound = top_classes(hits, most).where(F.col("nth") == most).select("ask", F.col("score").alias("bound"))
    late = way.where("not early").drop("early").join(question.join(bound, "ask", "left"), "ask").fillna(float("-inf"), ["bound"])
    found = top_classes(hits.union(scored(met(members, late, key, parts), most)), most)
    shown = found.join(placed.select("id", "ids"), "id").groupBy("ask").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # k + 1 a query
    shown = stored(shown.join(asks.select(F.col("id").alias("ask"), "fp1", "fp2"), "ask").select(F.struct("fp1", "fp2").alias("fp"), "found"), "found")
    each = popular_join(own.select("query_id", F.struct("fp1", "fp2").alias("fp")), shown, "fp")
    each = each.select("query_id", "fp", F.explode("found").alias("_f")).select("query_id", "fp", "_f.score", F.explode("_f.ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "fp").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
