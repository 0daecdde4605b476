"""Hard negatives by one-dimensional distance keys: exact top-k by inner product within a range of scores.

Vectors x get one more component, sqrt(L^2 - |x|^2) with L the largest length, and an anchor q gets 0 there, so that the
squared distance is |q|^2 + L^2 - 2 (q, x). Each vector belongs to its nearest pivot; the table is stored sorted by
(pivot, distance), and the distances of a pivot are cut into slices of one width. A vector at most r away from the
anchor has a key within r of the anchor's own distance to the pivot, so a search of radius r reads the slices of an
annulus around every pivot. The radius grows from round to round, each reading only new slices; a search ends when its
k-th score is at least what a vector beyond the nearest unread slice could have (or the range's lower end is), which
makes the result exact. The radius that surely does is known from a sample of the vectors, whose k-th score is a lower
bound of all vectors' k-th score; that bound also keeps what a slice returns short.

Searches of positives want the anchor's label; searches of negatives want other labels and scores in a range, and
begin at the range's upper end. Rows of equal label and vector are one class with its smallest ids. Slices meet the
searches in units of bounded size.

Nulls: a row with a null id, label or vector, an empty vector, or a null or non-finite component takes no part. Only
vectors of one length are compared. Products are exact; those beyond 64 bits are held at the ends of that range, as is a
component. Rows that repeat id, label and vector count once; rows that repeat an id otherwise are rows of their own, but
none is a positive of its own id. An anchor without other rows of its label gives no rows, nor does a positive without
negatives. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import parts_of, popular_join, runs, stored
from .vectors import by_length, classes, finite, keyed, met, samples

POSITIVES, NEGATIVES, PIVOTS, FIT = 5, 3, 16, 4096
#: Radii of the rounds as shares of the radius that is known to do.
RADII = (0.7, 0.85, 1.0)
#: Negatives score from 50 to 95 hundredths of the positive's score.
LOW, HIGH = 50, 95
MOST = np.iinfo(np.int64).max


def whole(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of lists of whole numbers of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``."""
    most = [int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    big = a.astype(object) @ b.astype(object).T
    return np.clip(big, -MOST, MOST).astype(np.int64)


class Keys:
    """Pivots and slices for vectors of one length whose largest norm is ``top``."""

    def __init__(self, sample: list, top: float, n: int):
        self.top = max(top, 1.0)
        self.labels = np.array([r.label for r in sample], np.int64)
        self.x = np.array([r.vector for r in sample], np.int64).reshape(len(sample), -1)
        wide, self.pivots = self.augmented(self.x), np.zeros((0, self.x.shape[1] + 1))
        near = np.full(len(wide), np.inf)
        for _ in range(min(PIVOTS, len(wide))):  # each the one farthest from those before
            p = wide[int(near.argmax())]
            near = np.minimum(near, np.sqrt(((wide - p) ** 2).sum(axis=1)))
            self.pivots = np.concatenate([self.pivots, p[None]])
        _, d = self.placed(self.x)
        spread = float(np.quantile(d, 0.99) - np.quantile(d, 0.01)) if len(d) else 0.0
        self.width = max(spread / max(1.0, np.sqrt(n) / PIVOTS), self.top * 1e-6)
        self.ends = np.zeros((len(self.pivots), 2), np.int64)  # each pivot's first and last slice, set by ``index``

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64) / self.top
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def away(self, wide: np.ndarray) -> np.ndarray:
        """Distances to every pivot, in units of ``top``."""
        return np.stack([np.sqrt(((wide - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.away(self.augmented(x)) * self.top
        pivot = d.argmin(axis=1)
        return pivot, d[np.arange(len(d)), pivot]

    def slices(self, d: np.ndarray) -> np.ndarray:
        return np.floor(d / self.width).astype(np.int64)

    def radius(self, q: np.ndarray, score: float) -> float:
        """Distance from an anchor at which vectors have this score."""
        q = q.astype(np.float64)
        return float(np.sqrt(max(0.0, (q * q).sum() + self.top * self.top - 2.0 * score)))

    def bound(self, q: np.ndarray, label: int, same: bool, low: int, high: int, k: int) -> int:
        """The k-th score of the sample in the range, or the range's lower end."""
        s = products(q[None], self.x)[0]
        s = np.sort(s[((self.labels == label) == same) & (s >= low) & (s <= high)])[::-1]
        return int(s[k - 1]) if len(s) >= k else low

    def read(self, q: np.ndarray, radius: float, inner: float) -> list[tuple[int, int, int]]:
        """(pivot, first slice, last slice) of the annuli within ``radius`` whose vectors can be ``inner`` or more away."""
        q = q.astype(np.float64) / self.top
        d = self.away(np.append(q, 0.0)[None])[0] * self.top
        slack = 1e-9 * (self.top + (radius if radius < np.inf else 0.0))
        out = []
        for p, x in enumerate(d.tolist()):
            a = int(self.slices(np.array(max(0.0, x - radius, inner - x) - slack).clip(0)))
            z = int(self.slices(np.array(min(x + radius + slack, 1e300)))) if radius < np.inf else MOST
            a, z = max(a, int(self.ends[p, 0])), min(z, int(self.ends[p, 1]))
            if a <= z:
                out.append((p, a, z))
        return out

    def beyond(self, q: np.ndarray, read: list[tuple[int, int, int]], inner: float) -> float:
        """The least distance of a vector that lies in none of the slices read and can be ``inner`` or more away."""
        whole = {p: (a, z) for p, a, z in self.read(q, np.inf, inner)}
        d = self.away(np.append(q.astype(np.float64) / self.top, 0.0)[None])[0] * self.top
        taken, least = {p: (a, z) for p, a, z in read}, np.inf
        for p, (a, z) in whole.items():
            if p not in taken:
                least = min(least, max(0.0, a * self.width - d[p], d[p] - (z + 1) * self.width))
                continue
            if taken[p][0] > a:
                least = min(least, d[p] - taken[p][0] * self.width)
            if taken[p][1] < z:
                least = min(least, (taken[p][1] + 1) * self.width - d[p])
        return float(least)


def index(rows: DataFrame, keep: int, parts: int) -> tuple[DataFrame, dict[int, Keys]]:
    """The classes stored sorted by (pivot, distance), with their slices, and the keys of each vector length."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    about = {r.dim: r for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("top")).collect()}  # a row a length
    sample = samples(rows, {dim: r.n for dim, r in about.items()}, FIT, "label")
    keys = {dim: Keys(sample[dim], r.top, r.n) for dim, r in about.items() if sample[dim]}
    for dim in [d for d in about if d not in keys]:  # a length of which the hash has chosen none: any of its rows
        keys[dim] = Keys(rows.where(F.size("vector") == dim).select("vector", "label").limit(PIVOTS).collect(), about[dim].top, about[dim].n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in by_length(b, "vector"):
                k = keys[dim]
                pivot, d = k.placed(whole(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), dim, np.int32)), *part.columns, pa.array(pivot.astype(np.int32)), pa.array(d), pa.array(k.slices(d))], names=["dim", "vector", "label", "ids", "pivot", "distance", "slice"])

    one = classes(rows, keep, ["label"]).select("vector", "label", "ids")
    placed = mapped(one, place, "dim int, vector array<long>, label long, ids array<long>, pivot int, distance double, slice long")
    placed = placed.repartitionByRange(parts, "dim", "pivot", "distance").sortWithinPartitions("dim", "pivot", "distance")
    placed = stored(placed.select(F.monotonically_increasing_id().alias("id"), F.element_at("ids", 1).alias("first"), "*"), "keys")
    for r in placed.groupBy("dim", "pivot").agg(F.min("slice").alias("a"), F.max("slice").alias("z")).collect():  # a row a pivot
        keys[r.dim].ends[r.pivot] = r.a, r.z
    for k in keys.values():
        k.ends[k.ends[:, 1] < k.ends[:, 0]] = 1, 0
    return placed, keys


def top_of(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "first", "id"))).where(F.col("nth") <= k).drop("nth")


def search(placed: DataFrame, keys: dict[int, Keys], asks: DataFrame, same: bool, k: int, parts: int) -> DataFrame:
    """(ask, id, first, score): the ``k`` best classes of each ask (ask, vector, label, low, high) among those of the
    same or of other labels, with scores from ``low`` to ``high``."""
    fields = "ask long, vector array<long>, label long, low long, high long"

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [keys[len(q)].bound(np.array(q, np.int64), label, same, low, high, k) for q, label, low, high in zip(*(b.column(c).to_pylist() for c in ("vector", "label", "low", "high")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=[*b.schema.names, "bound"])

    asks = stored(mapped(asks.select("ask", "vector", "label", "low", "high").repartition(parts), bounded, f"{fields}, bound long"), "asks")

    def spans(q: list, low: int, high: int, bound: int, turn: int) -> tuple[np.ndarray, Keys, float, list]:
        v, key = np.array(q, np.int64), keys[len(q)]
        inner = key.radius(v, high) * (1 - 1e-9) if high < MOST else 0.0
        return v, key, inner, key.read(v, RADII[turn] * key.radius(v, bound) * (1 + 1e-9), inner)

    def probes(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for ask, q, low, high, bound in zip(*(b.column(c).to_pylist() for c in ("ask", "vector", "low", "high", "bound"))):
                    before = {p: (a, z) for p, a, z in spans(q, low, high, bound, turn - 1)[3]} if turn else {}
                    for p, a, z in spans(q, low, high, bound, turn)[3]:
                        was = before.get(p, (z + 1, z))
                        rows += [(ask, len(q), p, s) for s in range(a, z + 1) if not was[0] <= s <= was[1]]
                ask, dim, pivot, cut = np.array(rows, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([pa.array(ask), pa.array(dim.astype(np.int32)), pa.array(pivot.astype(np.int32)), pa.array(cut)], names=["ask", "dim", "pivot", "slice"])

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "unit"):
            asking = t.column("asks").to_numpy()
            m, a = t.filter(pa.array(~asking)), t.filter(pa.array(asking))
            if not m.num_rows or not a.num_rows:
                continue
            low, high, bound, label = (a.column(c).to_numpy()[:, None] for c in ("low", "high", "bound", "label"))
            s = products(whole(a.column("vector")), whole(m.column("vector")))
            ok = ((m.column("label").to_numpy()[None] == label) == same) & (s >= np.maximum(low, bound)) & (s <= high)
            first = m.column("first").to_numpy()
            if s.shape[1] > k:
                ok &= s >= np.partition(np.where(ok, s, -MOST), -k, axis=1)[:, -k][:, None]
            i, j = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(a.column("ask").to_numpy()[i]), pa.array(m.column("id").to_numpy()[j]), pa.array(first[j]), pa.array(s[i, j])], names=["ask", "id", "first", "score"])

    def still_open(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for q, low, high, bound, kth in zip(*(b.column(c).to_pylist() for c in ("vector", "low", "high", "bound", "kth"))):
                    v, key, inner, read = spans(q, low, high, bound, turn)
                    left, reach = key.beyond(v, read, inner), key.radius(v, max(low, bound) if kth is None else kth)
                    keep.append(left <= reach * (1 + 1e-9) + 1e-9 * key.top)
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    found, open_ = None, asks
    for turn in range(len(RADII)):
        ways = stored(mapped(open_.select("ask", "vector", "low", "high", "bound"), probes(turn), "ask long, dim int, pivot int, slice long"), "probes")
        question = ways.join(open_.select("ask", "vector", "label", "low", "high", "bound"), "ask")
        hits = mapped(met(placed.select("id", "dim", "pivot", "slice", "first", "vector", "label"), question, ["dim", "pivot", "slice"], parts), scan, "ask long, id long, first long, score long")
        found = stored(top_of(hits if found is None else found.union(hits), k), "found")
        if turn + 1 < len(RADII):
            kth = found.groupBy("ask").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("ask", "kth")
            names = [*open_.columns] if turn == 0 else asks.columns
            rest = mapped(open_.select(*names).join(kth, "ask", "left"), still_open(turn), f"{fields}, bound long, kth long").drop("kth")
            open_ = stored(rest, "open")
            if open_.isEmpty():
                break
    return found


def mine(vectors: DataFrame, anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (by default rows
    whose vec_id is divisible by 50) and each of its best rows of the same label, the best rows of other labels that
    score from 50 to 95 hundredths of the positive."""
    parts, is_anchor = parts_of(vectors), F.col("vec_id") % 50 == 0 if anchors is None else anchors
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = keyed(rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * 256)).alias("vector"), relabelled.alias("label")), ["label"])
    placed, keys = index(rows, max(positives + 1, negatives), parts)
    if not keys:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    own = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "fp1", "fp2").distinct()
    # An anchor's class is found by label and vector.
    named = keyed(placed.select("id", "vector", "label"), ["label"])
    asked = stored(named.join(own.select("fp1", "fp2").distinct(), ["fp1", "fp2"]).select(F.col("id").alias("ask"), F.struct("fp1", "fp2").alias("fp"), "vector", "label"), "anchors")
    near = search(placed, keys, asked.select("ask", "vector", "label", F.lit(-MOST).alias("low"), F.lit(MOST).alias("high")), True, positives + 1, parts)

    def with_ids(found: DataFrame) -> DataFrame:  # one row an ask, of at most k classes with few ids each
        return found.join(placed.select("id", "ids"), "id").groupBy("ask").agg(F.collect_list(F.struct("score", "ids")).alias("found"))

    anchors_ = popular_join(own.select("anchor_id", F.struct("fp1", "fp2").alias("fp")), asked.join(with_ids(near), "ask").select("fp", "ask", "found"), "fp")
    pairs = anchors_.select("anchor_id", "ask", F.explode("found").alias("_f")).select("anchor_id", F.col("ask").alias("of"), F.col("_f.score").alias("positive_score"), F.explode("_f.ids").alias("positive_id")).where("positive_id <> anchor_id")
    nth = F.row_number().over(Window.partitionBy("anchor_id", "of").orderBy(F.desc("positive_score"), "positive_id"))
    pairs = stored(pairs.withColumn("_nth", nth).where(F.col("_nth") <= positives).drop("_nth"), "positives")
    # Anchors of one class whose positives score alike ask once.
    wanted = stored(pairs.where("positive_score >= 0").select("of", "positive_score").distinct().select(F.monotonically_increasing_id().alias("ask"), "*"), "wanted")
    low, high = F.expr(f"cast(({LOW}bd * positive_score + 99) div 100 as bigint)"), F.expr(f"cast(({HIGH}bd * positive_score) div 100 as bigint)")
    ranged = wanted.join(asked.select(F.col("ask").alias("of"), "vector", "label"), "of").select("ask", "vector", "label", low.alias("low"), high.alias("high")).where("low <= high")
    far = with_ids(search(placed, keys, ranged, False, negatives, parts)).join(wanted, "ask").select(F.struct("of", "positive_score").alias("key"), "found")
    out = popular_join(pairs.select("anchor_id", "positive_id", F.struct("of", "positive_score").alias("key")), far, "key")
    out = out.select("anchor_id", "positive_id", "key", F.explode("found").alias("_f")).select("anchor_id", "positive_id", "key", F.col("_f.score").alias("negative_score"), F.explode("_f.ids").alias("negative_id"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "key").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", F.col("key.positive_score").alias("positive_score"), "negative_score")
