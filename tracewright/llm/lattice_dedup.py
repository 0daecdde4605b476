"""Embedding near-duplicates by E8 lattice hashing and exact cosines.

In each table a random orthogonal projection takes a unit vector to 8 numbers, scaled and decoded to the nearest point
of the E8 lattice; the vector lives in that cell and visits the neighbouring cells (of the 240 nearest lattice points)
that lie closest to it. Two vectors are candidates in a table if one lives where the other lives or visits. Sketches
(signs of random projections, compared with a wide margin) leave the memberships that have a possible partner in their
cell; those get the vectors, and every pair is verified by its cosine in double precision, in the first table and cell
that has it. Equal vectors are one class throughout. Hot cells are split into blocks, and blocks meet in pairs.

The scale follows the vectors' dimension and the threshold, so that the expected distance of a pair at the threshold is
the same in the lattice for all: with 10 tables and 8 neighbours it is missed with probability below 1e-4 at dimensions
from 2 on (measured at 2 to 24 on 20,000 pairs at cosine 0.95: a table has 0.65 to 0.67 of them).

Vectors of one length link among themselves: tables of different lengths are different tables.

Nulls: a vector that is null, empty or zero, or has a null or non-finite component, links with nothing, nor do vectors
of different lengths with each other; rows with a null id link with nothing. Rows that repeat an id and
vector count as copies; rows that repeat an id with another vector have each their own links. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import mapped
from .common import block_count, components, parts_of, popular_join, released, roots, runs, stored

THRESHOLD, TABLES, NEIGHBOURS = 0.95, 10, 8
#: Signs in a sketch, and the standard deviations that its bound leaves above the expected distance at the threshold.
SKETCH, MARGIN = 128, 6.0
#: Members of a cell's block, and of a cell that is never split for balance alone.
BLOCK, SMALL = 2048, 100


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum."""
    near = np.rint(y)
    odd = np.nonzero(near.sum(axis=1) % 2)[0]
    off = y[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8: of D8, or of D8 moved by a half in every coordinate."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, s, j, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for k, (i, s, j, t) in enumerate(pairs):
        whole[k, i], whole[k, j] = s, t
    half = np.array([v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0])
    return np.concatenate([whole, half])


def scale_for(dim: int, threshold: float) -> float:
    """A projection to 8 of ``dim`` numbers keeps 8 / dim of a squared distance; that at the threshold becomes 0.8."""
    return float(np.sqrt(max(dim, 8) * (1 - THRESHOLD) / max(1 - threshold, 1e-4)))


class Lattice:
    """Cells of unit vectors of one dimension, in every table."""

    def __init__(self, dim: int, tables: int = TABLES, neighbours: int = NEIGHBOURS, scale: float | None = None, threshold: float = THRESHOLD):
        scale = scale_for(dim, threshold) if scale is None else scale
        rng = np.random.default_rng(8)
        wide = max(dim, 8)
        self.turns = [np.linalg.qr(rng.normal(size=(wide, 8)))[0][:dim] * scale for _ in range(tables)]
        self.signs = rng.normal(size=(dim, SKETCH))
        self.weights = rng.integers(1, 1 << 62, 8, dtype=np.int64) * 2 + 1
        self.steps, self.neighbours = minimal_vectors(), neighbours

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Keys of each vector's cells: vectors x tables x (home, neighbours...)."""
        out = np.empty((len(unit), len(self.turns), 1 + self.neighbours), np.int64)
        step = self.hashed(self.steps)
        for t, turn in enumerate(self.turns):
            y = unit @ turn
            home = nearest_e8(y)
            out[:, t, 0] = self.hashed(home)
            close = np.argpartition(-((y - home) @ self.steps.T), self.neighbours, axis=1)[:, : self.neighbours]
            out[:, t, 1:] = out[:, t, :1] + step[close]
        return out

    def hashed(self, points: np.ndarray) -> np.ndarray:
        """A linear hash of lattice points (doubled coordinates), so that a neighbour's key is a sum."""
        return (np.rint(points * 2).astype(np.int64) * self.weights).sum(axis=1)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.uint64)


@lru_cache(maxsize=16)
def lattice_of(dim: int, tables: int, neighbours: int, scale: float | None, threshold: float) -> Lattice:
    """A worker's lattice of a dimension."""
    return Lattice(dim, tables, neighbours, scale, threshold)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; those so long or short that squares overflow are scaled first."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that can link."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def dealt(members: DataFrame, extra: list[str], parts: int) -> DataFrame:
    """Members (id, tab, cell, home, ...) of cells with a resident and a second member, in units of two blocks.

    A cell over BLOCK, or over a fair share of all members for one of ``parts`` tasks, is split into blocks; for balance
    alone into so many that it has as many units as tasks would have its share of the members.
    """
    size = members.groupBy("tab", "cell").agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived")
    size = stored(size.select("tab", "cell", "n"), "sizes")
    fair = max(SMALL, (size.agg(F.sum("n")).first()[0] or 0) / parts)
    blocks = block_count(F.col("n"), BLOCK, fair).cast("int")
    m = members.join(size.select("tab", "cell", blocks.alias("blocks")), ["tab", "cell"])
    m = m.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return m.select("id", "tab", "cell", "home", *extra, "block", low.alias("b1"), high.alias("b2"), F.xxhash64("tab", "cell", low, high).alias("unit"))


def by_unit(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "unit").sortWithinPartitions("unit")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, neighbours: int = NEIGHBOURS, scale: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept, class_id) of every row of ``vectors`` (vec_id, embedding)."""
    good = valid(vectors)
    # Classes have ids of their own, as rows may share a vec_id and differ in the vector.
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "vector", "first", "copies"), "vectors")
    parts = parts_of(vectors)
    angle = np.arccos(threshold) / np.pi
    far = int(np.ceil(SKETCH * angle + MARGIN * np.sqrt(SKETCH * angle * (1 - angle))))

    # Tables are numbered on from dimension to dimension, so that cells hold vectors of one length.
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                whole = b.slice(k, 1000)
                length = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False)
                for dim in np.unique(length).tolist():
                    part = whole.take(pa.array(np.nonzero(length == dim)[0])) if (length != dim).any() else whole
                    lattice, unit = lattice_of(dim, tables, neighbours, scale, threshold), units(matrix(part.column(1)))
                    cells, sketch = lattice.cells(unit), lattice.sketch(unit).view(np.int64)
                    n, times = len(unit), tables * (1 + neighbours)
                    row = np.repeat(np.arange(n), times)
                    tab = np.tile(np.repeat(np.arange(tables, dtype=np.int32) + np.int32(dim * tables), 1 + neighbours), n)
                    home = np.tile(np.arange(1 + neighbours) == 0, n * tables)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(tab), pa.array(cells.ravel()), pa.array(home), pa.array(sketch[row, 0]), pa.array(sketch[row, 1])], names=["id", "tab", "cell", "home", "s1", "s2"])

    members = stored(mapped(classes.select("id", "vector"), place, "id long, tab int, cell long, home boolean, s1 long, s2 long"), "cells")

    def halves(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block = t.column("block").to_numpy()
        b1, b2 = t.column("b1")[0].as_py(), t.column("b2")[0].as_py()
        return np.nonzero(block == b1)[0], np.nonzero(block == b2)[0]

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "unit"):
            a, z = halves(t)
            home, sketch = t.column("home").to_numpy(), np.stack([t.column(c).to_numpy() for c in ("s1", "s2")]).view(np.uint64)
            hit = np.zeros(len(home), bool)
            for k in range(0, len(a), 256):
                x = a[k : k + 256]
                bits = sum(np.bitwise_count(s[x][:, None] ^ s[z][None, :]).astype(np.int16) for s in sketch)
                near = (bits <= far) & (home[x][:, None] | home[z][None, :]) & (x[:, None] != z[None, :])
                hit[x] |= near.any(axis=1)
                hit[z] |= near.any(axis=0)
            keep = t.filter(pa.array(hit))
            for b in keep.select(["id", "tab", "cell", "home"]).to_batches():
                yield b

    some = mapped(by_unit(dealt(members, ["s1", "s2"], parts), parts), possible, "id long, tab int, cell long, home boolean").distinct()
    candidates = stored(some, "members")
    released(members)
    full = dealt(candidates, [], parts).join(classes.select("id", "copies", "vector"), "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "unit"):
            a, z = halves(t)
            if not len(a) or not len(z):
                continue
            ids, copies, home = (t.column(c).to_numpy() for c in ("id", "copies", "home"))
            (dim, tab), cell = divmod(t.column("tab")[0].as_py(), tables), t.column("cell")[0].as_py()
            unit = units(matrix(t.column("vector")))
            cells = lattice_of(dim, tables, neighbours, scale, threshold).cells(unit)[:, : tab + 1]
            links, lows, highs = np.zeros(len(ids)), [], []
            for k in range(0, len(a), 256):
                x = a[k : k + 256]
                i, j = np.nonzero((unit[x] @ unit[z].T >= threshold - 1e-12) & (home[x][:, None] | home[z][None, :]))
                i, j = x[i], z[j]
                # Inside one block each pair comes up twice.
                once = ids[i] < ids[j] if t.column("b1")[0].as_py() == t.column("b2")[0].as_py() else i != j
                i, j = i[once], j[once]
                cosine = (unit[i] * unit[j]).sum(axis=1)
                first = cosine >= threshold
                for s in range(tab + 1):  # the first table, and in it the first cell, that has the pair
                    hi, hj = cells[i, s, 0], cells[j, s, 0]
                    i_there, j_there = (cells[j, s, 1:] == hi[:, None]).any(axis=1), (cells[i, s, 1:] == hj[:, None]).any(axis=1)
                    if s < tab:
                        first &= ~((hi == hj) | i_there | j_there)
                    else:
                        first &= np.where(hi == hj, hi, np.where(i_there & j_there, np.minimum(hi, hj), np.where(i_there, hi, hj))) == cell
                i, j = i[first], j[first]
                links += np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
                lows.append(i)
                highs.append(j)
            order = np.argsort(ids, kind="stable")
            nth = np.empty(len(ids), np.int64)
            nth[order] = np.arange(len(ids))
            root = ids[order][roots(len(ids), nth[np.concatenate(lows)], nth[np.concatenate(highs)])][nth]
            has = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has].astype(np.int64)), pa.array(root[has])], names=["id", "links", "root"])

    links = stored(mapped(by_unit(full, parts), verify, "id long, links long, root long"), "links")
    total = links.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(links, "id", "root").join(classes.select(F.col("id").alias("vertex"), "first"), "vertex")
    lowest = group.groupBy("component").agg(F.min("first").alias("component_id"))
    group = group.join(lowest, "component").select(F.col("vertex").alias("id"), "component_id")
    named = classes.join(total, "id", "left").join(group, "id", "left").select(
        "vector", F.col("first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")
    )
    # Classes that are alone have the row's own values; the others are few columns, joined by id and a hash of the vector.
    named = stored(named.where("n_links > 0"), "named")
    member = popular_join(good.select("vec_id", F.xxhash64("vector").alias("key"), "vector"), named, "vector").select("vec_id", "key", "class_id", "n_links", "component_id").distinct()
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(F.col("embedding").cast("array<double>")).alias("key"))
    own = F.col("vec_id")
    return every.join(member, ["vec_id", "key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", own).alias("component_id"),
        F.coalesce(own == F.coalesce("component_id", own), F.lit(True)).alias("kept"), F.coalesce("class_id", own).alias("class_id"),
    )
