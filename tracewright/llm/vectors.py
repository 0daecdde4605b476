"""What searches over vectors share: classes of equal vectors, bounded samples, and units where queries meet candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_of_each
from .common import stored

#: Candidates and queries in a unit, and rows of a table of bucket sizes up to which it is broadcast (about 30 MB).
MEMBERS, ASKS, MOST_BROADCAST = 2048, 512, 500_000


def narrow(df: DataFrame, column: str) -> str:
    """The type that keeps the column's numbers as they are: floats stay floats, all others become doubles."""
    return "array<float>" if dict(df.dtypes).get(column) == "array<float>" else "array<double>"


def finite(vector: str) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf"))), F.lit(False))


def norm(vector: str) -> Column:
    """Euclidean length, scaled so that squares don't overflow."""
    peak = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.when(peak == 0, 0.0).otherwise(F.least(peak * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak))), F.lit(1e308)))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of lists of one length as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def by_length(b: pa.RecordBatch, column: str, rows: int = 1000) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of a batch whose vectors have one length each."""
    for k in range(0, b.num_rows, rows):
        piece = b.slice(k, rows)
        length = pc.list_value_length(piece.column(piece.schema.names.index(column))).to_numpy(zero_copy_only=False)
        for dim in np.unique(length).tolist():
            yield dim, piece.take(pa.array(np.nonzero(length == dim)[0])) if (length != dim).any() else piece


def keyed(rows: DataFrame, also: list[str] = []) -> DataFrame:
    """``rows`` with a 128-bit fingerprint (fp1, fp2) of the vector and the columns ``also``."""
    return rows.select("*", *[F.xxhash64(F.lit(s), *also, "vector").alias(f"fp{s}") for s in (1, 2)])


def classes(rows: DataFrame, most: int, also: list[str] = []) -> DataFrame:
    """(fp1, fp2, vector, ids, and ``also``): rows with equal vectors are one class with its ``most`` smallest ids."""
    first = top_of_each(rows.select("fp1", "fp2", "vec_id").distinct(), ["fp1", "fp2"], most, "vec_id", salt="vec_id")
    ids = first.groupBy("fp1", "fp2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    one = rows.groupBy("fp1", "fp2").agg(F.first("vector").alias("vector"), *[F.first(c).alias(c) for c in also])
    return one.join(ids, ["fp1", "fp2"])


def samples(rows: DataFrame, lengths: dict[int, int], most: int, *also: str) -> dict[int, list]:
    """About ``most`` distinct vectors of each length with the columns ``also``, by a hash of the vector."""
    share = F.element_at(F.create_map(*[F.lit(x) for dim, n in lengths.items() for x in (dim, min(1.0, most / n))]), F.size("vector")) if lengths else F.lit(0.0)
    some = rows.where(F.pmod(F.xxhash64(F.lit(7), "fp1"), F.lit(1 << 40)) < share * float(1 << 40)).select("vector", *also).distinct()
    out: dict[int, list] = {dim: [] for dim in lengths}
    for r in some.collect():  # about ``most`` rows a length
        out[len(r.vector)].append(r)
    return out


def met(members: DataFrame, asks: DataFrame, key: list[str], parts: int) -> DataFrame:
    """Members (id, ...) and asks (ask, ...) of one ``key`` in units of bounded size, sorted by ``unit``; ``asks`` tells
    them apart. Large keys are split by hashes into blocks on both sides, every block of one with every block of the
    other; members that nobody asks for stay where they are."""
    size = stored(members.groupBy(*key).agg(F.count("*").alias("n")).join(asks.groupBy(*key).agg(F.count("*").alias("m")), key), "sizes")
    blocks = size.select(*key, F.ceil(F.col("n") / MEMBERS).cast("int").alias("_n"), F.ceil(F.col("m") / ASKS).cast("int").alias("_m"))
    blocks = F.broadcast(blocks) if size.count() <= MOST_BROADCAST else blocks
    sides = []
    for df, own, across, id in ((members, "_n", "_m", "id"), (asks, "_m", "_n", "ask")):
        dealt = df.join(blocks, key).withColumn("_own", F.pmod(F.xxhash64(id), F.col(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(across) - 1)))
        unit = F.xxhash64(*key, *(("_own", "_other") if id == "id" else ("_other", "_own")))
        sides.append(dealt.withColumn("unit", unit).withColumn("asks", F.lit(id == "ask")).drop("_n", "_m", "_own", "_other"))
    return sides[0].unionByName(sides[1], allowMissingColumns=True).repartition(parts, "unit").sortWithinPartitions("unit")
