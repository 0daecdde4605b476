"""Pieces shared by the corpus operators: tables, the shared folder, links and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import mapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it; it then gets a folder of its own in /tmp/checkpoints.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to a table in the shared folder and read back: its lineage ends there.

    The files go by ``released`` or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(df: DataFrame) -> None:
    """Delete the table of a frame that ``stored`` gave and that nothing reads any more."""
    where, files = _files(df.sparkSession, df.stored_at)
    files.delete(where, True)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def parts_of(df: DataFrame) -> int:
    """Tasks for work that grows with ``df``: its partitions, or the session's number for shuffles if that is larger."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(taken: list[str], name: str) -> str:
    """``name``, or that with underscores before it, so that no column of ``taken`` has it in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def whole_text(col: str = "text") -> Column:
    """The text; a null text is the empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex of each vertex that has an edge: (vertex, component), both long.

    Large-star and small-star contraction (Kiveris et al., SoCC 2014) in joins: neighbours' minima are partial
    aggregates, so a hub never meets in one task unaggregated, and each round's edges are a table in the shared folder.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        was, e = e, stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        released(was)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("vertex"), "component").union(
        e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of n vertices, given links left[i]-right[i]."""
    low = np.arange(n)
    if not len(left):
        return low
    while True:
        was = low.copy()
        m = np.minimum(low[left], low[right])
        np.minimum.at(low, left, m)
        np.minimum.at(low, right, m)
        low = low[low]
        if np.array_equal(low, was):
            return low


def block_count(weight: Column, most: float, fair: float) -> Column:
    """Blocks of at most ``most`` of a bucket, or so many that their pairs are as many as fair shares of its weight."""
    return F.greatest(F.ceil(weight / F.lit(float(most))), F.ceil(F.sqrt(F.lit(2.0) * F.greatest(weight / F.lit(float(fair)) - 1, F.lit(0.0)) + 0.25) - 0.5), F.lit(1))


#: Weight of a bucket that is never split for balance alone.
SMALL = 8000.0


def in_units(members: DataFrame, id: str, bucket: list[str], most: float, parts: int, part: str) -> DataFrame:
    """Members of each bucket dealt to verification units of two blocks at most.

    ``members`` has the ``id``, ``weight``, the ``bucket`` columns and ``part``, a finer bucket whose pairs are done. A
    bucket over ``most``, or over a fair share of all weights for one of ``parts`` tasks, is split by a hash of the id
    into blocks; every pair of its blocks makes a unit, so that all pairs of a bucket meet in exactly one unit (pairs
    inside block b in unit (b, b)) and no task holds a whole hot bucket. For balance a bucket gets as many units as
    tasks would have its share of the weights. Buckets of one member or one ``part`` go, and so does a bucket that has
    exactly the members of another (the first of such buckets stays).
    Returns the id, the bucket and ``unit``, ``block``, ``b1``, ``b2``.
    """
    order = F.struct(*bucket)
    size = members.groupBy(*bucket).agg(
        F.count("*").alias("n_in"), F.sum("weight").alias("w_in"), (F.min(part) != F.max(part)).alias("new"),
        F.bit_xor(F.xxhash64(id, F.lit(1))).alias("set1"), F.bit_xor(F.xxhash64(id, F.lit(2))).alias("set2"),
    ).where("n_in > 1")
    size = stored(size.groupBy("n_in", "w_in", "set1", "set2").agg(F.min(order).alias("_b"), F.min("new").alias("new")).where("new").select("_b.*", "w_in"), "buckets")
    fair = max(SMALL, float(size.agg(F.sum("w_in")).first()[0] or 0) / parts)
    blocks = block_count(F.col("w_in"), most, fair)
    m = members.select(id, *bucket).join(size.select(*bucket, blocks.cast("int").alias("blocks")), bucket).withColumn("block", F.pmod(F.xxhash64(id, F.lit(3)), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return m.select(id, *bucket, low.alias("b1"), high.alias("b2"), "block", F.xxhash64(*bucket, low, high).alias("unit"))


def popular_join(left: DataFrame, right: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """Inner join of ``left`` with the one row that ``right`` has for each key.

    Keys that one in ``most`` rows of ``left`` or more have, so ``most`` keys at most, are joined by broadcast: no task
    gathers a popular key.
    """
    least = max(100, left.count() / most)
    hot = stored(left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key).coalesce(1), "popular")
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return left.join(F.broadcast(right.join(F.broadcast(hot), key)), key).select(*rest.columns).union(rest)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``column``, whatever the batches' borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(b.schema.names.index(column)).to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) of each element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
