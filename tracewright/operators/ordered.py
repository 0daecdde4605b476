"""Ranks and running sums over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled


def numbered(df: DataFrame, *order: Column | str, running: str | None = None, groups: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (1, 2, ... in the order given) and, of a column, the ``running`` sum up to each row.

    Rows are dealt to ranges of the order and ranked inside them; the ranges' sizes (one row each) put them end to end.
    Rows that tie in the order may take each other's places.
    """
    n = groups or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.col(running).cast("long") if running else F.lit(0).cast("long")
    # Stored, as ranges found anew could differ.
    r = settled(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).withColumn("_weight", weight))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_weight").alias("w"))  # one row a range
    starts = F.broadcast(sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("_w")))
    inside = Window.partitionBy("_range").orderBy(*order)
    out = r.join(starts, "_range").withColumn("rank", (F.col("_n") + F.row_number().over(inside)).cast("long"))
    if running:
        out = out.withColumn("running", F.col("_w") + F.sum("_weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_range", "_weight", "_n", "_w")


def top_of_each(df: DataFrame, by: list[str], most: int, *order: Column | str, salt: str, salts: int = 64) -> DataFrame:
    """The first ``most`` rows of each group with their ``rank``; groups are cut by a hash of ``salt`` first, so that no
    task gathers a large one."""
    part = F.pmod(F.xxhash64(salt), F.lit(salts))
    first = df.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("rank") <= most).drop("_part", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
