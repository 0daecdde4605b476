"""Sends this package to Python workers that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent
#: Rows that a worker holds at once, and the setting of a batch's rows.
ROWS, BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each context; Spark's file server spreads it.

    Arrow batches get ``ROWS`` rows where the session has not set another number.
    """
    if spark.conf.get(BATCH) == "10000":  # Spark's own number, which makes batches of long texts large
        spark.conf.set(BATCH, str(ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    to = Path(tempfile.mkdtemp()) / f"{HERE.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, p.relative_to(HERE.parent))
    sc.addPyFile(str(to))
    sc._tracewright_shipped = True


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with the package at hand in the workers, and in batches of ``ROWS`` rows at most."""
    ship(df.sparkSession)

    def sliced(batches: Iterator) -> Iterator:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                yield b.slice(k, ROWS)

    return df.mapInArrow(lambda batches: run(sliced(batches)), schema)
