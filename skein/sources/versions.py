"""Versions of stored tables: steps bring a table from one to the next, each written before its number is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def add_column(name: str, kind: str, value: str | None = None) -> Step:
    """A step that adds a column of a type and a value as SQL, null without one. A table that has the column is left as it is."""
    return lambda df: df if name in df.columns else df.withColumn(name, (F.expr(value) if value else F.lit(None)).cast(kind))


def version(spark: SparkSession, folder: str) -> int:
    """The number of the last step whose table is whole: folder/v=N has its success mark. 0 without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and p.getName()[2:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=0)


def migrate(spark: SparkSession, folder: str, steps: dict[int, Step], start: DataFrame | None = None) -> int:
    """Applies the steps above the table's version in ascending order, each read from folder/v=N and written to the next one; gives the version reached.

    start is the table of version 0. A step that stops half-way leaves no success mark, so that the next call takes it again from the last whole table.
    """
    at = version(spark, folder)
    for n in sorted(k for k in steps if k > at):
        if at == 0 and start is None:
            raise ValueError("a table of version 0 needs its rows")
        rows = start if at == 0 else spark.read.parquet(f"{folder}/v={at}")
        steps[n](rows).write.mode("overwrite").parquet(f"{folder}/v={n}")
        at = n
    return at
