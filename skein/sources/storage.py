"""Tables that cut lineage: written in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows up to which a side is broadcast; beyond, Spark joins without a hint.
BROADCAST_ROWS = 500_000


def counted(side: DataFrame, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """The side, whole, with a broadcast hint if it has few rows, by count."""
    return F.broadcast(side) if side.count() <= at_most else side


def running(df: DataFrame, order: list, value: str) -> DataFrame:
    """The rows with number (from 1) and running (the sum of value up to the row) by a total order over all rows.

    Rows are ranged by the order and written once; a range counts for itself, and the ranges' bases are a row each.
    """
    laid = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    own = laid.withColumns({"number": F.row_number().over(w), "running": F.sum(value).over(w)})
    return own.join(F.broadcast(bases), "_part").withColumns({"number": F.col("number") + F.col("_n"), "running": F.col("running") + F.col("_s")}).drop("_part", "_n", "_s")


def written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="skein-tables-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
