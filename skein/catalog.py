"""Registry of queries and the SQL that defines their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.sources import projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) under its name. sql may begin with further expressions of a WITH over the projected tables in uses."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH RECURSIVE {projection.ctes(*uses)}" + (", " if sql.lstrip().startswith("WITH") else " ") + sql.lstrip().removeprefix("WITH")) if uses else sql
        return f

    return add


class Graph:
    """The projected tables of a folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = projection.prepare(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        return projection.nodes(self.spark, self.sf_dir)

    @property
    def edges(self) -> DataFrame:
        return projection.edges(self.spark, self.sf_dir)

    @property
    def sites(self) -> DataFrame:
        return projection.edge_sites(self.spark, self.sf_dir)
