"""Architecture rules from a JSON file, as the table that overview.rule_violations takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RULE = "struct<name:string,components:array<string>,mayDependOn:array<string>,mayBeUsedBy:array<string>,acyclic:boolean,because:string>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, components, may_depend_on, may_be_used_by, acyclic, because) of {"invariants": [...]}; a list that isn't there is null, an empty one allows nothing. A rule without any of the three says nothing and is an error."""
    r = spark.read.schema(f"invariants array<{_RULE}>").json(path, multiLine=True).select(F.explode("invariants").alias("r"))
    says = F.col("r.mayDependOn").isNotNull() | F.col("r.mayBeUsedBy").isNotNull() | F.coalesce("r.acyclic", F.lit(False))
    name = F.when(says, F.col("r.name")).otherwise(F.raise_error(F.concat(F.lit("a rule that says nothing: "), F.coalesce("r.name", F.lit("without name")))))
    return r.select(
        name.alias("rule"),
        F.coalesce("r.components", F.array().cast("array<string>")).alias("components"),
        F.col("r.mayDependOn").alias("may_depend_on"),
        F.col("r.mayBeUsedBy").alias("may_be_used_by"),
        F.coalesce("r.acyclic", F.lit(False)).alias("acyclic"),
        F.col("r.because").alias("because"),
    )
