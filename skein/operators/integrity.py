"""Health reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: orphans, self_refs, repeated_ids, healthy, recommendation."""
    ids = nodes.select("id")
    e = edges.select("src", "dst", "kind")
    held = e.join(ids.withColumnRenamed("id", "src").distinct(), "src", "left_semi").join(ids.withColumnRenamed("id", "dst").distinct(), "dst", "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    n = ids.agg((F.count(F.lit(1)) - F.countDistinct("id")).alias("repeated_ids"))
    one = count(e, "all").crossJoin(count(held, "held")).crossJoin(count(e.where("src = dst AND kind = 'ref/call'"), "self_refs")).crossJoin(n)
    ok = F.expr("`all` = held AND self_refs = 0 AND repeated_ids = 0")
    return one.select((F.col("all") - F.col("held")).alias("orphans"), "self_refs", "repeated_ids", ok.alias("healthy"), F.when(ok, "none").otherwise("reindex").alias("recommendation"))


def registry_status(repos: DataFrame, indexed: DataFrame) -> DataFrame:
    """(repo_id, status) of registered repositories: not indexed, indexed, or an index that is missing."""
    i = indexed.select("repo_id").distinct().withColumn("found", F.lit(True))
    status = F.when(~F.col("has_index"), "NotIndexed").when(F.col("found"), "Indexed").otherwise("IndexMissing")
    return repos.join(i, "repo_id", "left").select("repo_id", status.alias("status"))
