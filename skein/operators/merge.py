"""Merging batches into tables: precedence, staging, deletion, replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def precedence(provenance) -> F.Column:
    """Compiler-grade sources before live ones before syntax alone."""
    return F.when(provenance.isin("lsif", "scip") | provenance.startswith("bridge:"), 0).when(provenance == "live", 1).otherwise(2)


def provenance_upsert(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind), that of the best provenance; the result doesn't depend on the rows' order.

    min_by aggregates before the shuffle, so that an edge seen a million times is one row per task.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst", "kind")]
    best = F.min(F.struct(precedence(F.col("provenance")).alias("_p"), *rest)).alias("best")
    return edges.groupBy("src", "dst", "kind").agg(best).select("src", "dst", "kind", *(F.col(f"best.{c}") for c in rest))


def staging_flush(staged: DataFrame, key: str = "id", order: str = "line") -> DataFrame:
    """One row for each key, that of the largest line."""
    rest = [c for c in staged.columns if c not in (key, order)]
    return staged.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("best")).select(key, F.col(f"best.{order}"), *(F.col(f"best.{c}") for c in rest))


def delete_prefix(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes left, edges left, tombstones) after all nodes under a path prefix go, with the edges that touch them."""
    gone = nodes.where(F.col("path").startswith(prefix)).select("id")
    left = edges.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("dst") == F.col("id"), "left_anti")
    return nodes.where(~F.col("path").startswith(prefix)), left, gone


def replace_report(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, change, callers): ids removed, added or changed between two parses, and how many files call them."""
    both = old.select("id", F.struct("signature", "line", "end_line").alias("was")).join(new.select("id", F.struct("signature", "line", "end_line").alias("now")), "id", "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    changed = both.select("id", change.alias("change")).where("change IS NOT NULL")
    callers = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    return changed.join(callers, "id", "left").select("id", "change", F.coalesce("callers", F.lit(0).cast("long")).alias("callers"))


def dirty_files(old: DataFrame, new: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, removed, references): files outside the parsed ones with edges into nodes that the new parse has lost; how many of these, and by how many edges.

    old, new: the nodes (id, path) of both parses of some files. The lost ids meet edges before edges meet files.
    """
    lost = old.select(F.col("id").alias("dst")).distinct().join(new.select(F.col("id").alias("dst")), "dst", "left_anti")
    hit = edges.select("src", "dst").join(lost, "dst").join(nodes.select(F.col("id").alias("src"), "path"), "src")
    hit = hit.join(old.select("path").union(new.select("path")).distinct(), "path", "left_anti")
    return hit.groupBy("path", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.count(F.lit(1)).alias("removed"), F.sum("n").alias("references"))


def guarded_delete(indexed: DataFrame, walked: DataFrame, key: str = "path", floor: int = 100, share: float = 0.5) -> DataFrame:
    """Keys that are indexed but were not walked; none if more would go than the floor and the share allow."""
    ghosts = indexed.select(key).distinct().join(walked.select(key).distinct(), key, "left_anti")
    n = indexed.select(key).distinct().agg(F.count(F.lit(1)).alias("n_indexed"))
    g = ghosts.agg(F.count(F.lit(1)).alias("n_ghosts"))
    return ghosts.crossJoin(F.broadcast(n.crossJoin(g))).where(F.col("n_ghosts") <= F.greatest(F.lit(floor), F.col("n_indexed") * share)).select(key)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
