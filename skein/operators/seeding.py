"""What happens to seeds before they are ranked: callers join them, gates and neighbours drop them, paths share their slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import traverse
from skein.sources.storage import counted, written


def with_callers(seeds: DataFrame, edges: DataFrame, limits: tuple[int, ...] = (15, 10), factor: float = 0.35) -> DataFrame:
    """(id, weight): seeds and, a hop after the other, their best callers that aren't seeds yet, at `factor` of the heaviest seed that they call; ties go to the smallest id.

    A hop takes as many callers as its limit says; the next hop starts from all seeds so far. Repeated seeds count with their heaviest weight.
    """
    own = written(seeds.where("id IS NOT NULL").groupBy("id").agg(F.max("weight").alias("weight")))
    for limit in limits:
        near = edges.select("src", F.col("dst").alias("id")).join(own, "id").groupBy(F.col("src").alias("id")).agg((F.max("weight") * factor).alias("weight"))
        own = written(own.unionByName(near.where("id IS NOT NULL").join(own.select("id"), "id", "left_anti").orderBy(F.desc("weight"), "id").limit(limit)))
    return own


def apart(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score) of the seeds that a walk from the best to the least keeps when it drops those beside a kept one; ties go to the smallest id.

    Each round keeps every open seed that no open neighbour beats and drops the neighbours of those; the best open seed is always
    among them, so that the rounds end, and as no kept seed can be dropped by a later one they give what the walk gives.
    """
    best = written(seeds.where("id IS NOT NULL").groupBy("id").agg(F.max("score").alias("score")))
    s, t = best.select(F.col("id").alias("src"), F.col("score").alias("a")), best.select(F.col("id").alias("dst"), F.col("score").alias("b"))
    # Edges between seeds alone: they are few, whatever the graph's size, before repeated ones are told.
    ids = counted(best.select("id"))
    inner = edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    both = inner.union(traverse.reverse(inner)).where("src <> dst").distinct()
    # (src, dst): dst beats its neighbour src.
    beats = written(both.join(s, "src").join(t, "dst").where("b > a OR (b = a AND dst < src)").select("src", "dst"))
    open_, kept = best.select("id"), None
    while True:
        live = beats.join(open_.select(F.col("id").alias("src")), "src", "left_semi").join(open_.select(F.col("id").alias("dst")), "dst", "left_semi")
        won = written(open_.join(live.select(F.col("src").alias("id")), "id", "left_anti"))
        kept = won if kept is None else kept.union(won)
        lost = live.join(won.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        open_ = written(open_.join(won, "id", "left_anti").join(lost, "id", "left_anti"))
        if open_.isEmpty():
            return best.join(kept, "id", "left_semi")


def contamination_gate(seeds: DataFrame, edges: DataFrame, hops: int = 2, rescue: float = 0.85) -> DataFrame:
    """Seeds (id, exact, cosine) without those that have nothing to do with the exact ones.

    A seed goes if it isn't exact, lies more than `hops` edges of any direction from every exact one, and its cosine is known and
    below `rescue`. Without an exact seed all stay.
    """
    exact = written(seeds.where("exact").select("id").distinct())
    if exact.isEmpty():
        return seeds
    near = traverse.bfs(edges, exact, hops, both=True).select("id", F.lit(True).alias("_near")).distinct()
    return seeds.join(near, "id", "left").where(F.coalesce("exact", F.lit(False)) | F.col("_near").isNotNull() | F.col("cosine").isNull() | (F.col("cosine") >= rescue)).drop("_near")


def anchor_slots(rows: DataFrame, cap: int = 2, per_token: int = 4) -> DataFrame:
    """Rows (position, token, id, path, score) that anchor tokens: `per_token` rows of each token at most, and `cap` of each path over all tokens.

    Tokens come by their position, rows of a token by score and then id. A token's first row has its slot whatever its path holds by then.
    A row that isn't a first one has no slot once `cap` rows stand before it on its path: rows before the cap all have theirs.
    """
    order = [F.desc("score"), F.col("id")]
    mine = rows.withColumn("_t", F.row_number().over(W.partitionBy("position", "token").orderBy(*order))).where(F.col("_t") <= per_token)
    there = W.partitionBy("path").orderBy("position", "token", "_t")
    return mine.withColumn("_p", F.row_number().over(there)).where((F.col("_t") == 1) | (F.col("_p") <= cap)).drop("_t", "_p")
