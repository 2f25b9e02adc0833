"""Connected components of links, by alternating large-star and small-star steps; nothing is gathered at the driver.

Links with a null end, of a node with itself and repeated ones are left out. Without links there are no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common as C


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger (large) or its smaller neighbours and itself to the smallest node around it.

    Smallest neighbours are found by a partial aggregation, so a node with very many links is a row per task; the
    join that hands them back is one whose skewed keys Spark may split.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (u, v): root is the smallest node that it can reach. Null ends are left out."""
    edges = C.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # A fixed point, and one link for each node: all point at their roots.
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first())
        if now == state and now[0] == now[2] or not now[0]:
            break
        state = now
        edges = C.written(_stars(_stars(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
