"""Edges as lines of a DOT graph or of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line) for each edge (src_sig, dst_sig, kind), quotes escaped."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), q("src_sig"), F.lit(" -> "), q("dst_sig"), F.lit(' [label="'), "kind", F.lit('"];')).alias("line"))


def tree_lines(spine: DataFrame) -> DataFrame:
    """(depth, src, line) of a call spine (depth, src, dst): two blanks a level."""
    return spine.select("depth", "src", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("dst").cast("string")).alias("line"))
