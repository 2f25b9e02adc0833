"""Overviews of a graph by package, folder and component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.identifiers import package_key


def tiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_key, files, edges_out, dependents): dependents are the other packages with an edge in. Edges meet packages by two joins and leave as counts of pairs."""
    k = nodes.select("id", "path", package_key(F.col("path")).alias("package_key"))
    s, t = k.select(F.col("id").alias("src"), F.col("package_key").alias("a")), k.select(F.col("id").alias("dst"), F.col("package_key").alias("b"))
    pairs = edges.select("src", "dst").join(s, "src").join(t, "dst").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    files = k.groupBy("package_key").agg(F.countDistinct("path").alias("files"))
    out = pairs.groupBy(F.col("a").alias("package_key")).agg(F.sum("n").alias("edges_out"))
    into = pairs.groupBy(F.col("b").alias("package_key")).agg(F.count(F.lit(1)).alias("dependents"))
    return files.join(out, "package_key", "left").join(into, "package_key", "left").fillna(0, ["edges_out", "dependents"])


def directory_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dir, symbols, dependents): each folder with all that lies under it; dependents are the nodes with an edge into it."""
    parts = F.split("path", "/")
    dirs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    s = nodes.select("id", F.explode(dirs).alias("dir"))
    into = edges.select("src", F.col("dst").alias("id")).join(s, "id").select("dir", "src").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("dependents"))
    return s.groupBy("dir").agg(F.count(F.lit(1)).alias("symbols")).join(into, "dir", "left").fillna(0, ["dependents"])


def repo_map(nodes: DataFrame, edges: DataFrame, budget: int = 40) -> DataFrame:
    """(rank, tile, whole, files, symbols, dependents): folders that cover all nodes in at most `budget` rows, those that most files outside need first.

    The heaviest folder is split into its subfolders, and a row for its own files, as long as the rows fit. As no folder weighs more than the one it lies in,
    that order is the one by weight (symbols; ties: the upper, then the name), and the folders split are those whose running sum of added rows fits.
    whole: the tile is a folder with all in it; else its own files only ("dir/*", "*" for the root). A node without path lies in the root.
    dependents: files of other tiles with an edge into the tile. Edges meet paths before they are counted, paths meet folders once a path.
    """
    if budget < 1:
        raise ValueError("a map has at least one row")
    from skein.sources.storage import counted, running, written

    at = nodes.select("id", F.coalesce("path", F.lit("")).alias("path"))
    paths = written(at.groupBy("path").agg(F.count(F.lit(1)).alias("symbols")).withColumn("parts", F.split("path", "/")))
    upto = lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/")
    above = paths.select("path", "symbols", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth")).withColumn("dir", upto(F.col("depth")))
    child = F.when(F.col("depth") + 1 < F.size("parts"), upto(F.col("depth") + 1))
    children = above.withColumn("child", child).groupBy("depth", "dir", "child").agg(F.sum("symbols").alias("symbols"))
    folders = children.groupBy("depth", "dir").agg(F.sum("symbols").alias("symbols"), (F.count(F.lit(1)) - 1).alias("added"), F.count("child").alias("below")).where("below > 0")
    split = running(folders, [F.desc("symbols"), F.asc("depth"), F.asc("dir")], "added").where(F.col("running") + 1 <= budget).select("depth", "dir")
    deepest = above.join(counted(split), ["depth", "dir"]).groupBy("path").agg(F.max("depth").alias("d"))
    whole = F.col("d").isNull() | (F.col("d") + 1 < F.size("parts"))
    own = F.when(F.col("d") == 0, "*").otherwise(F.concat(upto(F.col("d")), F.lit("/*")))
    tile = F.when(F.col("d").isNull(), "").when(whole, upto(F.col("d") + 1)).otherwise(own)
    placed = written(paths.join(deepest, "path", "left").select("path", "symbols", tile.alias("tile"), whole.alias("whole")))
    s, t = at.select(F.col("id").alias("src"), F.col("path").alias("a")), at.select(F.col("id").alias("dst"), F.col("path").alias("b"))
    pairs = edges.select("src", "dst").join(s, "src").join(t, "dst").where("a <> b").select("a", "b").distinct()
    users = pairs.join(placed.select(F.col("path").alias("a"), F.struct("tile", "whole").alias("of")), "a").join(placed.select(F.col("path").alias("b"), "tile", "whole"), "b")
    need = users.where(F.col("of") != F.struct("tile", "whole")).select("tile", "whole", "a").distinct().groupBy("tile", "whole").agg(F.count(F.lit(1)).alias("dependents"))
    tiles = placed.groupBy("tile", "whole").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols")).join(need, ["tile", "whole"], "left").fillna(0, ["dependents"])
    place = F.row_number().over(W.orderBy(F.desc("dependents"), F.desc("symbols"), "tile", "whole"))  # over at most `budget` rows
    return tiles.select(place.alias("rank"), "tile", "whole", "files", "symbols", "dependents")


def component_dependencies(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(component, target, weight, n): weighted edges between different components."""
    s, t = nodes.select(F.col("id").alias("src"), F.col(by).alias("component")), nodes.select(F.col("id").alias("dst"), F.col(by).alias("target"))
    return edges.join(s, "src").join(t, "dst").where("component <> target").groupBy("component", "target").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def rule_violations(pairs: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, violation, component, target) of rules (rule, components, may_depend_on, may_be_used_by, acyclic) over dependencies (component, target) between known components (component).

    'dependency': a component of the rule depends on one that may_depend_on, unless null, doesn't name. 'user': one that may_be_used_by,
    unless null, doesn't name depends on it. 'cycle': a dependency that closes a cycle, where acyclic. 'unknown': the rule is about a
    component that doesn't exist. A component may depend on itself.
    """
    from skein.operators.traverse import strong_components

    p = pairs.select("component", "target").where("component <> target").distinct()
    about = rules.select("rule", "may_depend_on", "may_be_used_by", F.explode("components").alias("of")).distinct()
    row = lambda what, df: df.select("rule", F.lit(what).alias("violation"), "component", "target")
    out = about.where("may_depend_on IS NOT NULL").join(p, F.col("of") == F.col("component")).where(~F.array_contains("may_depend_on", F.col("target")))
    into = about.where("may_be_used_by IS NOT NULL").join(p, F.col("of") == F.col("target")).where(~F.array_contains("may_be_used_by", F.col("component")))
    lost = about.join(known.select(F.col("component").alias("of")).distinct(), "of", "left_anti").withColumns({"component": F.col("of"), "target": F.lit(None).cast("string")})
    home = strong_components(p.select(F.col("component").alias("src"), F.col("target").alias("dst")))
    inside = p.join(home.select(F.col("id").alias("component"), F.col("home").alias("_a")), "component").join(home.select(F.col("id").alias("target"), F.col("home").alias("_b")), "target")
    closing = rules.where("acyclic").select("rule").distinct().join(inside.where("_a = _b").select("component", "target"))
    return row("dependency", out).unionByName(row("user", into)).unionByName(row("cycle", closing)).unionByName(row("unknown", lost)).distinct()
