"""Traversals as loops of joins. Each round's rows are a table in the shared folder, so that lineage stays short and lost executors lose nothing."""

from __future__ import annotations

from contextlib import contextmanager
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.sources.storage import running, written

#: Targets of a search at most: they are sent to all tasks.
ENDS = 100_000


def known(edges: DataFrame, value: str | None = None) -> DataFrame:
    """Edges (src, dst) with both ends, and with value as a double where it is a number above zero: an edge without a weight or cost leads nowhere."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    if value is None:
        return e.select("src", "dst")
    return e.select("src", "dst", F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0))


@contextmanager
def by_source(edges: DataFrame):
    """The edges laid out and sorted by src while a loop of joins lasts, so that a round moves and sorts the frontier alone. What a lost executor held is made again from the edges' source."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = edges.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def counted_write(df: DataFrame, *more) -> tuple[DataFrame, dict]:
    """The rows as a table, with their number n and other aggregates taken while they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *more))
    return table, seen.get


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """(id, depth) of nodes within so many hops of seeds (id). A round is a join of the frontier with the edges by an equality; visited nodes leave by an anti-join."""
    e = known(edges)
    if both:
        e = e.union(reverse(e))
    with by_source(e) as held:
        return _hops(held, seeds, depth)


def _hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    seen = frontier = written(seeds.where("id IS NOT NULL").select("id", F.lit(0).alias("depth")).distinct())
    for hop in range(1, depth + 1):
        found = frontier.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier, got = counted_write(found.select("id", F.lit(hop).alias("depth")))
        if not got["n"]:
            break
        seen = seen.unionByName(frontier)
    return seen


def bfs_within(edges: DataFrame, nodes: DataFrame, seed: DataFrame, depth: int, budget: int) -> DataFrame:
    """(id, depth, position, running) in order of discovery while the cost of nodes (id, cost) adds up to no more than the budget.

    Nodes of a level come by the position of the first node that leads to them, then by id. The walk ends before the first node that doesn't fit,
    in the midst of a level if need be. What isn't in nodes costs nothing and isn't shown, but is walked through.
    """
    cost = nodes.select("id", F.col("cost").cast("long").alias("cost"))
    out, position, spent = None, 0, 0
    with by_source(known(edges)) as e:
        level = seed.where("id IS NOT NULL").select("id", F.lit(0).cast("long").alias("parent")).distinct()
        seen = None
        for hop in range(depth + 1):
            priced = level.join(cost, "id", "left").select("id", "parent", "cost", F.coalesce("cost", F.lit(0)).alias("_c"))
            rows = running(priced, ["parent", "id"], "_c").select("id", "cost", (F.col("number") + position).alias("position"), (F.col("running") + spent).alias("running"))
            rows, got = counted_write(rows.withColumn("depth", F.lit(hop)), F.max("running").alias("spent"))
            if not got["n"]:
                break
            fits = rows.where(F.col("running") <= budget)
            out = fits if out is None else out.unionByName(fits)
            if got["spent"] > budget or hop == depth:
                break
            position, spent = position + got["n"], got["spent"]
            seen = rows.select("id") if seen is None else seen.union(rows.select("id"))
            level = rows.select(F.col("id").alias("src"), "position").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("position").alias("parent")).join(seen, "id", "left_anti")
    shown = out if out is not None else nodes.limit(0).select("id", F.lit(0).alias("cost"), F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("running"), F.lit(0).alias("depth"))
    return shown.where("cost IS NOT NULL").select("id", "depth", "position", "running")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_radius(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, limit: int = 500, matches: DataFrame | None = None, together: tuple[str, ...] = ()) -> DataFrame:
    """(path, depth, phase) of files that a change of the seeds may touch, the nearest first.

    Each round goes from what the last one reached over three kinds of steps: against edges (phase 1), from a file to those that import it by
    matches (path, target) (phase 2), and within packages of the languages named, whose files see each other without an import (phase 3). A file's phase is the least of
    those that reach it first; seeds have 0. A file is opened once, and so is a package, which stands between its files: their pairs are never made.
    """
    n = written(nodes.select("id", "path", F.when(F.col("language").isin(*together), F.col("package")).alias("package") if together else F.lit(None).cast("string").alias("package")))
    seen = frontier = written(seeds.where("id IS NOT NULL").select("id", F.lit(0).alias("depth"), F.lit(0).alias("phase")).distinct())
    opened = {"path": None, "package": None}
    with by_source(reverse(known(edges))) as back:
        for hop in range(1, depth + 1):
            ways = frontier.select(F.col("id").alias("src")).join(back, "src").select(F.col("dst").alias("id"), F.lit(1).alias("phase"))
            at = n.join(frontier.select("id"), "id", "left_semi")
            for column, phase in (("path", 2), ("package", 3)):
                if (column == "path" and matches is None) or (column == "package" and not together):
                    continue
                new = at.where(F.col(column).isNotNull()).select(column).distinct()
                if opened[column] is not None:
                    new = new.join(opened[column], column, "left_anti")
                new = written(new)
                opened[column] = new if opened[column] is None else opened[column].union(new)
                there = new if phase == 3 else matches.join(new.withColumnRenamed("path", "target"), "target", "left_semi").select("path").distinct()
                ways = ways.unionByName(n.join(there, column, "left_semi").select("id", F.lit(phase).alias("phase")))
            found = ways.groupBy("id").agg(F.min("phase").alias("phase")).join(seen, "id", "left_anti")
            frontier, got = counted_write(found.select("id", F.lit(hop).alias("depth"), "phase"))
            if not got["n"]:
                break
            seen = seen.unionByName(frontier)
    first = seen.join(n, "id").groupBy("path").agg(F.min(F.struct("depth", "phase")).alias("f"))
    return first.select("path", "f.depth", "f.phase").orderBy("depth", "path").limit(limit)


def nearest_methods(wanted: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, name, owner, id, depth): of wanted (class, name), the method (class, name, id) that a class has itself or from its nearest ancestor over bases (class, base).

    Among ancestors as near, the least owner wins, then the least id. What is found climbs no further, a class is asked once for the same
    question, and the rounds end when no question climbs: at any depth, and on cycles. Methods that no ancestor has give no row.
    """
    own = written(methods.where("class IS NOT NULL AND name IS NOT NULL").groupBy("class", "name").agg(F.min("id").alias("id")).withColumnRenamed("class", "at"))
    up = written(bases.where("class IS NOT NULL AND base IS NOT NULL").select(F.col("class").alias("at"), "base").distinct())
    asked = seen = written(wanted.where("class IS NOT NULL AND name IS NOT NULL").select("class", "name", F.col("class").alias("at")).distinct())
    out = None
    for hop in count():
        hits, got = counted_write(asked.join(own, ["at", "name"]).groupBy("class", "name").agg(F.min(F.struct("at", "id")).alias("m")).select("class", "name", F.col("m.at").alias("owner"), "m.id", F.lit(hop).alias("depth")))
        out = hits if out is None else out.unionByName(hits)
        open_ = asked.join(hits, ["class", "name"], "left_anti") if got["n"] else asked
        climbed = open_.join(up, "at").select("class", "name", F.col("base").alias("at")).distinct().join(seen, ["class", "name", "at"], "left_anti")
        asked, got = counted_write(climbed)
        if not got["n"]:
            return out
        seen = seen.union(asked)


def inherited(bases: DataFrame, methods: DataFrame) -> DataFrame:
    """nearest_methods of all classes and names at once: methods go down from those that have them, so that a round moves what was found and not what was asked."""
    own = methods.where("class IS NOT NULL AND name IS NOT NULL").groupBy("class", "name").agg(F.min("id").alias("id"))
    out = fresh = written(own.select("class", "name", F.col("class").alias("owner"), "id", F.lit(0).alias("depth")))
    down = bases.where("class IS NOT NULL AND base IS NOT NULL").select(F.col("base").alias("src"), F.col("class").alias("dst")).distinct()
    with by_source(down) as held:
        for hop in count(1):
            came = fresh.withColumnRenamed("class", "src").join(held, "src").groupBy(F.col("dst").alias("class"), "name").agg(F.min(F.struct("owner", "id")).alias("m"))
            new = came.join(out.select("class", "name"), ["class", "name"], "left_anti")
            fresh, got = counted_write(new.select("class", "name", "m.owner", "m.id", F.lit(hop).alias("depth")))
            if not got["n"]:
                return out
            out = out.unionByName(fresh)


def directional_subgraph(edges: DataFrame, seed: DataFrame, depth: int, containment: str = "defines/binding") -> DataFrame:
    """(src, dst, kind, depth, side): edges met going out on the deps side and in on the callers side; containment edges met on the callers side are shown but not followed."""
    out = None
    for side, e in (("deps", edges.select("src", "dst", "kind")), ("callers", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))):
        seen = frontier = written(seed.select("id").distinct())
        for hop in range(1, depth + 1):
            met = written(frontier.select(F.col("id").alias("src")).join(e, "src").withColumn("depth", F.lit(hop)))
            shown = met if side == "deps" else met.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "depth")
            rows = shown.select("src", "dst", "kind", "depth", F.lit(side).alias("side"))
            out = rows if out is None else out.unionByName(rows)
            follow = met if side == "deps" else met.where(F.col("kind") != containment)
            frontier = written(follow.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.union(frontier)
    return out


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 50, tolerance: float = 1e-6, depth: int = 6) -> DataFrame:
    """(id, score) by power iteration over the subgraph within `depth` hops of seeds (id, weight): r' = (1 - alpha) p + alpha sum r w / W.

    edges have a weight; those without one above zero are left out. Nodes at the last hop aren't expanded, and what reaches a node without
    out-edges is lost. A seed's weight counts as 0 if it is null, no number or below 0; seeds without any weight count alike.
    A round is one job: it joins the ranks with the moves, which stay where they are, and takes the change while it writes the new ranks.
    """
    w = F.when(~F.isnan("weight") & (F.col("weight") > 0), F.col("weight").cast("double")).otherwise(0.0)
    own = seeds.where("id IS NOT NULL").select("id", w.alias("weight"))
    n, total = own.agg(F.count(F.lit(1)), F.sum("weight")).first()
    start = written(own.groupBy("id").agg(F.sum(F.col("weight") / total if total else F.lit(1.0 / max(1, n))).alias("p")))
    e = known(edges, "weight")
    with by_source(e) as held:
        inner = _hops(held.select("src", "dst"), start, depth - 1).select(F.col("id").alias("src"))
        moves = held.join(inner, "src", "left_semi")
        sums = moves.groupBy("src").agg(F.sum("weight").alias("total"))
        moves = written(moves.join(sums, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("total")).alias("q")))  # here the edges' layout may go
    rank = start.select("id", F.col("p").alias("score"))
    none, p = F.lit(0.0).alias("was"), start.select("id", ((1 - alpha) * F.col("p")).alias("s"), F.lit(0.0).alias("was"))
    with by_source(moves) as held:
        for _ in range(rounds):
            came = rank.withColumnRenamed("id", "src").join(held, "src").select(F.col("dst").alias("id"), (alpha * F.col("score") * F.col("q")).alias("s"), none)
            both = p.unionByName(came).unionByName(rank.select("id", F.lit(0.0).alias("s"), F.col("score").alias("was")))
            now = both.groupBy("id").agg(F.sum("s").alias("score"), F.sum("was").alias("was"))
            rank, got = counted_write(now, F.sum(F.abs(F.col("score") - F.col("was"))).alias("change"))
            rank = rank.select("id", "score")
            if (got["change"] or 0.0) < tolerance:
                break
    return rank


def shortest_costs(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, targets: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
    """(id, cost) of the cheapest path of at most so many edges (src, dst, cost) from seeds, by relaxation; without a number, until no cost changes.

    With targets, paths dearer than (1 + slack) times the best way to a target found so far are given up.
    """
    best = written(seeds.where("id IS NOT NULL").select("id", F.lit(0.0).alias("cost")).distinct())
    ends = None if targets is None else F.broadcast(targets.where("id IS NOT NULL").select("id", F.lit(True).alias("end")).distinct().limit(ENDS))
    if targets is not None and targets.select("id").distinct().count() > ENDS:
        raise ValueError(f"at most {ENDS} targets")
    frontier, most = best, None
    with by_source(known(edges, "cost")) as held:
        for _ in range(rounds) if rounds is not None else count():
            step = frontier.withColumnRenamed("cost", "c").join(held, frontier["id"] == held["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("c") + F.col("cost")).alias("cost"))
            if most is not None:
                step = step.where(F.col("cost") <= (1 + slack) * most + 1e-9)
            better = step.join(best.withColumnRenamed("cost", "was"), "id", "left").where("was IS NULL OR cost < was - 1e-12").select("id", "cost")
            if ends is None:
                frontier, got = counted_write(better)
            else:
                frontier, got = counted_write(better.join(ends, "id", "left"), F.min(F.when(F.col("end"), F.col("cost"))).alias("best"))
                frontier = frontier.select("id", "cost")
                most = min((x for x in (most, got["best"]) if x is not None), default=None)
            if not got["n"]:
                break
            best = written(best.unionByName(frontier).groupBy("id").agg(F.min("cost").alias("cost")))
    return best


def connecting_path(edges: DataFrame, source: DataFrame, sink: DataFrame, depth: int = 5, slack: float = 0.5, fallback: int = 3, most: int = 2000) -> DataFrame:
    """(id, cost, on_route): execution_path over the union of what lies within `depth` hops after the source and before the sink, with paths of any length.

    The route comes first, then what is nearest by cost, ties by id, `most` nodes in all. Without a route: the nodes within
    `fallback` hops of the source, their cost null. Edges without a cost above zero are left out.
    """
    e = written(known(edges, "cost"))
    ahead, behind = bfs(e, source, depth), bfs(reverse(e), sink, depth)
    held = written(ahead.select("id", F.lit(True).alias("ahead")).union(behind.select("id", F.lit(False))).groupBy("id").agg(F.bool_or("ahead").alias("ahead"), F.bool_or(~F.col("ahead")).alias("behind")))
    both = e.join(held.select(F.col("id").alias("src"), F.col("ahead").alias("_a")), "src").join(held.select(F.col("id").alias("dst"), F.col("behind").alias("_b")), "dst")
    found, got = counted_write(execution_path(both.where("_a OR _b").select("src", "dst", "cost"), source, sink, None, slack))
    if not got["n"]:
        found = bfs(e, source, fallback).select("id", F.lit(None).cast("double").alias("cost"), F.lit(False).alias("on_route"))
    return found.orderBy(F.desc("on_route"), F.col("cost").asc_nulls_last(), "id").limit(most)


def execution_path(edges: DataFrame, source: DataFrame, sink: DataFrame, rounds: int | None = 5, slack: float = 0.5) -> DataFrame:
    """(id, cost, on_route): the cheapest routes from source to sink and what lies within (1 + slack) of their cost around the source."""
    edges = written(edges)
    ahead = shortest_costs(edges, source, rounds, sink, slack)
    back = shortest_costs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"), sink, rounds, source).withColumnRenamed("cost", "rest")
    best = ahead.join(sink.select("id"), "id", "left_semi").agg(F.min("cost").alias("best"))
    j = ahead.join(back, "id", "left").crossJoin(F.broadcast(best)).where("best IS NOT NULL")
    route = F.col("rest").isNotNull() & (F.abs(F.col("cost") + F.col("rest") - F.col("best")) < 1e-9)
    return j.withColumn("on_route", F.coalesce(route, F.lit(False))).where(F.col("on_route") | (F.col("cost") <= (1 + slack) * F.col("best"))).select("id", "cost", "on_route")


#: Rounds after which core_numbers writes its counts, so that what a lost executor held is made again from few rounds.
CUT = 8


def _entry(bound: str, n: str) -> str:
    """So many neighbours with a bound, as one number: entries sort by the larger bound, then by the smaller n."""
    return f"(CAST({n} AS BIGINT) - CAST({bound} AS BIGINT) * 4294967296)"


_BOUND, _N = "(-shiftright(e + 2147483648, 32))", "(e - shiftright(e + 2147483648, 32) * 4294967296)"


def _lowered(counts: DataFrame) -> DataFrame:
    """(id, was, shell, seen) of (id, was, seen, news), entries both: the h-index of what is seen with the news, and its entries with those above the h-index as one.

    Entries of one bound may be several, the negative ones first: sums up to them are too small at most, and right at the last.
    """
    best = f"aggregate(seen, named_struct('above', 0L, 'shell', 0L), (a, e) -> named_struct('above', a.above + {_N}, 'shell', greatest(a.shell, least({_BOUND}, a.above + {_N}))), a -> a.shell)"
    above = f"aggregate(seen, 0L, (a, e) -> a + IF({_BOUND} >= shell, {_N}, 0L))"
    rest = f"concat(array({_entry('shell', above)}), filter(seen, e -> {_BOUND} < shell))"
    ranked = counts.select("id", "was", F.expr("news IS NOT NULL AS told"), F.expr("IF(news IS NULL, seen, sort_array(concat(seen, news))) AS seen"))
    ranked = ranked.withColumn("shell", F.expr(f"IF(told, {best}, was)"))
    return ranked.select("id", "was", "shell", F.expr(f"IF(told, {rest}, seen) AS seen"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(id, shell) of the simple undirected graph, by rounds of the h-index of neighbours' bounds, which fall to the core numbers.

    Each node keeps how many neighbours have which bound, up to its own: a hub's neighbours are counted, not gathered. A round sends only the bounds that fell,
    and only to neighbours of a larger degree: a bound counts for a node as long as it isn't below the node's own. Edges and counts stay laid out by node.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = edges.where("src <> dst").select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    degree = F.count(F.lit(1)).over(W.partitionBy("src")).cast("int")
    near = both.repartition(parts, "src").distinct().select(F.col("dst").alias("src"), F.col("src").alias("dst"), degree.alias("most"))
    state = None
    with by_source(near) as held:
        degrees = held.groupBy("src", "most").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("was"), F.collect_list(F.expr(_entry("most", "n"))).alias("news"))
        told = degrees.withColumn("seen", F.expr("CAST(array() AS ARRAY<BIGINT>)"))
        try:
            for k in count(1):
                last, state = state, _lowered(told).persist(StorageLevel.MEMORY_AND_DISK)
                fell, got = counted_write(state.where("shell < was").select(F.col("id").alias("src"), "was", "shell").repartition("src"))
                if last is not None:
                    last.unpersist()
                if not got["n"]:
                    return written(state.select("id", "shell"))
                sent = fell.hint("merge").join(held, "src").where("shell < most").select(F.col("dst").alias("id"), F.col("was").alias("old"), F.col("shell").alias("now"))
                sums = sent.repartition(parts, "id").groupBy("id", "old", "now").agg(F.count(F.lit(1)).alias("n"))
                mail = sums.groupBy("id").agg(F.collect_list(F.struct("old", "now", "n")).alias("mail"))
                own = state.select("id", F.col("shell").alias("was"), "seen")
                if k % CUT == 0:
                    own = written(own).repartition(parts, "id")
                moved = f"flatten(transform(filter(mail, m -> m.now < was), m -> array({_entry('least(m.old, was)', '-m.n')}, {_entry('m.now', 'm.n')})))"
                told = own.join(mail.hint("merge"), "id", "left").select("id", "was", "seen", F.expr(f"nullif({moved}, CAST(array() AS ARRAY<BIGINT>)) AS news"))
        finally:
            if state is not None:
                state.unpersist()


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges that lie on a cycle or between two: those whose source nothing reaches, or whose target reaches nothing, go, round by round."""
    e, n = counted_write(known(edges).distinct())
    while n["n"]:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        now, got = counted_write(kept.select("src", "dst"))
        if got["n"] == n["n"]:
            return e
        e, n = now, got
    return e


def _least(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, least): of start (id, least), each node's least value over itself and what reaches it along edges; a round moves the values that fell."""
    best = frontier = written(start)
    with by_source(edges) as held:
        while True:
            step = frontier.join(held, frontier["id"] == held["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("least").alias("least"))
            frontier, got = counted_write(step.join(best.withColumnRenamed("least", "was"), "id").where("least < was").select("id", "least"))
            if not got["n"]:
                return best
            best = written(best.unionByName(frontier).groupBy("id").agg(F.min("least").alias("least")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, home) of nodes on cycles: home is the least node of the cycles' component. No pairs are made: a row a node, and a row an edge.

    Each round trims what no cycle holds, spreads the least id forwards, and from each node that kept its own id back along edges within its colour:
    what it reaches is its component, which is done. Colours are told apart in parallel.
    """
    e, out = trimmed(edges), None
    while not e.isEmpty():
        ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
        colour = _least(e, ids.select("id", F.col("id").alias("least")))
        a, b = colour.select(F.col("id").alias("src"), F.col("least").alias("_a")), colour.select(F.col("id").alias("dst"), F.col("least").alias("_b"))
        inner = written(e.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst"))
        roots = colour.where("id = least").select("id")
        home = written(_spread(reverse(inner), roots).join(colour, "id").select("id", F.col("least").alias("home")))
        out = home if out is None else out.unionByName(home)
        left = e.join(home.select(F.col("id").alias("src")), "src", "left_anti").join(home.select(F.col("id").alias("dst")), "dst", "left_anti")
        e = trimmed(left)
    if out is None:
        out = edges.limit(0).select(F.col("src").alias("id"), F.col("src").alias("home"))
    return out


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): all that seeds reach."""
    seen = frontier = written(seeds.select("id").distinct())
    with by_source(edges) as held:
        while True:
            found = frontier.withColumnRenamed("id", "src").join(held, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
            frontier, got = counted_write(found)
            if not got["n"]:
                return seen
            seen = written(seen.union(frontier))


def cycles(edges: DataFrame) -> DataFrame:
    """(id) of nodes on a cycle of any length, one edge included."""
    home = strong_components(edges)
    many = home.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("home")
    return home.join(many, "home", "left_semi").select("id").union(known(edges).where("src = dst").select(F.col("src").alias("id"))).distinct()


def layers(edges: DataFrame) -> DataFrame:
    """(id, layer): the length of the longest path that leaves a node; 0: it depends on none. Nodes on a common cycle are one node."""
    e = written(known(edges).distinct())
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    home = written(ids.join(strong_components(e), "id", "left").select("id", F.coalesce("home", "id").alias("home")))
    one = e.join(home.select(F.col("id").alias("src"), F.col("home").alias("a")), "src").join(home.select(F.col("id").alias("dst"), F.col("home").alias("b")), "dst")
    e = written(one.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    level = written(home.select(F.col("home").alias("id")).distinct().withColumn("layer", F.lit(0)))
    for k in count(1):
        up = e.join(level.where(F.col("layer") == k - 1).select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().withColumn("up", F.lit(k))
        level, got = counted_write(level.join(up, "id", "left").select("id", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer")), F.max("layer").alias("top"))
        if (got["top"] or 0) < k:
            return home.join(level.withColumnRenamed("id", "home"), "home").select("id", "layer")


def call_spine(edges: DataFrame, homes: DataFrame, seed: DataFrame, depth: int = 4, width: int = 6) -> DataFrame:
    """(depth, src, dst, side) around an entry point, with the component of each node from homes (id, component).

    side 'call': at each depth the first `width` calls of each caller, by callee, within its component and to nodes not yet met; these are
    followed. 'boundary': all calls into another component; shown, not followed. 'in', at depth 0: all calls of the seed from elsewhere.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    a, b = homes.select(F.col("id").alias("src"), F.col("component").alias("_a")), homes.select(F.col("id").alias("dst"), F.col("component").alias("_b"))
    seen = frontier = written(seed.select("id").distinct())
    out = e.join(seen.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.lit(0).alias("depth"), "src", "dst", F.lit("in").alias("side"))
    for hop in range(1, depth + 1):
        met = frontier.select(F.col("id").alias("src")).join(e, "src").join(a, "src", "left").join(b, "dst", "left").withColumn("_out", ~F.col("_a").eqNullSafe(F.col("_b")))
        inner = met.where("NOT _out").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        first = inner.withColumn("_n", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= width)
        kept = first.select(F.lit(hop).alias("depth"), "src", "dst", F.lit("call").alias("side"))
        shown = written(kept.unionByName(met.where("_out").select(F.lit(hop).alias("depth"), "src", "dst", F.lit("boundary").alias("side"))))
        out = out.unionByName(shown)
        frontier = written(shown.where("side = 'call'").select(F.col("dst").alias("id")).distinct())
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return out
