"""Traversals and rankings over the projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.catalog import Graph, query
from skein.operators import filters, imports, overview, seeding, traverse
from skein.plans.relational import NE
from skein.schemas import EDGE_WEIGHTS

_WEIGHT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN CAST({w} AS DOUBLE)" for k, w in EDGE_WEIGHTS.items()) + " END"


def weighted(edges):
    return edges.withColumn("weight", F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in EDGE_WEIGHTS.items()]))


def _reach(name: str, edges: str, seeds: str, depth: int) -> str:
    """Reachability in SQL, a step at a time: each frontier is distinct."""
    steps = [f"{name}0 AS (SELECT DISTINCT id, 0 AS depth FROM ({seeds}))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM {name}{i}" for i in range(k))
        steps.append(f"{name}{k} AS MATERIALIZED (SELECT DISTINCT e.dst AS id, {k} AS depth FROM {name}{k - 1} f JOIN ({edges}) e ON f.id = e.src WHERE e.dst NOT IN ({seen}))")
    return ", ".join(steps) + f", {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(depth + 1)) + ")"


@query("WITH " + _reach("r", "SELECT src, dst FROM edges", "SELECT id FROM nodes WHERE kind = 'file' AND id % 10 = 3", 3) + " SELECT id, depth FROM r", NE)
def bfs(spark, d):
    g = Graph(spark, d)
    return traverse.bfs(g.edges, g.nodes.where("kind = 'file' AND id % 10 = 3").select("id"), 3)


@query("WITH " + _reach("r", "SELECT src, dst FROM edges WHERE kind IN ('depends', 'ref/call', 'ffi/call')", "SELECT id FROM nodes WHERE id = 60000000042", 3) + " SELECT id, depth FROM r WHERE depth > 0", NE)
def dependencies_transitive(spark, d):
    g = Graph(spark, d)
    e = g.edges.where("kind IN ('depends', 'ref/call', 'ffi/call')")
    return traverse.bfs(e, spark.createDataFrame([(60000000042,)], "id long"), 3).where("depth > 0")


@query("SELECT e.src AS id, n.signature, e.kind FROM edges e JOIN nodes n ON e.src = n.id WHERE e.dst = 50000000007", NE)
def callers(spark, d):
    g = Graph(spark, d)
    return g.edges.where("dst = 50000000007").select(F.col("src").alias("id"), "kind").join(g.nodes.select("id", "signature"), "id").select("id", "signature", "kind")


def _subgraph_sql(seed: int, depth: int) -> str:
    ctes, out = [], []
    for side, edges, follow in (("deps", "SELECT src, dst, kind FROM edges", "TRUE"), ("callers", "SELECT dst AS src, src AS dst, kind FROM edges", "kind <> 'defines/binding'")):
        ctes.append(f"{side}0 AS (SELECT CAST({seed} AS BIGINT) AS id)")
        for k in range(1, depth + 1):
            seen = " UNION ALL ".join(f"SELECT id FROM {side}{i}" for i in range(k))
            ctes.append(f"{side}_met{k} AS MATERIALIZED (SELECT e.* FROM {side}{k - 1} f JOIN ({edges}) e ON f.id = e.src)")
            ctes.append(f"{side}{k} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM {side}_met{k} WHERE {follow} AND dst NOT IN ({seen}))")
            cols = "src, dst" if side == "deps" else "dst AS src, src AS dst"
            out.append(f"SELECT {cols}, kind, {k} AS depth, '{side}' AS side FROM {side}_met{k}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(out)


@query(_subgraph_sql(40000000003, 2), NE)
def subgraph_both(spark, d):
    g = Graph(spark, d)
    return traverse.directional_subgraph(g.edges, spark.createDataFrame([(40000000003,)], "id long"), 2)


def _blast_sql(depth: int) -> str:
    """Rounds over edges, imports and packages; each frontier is distinct and has the least phase that leads to a node."""
    steps = [
        "im AS MATERIALIZED (SELECT DISTINCT a.path, b.path AS target FROM nodes a JOIN nodes b ON b.path = regexp_replace(a.path, 'machinery[.]ts$', 'building.ts') WHERE ends_with(a.path, '/machinery.ts'))",
        "f0 AS (SELECT id, 0 AS phase FROM nodes WHERE kind = 'class' AND id % 400 = 5)",
    ]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM f{i}" for i in range(k))
        at = f"(SELECT DISTINCT path, language, package FROM nodes WHERE id IN (SELECT id FROM f{k - 1}))"
        ways = f"""SELECT e.src AS id, 1 AS phase FROM f{k - 1} f JOIN edges e ON f.id = e.dst UNION ALL SELECT n.id, 2 FROM nodes n WHERE n.path IN (SELECT im.path FROM im JOIN {at} t ON im.target = t.path)
        UNION ALL SELECT n.id, 3 FROM nodes n WHERE n.language = 'go' AND n.package IN (SELECT package FROM {at} t WHERE language = 'go')"""
        steps.append(f"f{k} AS MATERIALIZED (SELECT id, min(phase) AS phase FROM ({ways}) WHERE id NOT IN ({seen}) GROUP BY id)")
    rows = " UNION ALL ".join(f"SELECT id, {k} AS depth, phase FROM f{k}" for k in range(depth + 1))
    return "WITH " + ", ".join(steps) + f", r AS (SELECT path, depth, min(phase) AS phase, row_number() OVER (PARTITION BY path ORDER BY depth) AS n FROM ({rows}) JOIN nodes USING (id) GROUP BY path, depth) SELECT path, depth, phase FROM r WHERE n = 1 ORDER BY depth, path LIMIT 500"


@query(_blast_sql(3), NE)
def blast_radius(spark, d):
    """Edges, imports that resolve by path (each folder's machinery.ts imports ./building), and Go packages."""
    g = Graph(spark, d)
    n = g.nodes
    files = n.groupBy("path").agg(F.min("id").alias("file_id"))
    asked = files.where(F.col("path").endswith("/machinery.ts")).select(F.col("file_id").alias("import_id"), F.lit("typescript").alias("language"), F.lit("import:./building").alias("spec"), "path")
    matches = imports.resolve(asked, files).select("path", "target")
    return traverse.blast_radius(g.edges, n, n.where("kind = 'class' AND id % 400 = 5").select("id"), 3, matches=matches, together=("go",))


def _ppr_sql(edges: str, seeds: str, rounds: int, depth: int) -> str:
    """Power iteration unrolled; seeds gives (id, weight)."""
    ctes = [
        f"e AS MATERIALIZED ({edges})",
        f"s AS (SELECT id, sum(weight) / (SELECT sum(weight) FROM ({seeds})) AS p FROM ({seeds}) GROUP BY id)",
        _reach("h", "SELECT src, dst FROM e", "SELECT id FROM s", depth - 1),
        "o AS (SELECT src, dst, w FROM e WHERE src IN (SELECT id FROM h))",
        "q AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS q FROM o)",
        "p0 AS (SELECT id, p AS score FROM s)",
    ]
    for k in range(1, rounds + 1):
        ctes.append(f"p{k} AS MATERIALIZED (SELECT id, sum(x) AS score FROM (SELECT id, 0.15 * p AS x FROM s UNION ALL SELECT q.dst, 0.85 * r.score * q.q FROM p{k - 1} r JOIN q ON r.id = q.src) GROUP BY id)")
    both = "SELECT id, sum(x) AS x FROM (SELECT id, score AS x FROM p{a} UNION ALL SELECT id, -score FROM p{b}) GROUP BY id"
    ctes.append("d AS (" + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(x)) AS change FROM ({both.format(a=k, b=k - 1)})" for k in range(1, rounds + 1)) + ")")
    ctes.append(f"last AS (SELECT coalesce(min(k), {rounds}) AS k FROM d WHERE change < {_LEAST})")
    rows = " UNION ALL ".join(f"SELECT {k} AS k, id, score FROM p{k}" for k in range(1, rounds + 1))
    return "WITH " + ", ".join(ctes) + f" SELECT id, round(score, 10) AS score FROM ({rows}) WHERE k = (SELECT k FROM last)"


_EDGES_W = f"SELECT src, dst, {_WEIGHT_SQL} AS w FROM edges"
#: Rounds at most, hops, and the change under which a round is the last.
_ROUNDS, _DEPTH, _LEAST = 50, 6, "0.000001"


@query(_ppr_sql(_EDGES_W, "SELECT id, CAST(1.0 AS DOUBLE) AS weight FROM nodes WHERE kind = 'file' AND id % 8 = 2", _ROUNDS, _DEPTH), NE)
def ppr_uniform(spark, d):
    return _ppr_uniform(spark, d)


def _ppr_uniform(spark, d, **settings):
    g = Graph(spark, d)
    seeds = g.nodes.where("kind = 'file' AND id % 8 = 2").select("id", F.lit(1.0).alias("weight"))
    r = traverse.personalised_pagerank(weighted(g.edges), seeds, **settings)
    return r.select("id", F.round("score", 10).alias("score"))


@query(_ppr_sql(_EDGES_W, "SELECT id, CAST(id % 5 + 1 AS DOUBLE) AS weight FROM nodes WHERE kind = 'class' AND id % 90 = 2", _ROUNDS, _DEPTH), NE)
def ppr_weighted(spark, d):
    return _ppr_weighted(spark, d)


def _ppr_weighted(spark, d, **settings):
    g = Graph(spark, d)
    seeds = g.nodes.where("kind = 'class' AND id % 90 = 2").select("id", (F.col("id") % 5 + 1).cast("double").alias("weight"))
    r = traverse.personalised_pagerank(weighted(g.edges), seeds, **settings)
    return r.select("id", F.round("score", 10).alias("score"))


@query(_ppr_sql(f"SELECT src, dst, {_WEIGHT_SQL} AS w FROM edges WHERE dst IN (SELECT id FROM nodes WHERE corpus IN ('asia', 'parts'))", "SELECT id, CAST(1.0 AS DOUBLE) AS weight FROM nodes WHERE kind = 'file' AND corpus = 'asia'", _ROUNDS, _DEPTH), NE)
def ppr_rbac(spark, d):
    return _ppr_rbac(spark, d)


def _ppr_rbac(spark, d, **settings):
    g = Graph(spark, d)
    seeds = g.nodes.where("kind = 'file' AND corpus = 'asia'").select("id", F.lit(1.0).alias("weight"))
    r = traverse.personalised_pagerank(weighted(filters.visible_edges(g.edges, g.nodes, ["asia", "parts"])), seeds, **settings)
    return r.select("id", F.round("score", 10).alias("score"))


@query()
def execution_path(spark, d):
    """Routes over expansions from both ends; SQL has no number of rounds that is enough."""
    ends = [Graph(spark, d).nodes.where(f"id = {x}").select("id") for x in (20000000007, 40000000003)]
    if any(x.isEmpty() for x in ends):
        ends = [x.limit(0) for x in ends]
    return traverse.connecting_path(_costed(spark, d), *ends).select("id", F.round("cost", 6).alias("cost"), "on_route")


def _costed(spark, d):
    return weighted(Graph(spark, d).edges).groupBy("src", "dst").agg(F.min(F.least(F.lit(10.0), 1.0 / F.col("weight"))).alias("cost"))


@query()
def kcore(spark, d):
    return traverse.core_numbers(Graph(spark, d).edges)


@query(
    """WITH own AS (SELECT id, CAST(id % 7 AS INT) AS shell, package, path FROM nodes WHERE kind IN ('function', 'class', 'method')), pk AS (SELECT package, max(CAST(id % 11 AS INT)) AS shell FROM nodes WHERE kind IN ('package', 'file') GROUP BY package)
    SELECT own.id, greatest(own.shell, coalesce(pk.shell, 0)) AS shell FROM own LEFT JOIN pk USING (package)""",
    ("nodes",),
)
def kcore_propagation(spark, d):
    n = Graph(spark, d).nodes
    own = n.where("kind IN ('function', 'class', 'method')").select("id", "package", (F.col("id") % 7).cast("int").alias("shell"))
    pk = n.where("kind IN ('package', 'file')").groupBy("package").agg(F.max((F.col("id") % 11).cast("int")).alias("pk"))
    return own.join(pk, "package", "left").select("id", F.greatest("shell", F.coalesce("pk", F.lit(0))).alias("shell"))


@query("WITH b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), " + _reach("r", "SELECT src, dst FROM b", "SELECT id FROM nodes WHERE id = 40000000005", 2) + " SELECT id, depth FROM r ORDER BY depth, id LIMIT 2000", NE)
def anchor_neighbourhood(spark, d):
    g = Graph(spark, d)
    return traverse.bfs(g.edges, spark.createDataFrame([(40000000005,)], "id long"), 2, both=True).orderBy("depth", "id").limit(2000)


_COMPONENTS = "c AS MATERIALIZED (SELECT DISTINCT s.corpus AS src, t.corpus AS dst FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id WHERE s.corpus <> t.corpus)"


@query(f"WITH {_COMPONENTS}, t AS (SELECT src, dst FROM c UNION SELECT t.src, c.dst FROM t JOIN c ON t.dst = c.src) SELECT DISTINCT src AS id FROM t WHERE src = dst", NE)
def cycles(spark, d):
    return traverse.cycles(_components(Graph(spark, d)).select(F.col("component").alias("src"), F.col("target").alias("dst")))


def _components(g):
    return overview.component_dependencies(g.nodes, weighted(g.edges), "corpus")


_KINDS = "k AS MATERIALIZED (SELECT DISTINCT s.kind AS src, t.kind AS dst FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id)"


@query(
    f"""WITH {_KINDS}, t AS (SELECT src, dst FROM k UNION SELECT t.src, k.dst FROM t JOIN k ON t.dst = k.src), i AS (SELECT src AS id FROM k UNION SELECT dst FROM k),
    h AS (SELECT id, least(id, coalesce(min(b.dst), id)) AS home FROM i LEFT JOIN (SELECT x.src, x.dst FROM t x JOIN t y ON x.src = y.dst AND x.dst = y.src) b ON b.src = id GROUP BY id),
    k2 AS (SELECT DISTINCT a.home AS src, b.home AS dst FROM k JOIN h a ON k.src = a.id JOIN h b ON k.dst = b.id WHERE a.home <> b.home),
    l AS (SELECT src AS home, 1 AS depth FROM k2 UNION SELECT k2.src, l.depth + 1 FROM k2 JOIN l ON k2.dst = l.home)
    SELECT id, max(coalesce(depth, 0)) AS layer FROM h LEFT JOIN l USING (home) GROUP BY id""",
    NE,
)
def layering(spark, d):
    g = Graph(spark, d)
    n = g.nodes
    k = g.edges.select("src", "dst").join(n.select(F.col("id").alias("src"), F.col("kind").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("kind").alias("b")), "dst")
    return traverse.layers(k.select(F.col("a").alias("src"), F.col("b").alias("dst")))


_RULES = [
    ("asia keeps to itself", ["asia", "europe"], ["parts"], None, False),
    ("nothing", ["events", "parts"], [], None, False),
    ("one door", ["parts"], None, ["asia", "africa"], False),
    ("no cycles", [], None, None, True),
    ("of a component that is gone", ["atlantis"], None, ["asia"], False),
]


@query(
    f"""WITH {_COMPONENTS}, t AS (SELECT src, dst FROM c UNION SELECT t.src, c.dst FROM t JOIN c ON t.dst = c.src), known AS (SELECT DISTINCT corpus FROM nodes)
    SELECT 'asia keeps to itself' AS rule, 'dependency' AS violation, src AS component, dst AS target FROM c WHERE src IN ('asia', 'europe') AND dst <> 'parts'
    UNION ALL SELECT 'nothing', 'dependency', src, dst FROM c WHERE src IN ('events', 'parts')
    UNION ALL SELECT 'one door', 'user', src, dst FROM c WHERE dst = 'parts' AND src NOT IN ('asia', 'africa')
    UNION ALL SELECT 'no cycles', 'cycle', c.src, c.dst FROM c WHERE EXISTS (SELECT 1 FROM t WHERE t.src = c.dst AND t.dst = c.src)
    UNION ALL SELECT 'of a component that is gone', 'unknown', 'atlantis', NULL WHERE 'atlantis' NOT IN (SELECT corpus FROM known)""",
    NE,
)
def invariants(spark, d):
    g = Graph(spark, d)
    rules = spark.createDataFrame(_RULES, "rule string, components array<string>, may_depend_on array<string>, may_be_used_by array<string>, acyclic boolean")
    return overview.rule_violations(_components(g), g.nodes.select(F.col("corpus").alias("component")).distinct(), rules)


def _spine_sql(seed: int, depth: int, width: int, shown: str = "*") -> str:
    ctes = [f"f0 AS (SELECT CAST({seed} AS BIGINT) AS id)", "e AS MATERIALIZED (SELECT DISTINCT src, dst, s.corpus IS DISTINCT FROM t.corpus AS away FROM edges LEFT JOIN nodes s ON s.id = src LEFT JOIN nodes t ON t.id = dst WHERE src <> dst)"]
    out = [f"SELECT 0 AS depth, src, dst, 'in' AS side FROM e WHERE dst = {seed}"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM f{i}" for i in range(k))
        ctes.append(f"m{k} AS MATERIALIZED (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY e.dst) AS n FROM f{k - 1} f JOIN e ON f.id = e.src WHERE NOT away AND e.dst NOT IN ({seen})) WHERE n <= {width})")
        ctes.append(f"f{k} AS MATERIALIZED (SELECT DISTINCT dst AS id FROM m{k})")
        out += [f"SELECT {k}, src, dst, 'call' FROM m{k}", f"SELECT {k}, e.src, e.dst, 'boundary' FROM f{k - 1} f JOIN e ON f.id = e.src WHERE away"]
    return "WITH " + ", ".join(ctes) + ", spine AS (" + " UNION ALL ".join(out) + f") SELECT {shown} FROM spine"


@query(_spine_sql(20000000004, 4, 6), NE)
def call_spine(spark, d):
    g = Graph(spark, d)
    return traverse.call_spine(g.edges, g.nodes.select("id", F.col("corpus").alias("component")), spark.createDataFrame([(20000000004,)], "id long"))


@query(
    """WITH s AS (SELECT id, CAST(id % 7 + 1 AS DOUBLE) AS w FROM nodes WHERE kind = 'method' AND id % 700 = 3),
    a AS (SELECT e.src AS id, max(s.w) * 0.35 AS w FROM edges e JOIN s ON e.dst = s.id WHERE e.src NOT IN (SELECT id FROM s) GROUP BY e.src ORDER BY 2 DESC, 1 LIMIT 15), s1 AS (SELECT * FROM s UNION ALL SELECT * FROM a),
    b AS (SELECT e.src AS id, max(s1.w) * 0.35 AS w FROM edges e JOIN s1 ON e.dst = s1.id WHERE e.src NOT IN (SELECT id FROM s1) GROUP BY e.src ORDER BY 2 DESC, 1 LIMIT 10)
    SELECT id, round(CAST(w AS DOUBLE), 6) AS weight FROM (SELECT * FROM s1 UNION ALL SELECT * FROM b)""",
    NE,
)
def caller_enrichment(spark, d):
    g = Graph(spark, d)
    s = g.nodes.where("kind = 'method' AND id % 700 = 3").select("id", (F.col("id") % 7 + 1).cast("double").alias("weight"))
    return seeding.with_callers(s, g.edges).select("id", F.round("weight", 6).alias("weight"))


@query(
    "WITH s AS (SELECT id, CAST(id % 90 AS DOUBLE) / 100 AS cosine, kind = 'class' AND id % 97 = 5 AS exact FROM nodes WHERE id % 3 = 2 OR (kind = 'class' AND id % 97 = 5)), b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), "
    + _reach("r", "SELECT src, dst FROM b", "SELECT id FROM s WHERE exact", 2)
    + " SELECT id, exact, cosine FROM s WHERE exact OR cosine >= 0.85 OR id IN (SELECT id FROM r)",
    NE,
)
def contamination_gate(spark, d):
    g = Graph(spark, d)
    exact = (F.col("kind") == "class") & (F.col("id") % 97 == 5)
    s = g.nodes.where((F.col("id") % 3 == 2) | exact).select("id", exact.alias("exact"), ((F.col("id") % 90).cast("double") / 100).alias("cosine"))
    return seeding.contamination_gate(s, g.edges)


@query(
    """WITH a AS (SELECT id FROM nodes WHERE kind = 'function' AND id % 300 = 9) SELECT dst AS id, round(0.8 * count(*), 6) AS weight FROM edges WHERE kind IN ('ref/call', 'depends') AND src IN (SELECT id FROM a) AND dst NOT IN (SELECT id FROM a) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 8""".replace("round(0.8 * count(*), 6)", "CAST(round(0.8 * count(*), 6) AS DOUBLE)"),
    NE,
)
def callee_seeds(spark, d):
    g = Graph(spark, d)
    a = g.nodes.where("kind = 'function' AND id % 300 = 9").select("id")
    c = g.edges.where("kind IN ('ref/call', 'depends')").join(a.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(a, "id", "left_anti")
    return c.orderBy(F.desc("n"), "id").limit(8).select("id", F.round(0.8 * F.col("n"), 6).alias("weight"))


@query(
    """WITH c AS (SELECT id AS class, 30000000000 + (id - 30000000000) // 3 AS base FROM nodes WHERE kind = 'class' AND id < 40000000000), b AS (SELECT * FROM c WHERE base IN (SELECT class FROM c) AND base <> class),
    m AS (SELECT e.dst AS class, split_part(regexp_replace(n.signature, '^.*[.]', ''), '_', 1) AS name, min(n.id) AS id FROM edges e JOIN nodes n ON e.src = n.id WHERE e.kind = 'ref/field' GROUP BY 1, 2),
    w AS (SELECT class, name FROM c, (SELECT DISTINCT name FROM m)), a AS (SELECT class, class AS up, 0 AS depth FROM c UNION SELECT a.class, b.base, a.depth + 1 FROM a JOIN b ON a.up = b.class),
    j AS (SELECT w.class, w.name, a.up AS owner, m.id, a.depth, row_number() OVER (PARTITION BY w.class, w.name ORDER BY a.depth, a.up, m.id) AS n FROM w JOIN a ON w.class = a.class JOIN m ON m.class = a.up AND m.name = w.name)
    SELECT class, name, owner, id, depth FROM j WHERE n = 1""",
    NE,
)
def inherited_methods(spark, d):
    """Each customer class inherits from the one of a third of its number; parts with a field edge to a class are its methods, by the first word of their names."""
    g = Graph(spark, d)
    n = g.nodes
    c = n.where("kind = 'class' AND id < 40000000000").select(F.col("id").alias("class"), F.expr("30000000000 + (id - 30000000000) div 3").alias("base"))
    own = g.edges.where("kind = 'ref/field'").select("src", F.col("dst").alias("class")).join(n.select(F.col("id").alias("src"), "signature"), "src")
    methods = own.select("class", F.substring_index(F.regexp_replace("signature", "^.*[.]", ""), "_", 1).alias("name"), F.col("src").alias("id"))
    bases = c.where("base <> class").join(c.select(F.col("class").alias("base")), "base", "left_semi")
    return traverse.inherited(bases, methods).join(c.select("class"), "class", "left_semi")


_SCORE = "(id * 7919) % 1009"


def _apart_sql(rounds: int) -> str:
    """Rounds of the greedy choice; the last one has nothing open left on the given tables."""
    ctes = [
        f"s AS MATERIALIZED (SELECT id, {_SCORE} AS score FROM nodes WHERE kind IN ('class', 'function', 'method') AND id % 4 = 3)",
        "b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)",
        "t AS MATERIALIZED (SELECT x.id AS src, y.id AS dst FROM s x JOIN b ON b.src = x.id JOIN s y ON b.dst = y.id WHERE y.score > x.score OR (y.score = x.score AND y.id < x.id))",
        "o0 AS (SELECT id FROM s)",
    ]
    for k in range(1, rounds + 1):
        ctes.append(f"w{k} AS MATERIALIZED (SELECT id FROM o{k - 1} WHERE id NOT IN (SELECT t.src FROM t JOIN o{k - 1} p ON t.dst = p.id))")
        ctes.append(f"o{k} AS MATERIALIZED (SELECT id FROM o{k - 1} WHERE id NOT IN (SELECT id FROM w{k}) AND id NOT IN (SELECT t.src FROM t JOIN w{k} w ON t.dst = w.id))")
    return "WITH " + ", ".join(ctes) + f" SELECT id, score FROM s WHERE id IN ({' UNION ALL '.join(f'SELECT id FROM w{k}' for k in range(1, rounds + 1))})"


@query(_apart_sql(12), NE)
def adjacent_seed_dedupe(spark, d):
    g = Graph(spark, d)
    return seeding.apart(g.nodes.where("kind IN ('class', 'function', 'method') AND id % 4 = 3").select("id", F.expr(_SCORE).alias("score")), g.edges)
