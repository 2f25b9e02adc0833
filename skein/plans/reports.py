"""Scores, labels, reports and settings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.catalog import Graph, query
from skein.functions import scores
from skein.functions.identifiers import SYNONYMS
from skein.operators import joins, render
from skein.plans.graph import _spine_sql
from skein.plans.relational import NE

# Written out here, not taken from the library, so that a wrong entry there shows.
_EXT_SQL = r"""CASE
    WHEN e IN ('ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs') THEN 'typescript' WHEN e = 'rs' THEN 'rust' WHEN e IN ('py', 'pyi') THEN 'python' WHEN e = 'go' THEN 'go'
    WHEN e = 'java' THEN 'java' WHEN e IN ('kt', 'kts') THEN 'kotlin' WHEN e IN ('rb', 'rake', 'gemspec') THEN 'ruby' WHEN e = 'cs' THEN 'csharp' WHEN e IN ('php', 'phtml', 'php8') THEN 'php'
    WHEN e IN ('scala', 'sc') THEN 'scala' WHEN e IN ('cpp', 'cc', 'cxx', 'hpp', 'hh', 'hxx') THEN 'cpp' WHEN e IN ('c', 'h') THEN 'c' WHEN e = 'swift' THEN 'swift' WHEN e = 'dart' THEN 'dart'
    WHEN e IN ('m', 'mm') THEN 'objc' WHEN e IN ('json', 'jsonc') THEN 'json' WHEN e IN ('yml', 'yaml') THEN 'yaml' WHEN e = 'toml' THEN 'toml' WHEN e IN ('xml', 'xsd', 'xsl') THEN 'xml'
    WHEN e IN ('md', 'markdown', 'mdx') THEN 'markdown' ELSE 'unknown' END"""
_MANY_ENDINGS = "'go', 'tsx', 'cjs', 'JS', 'rs', 'pyi', 'kts', 'rake', 'gemspec', 'phtml', 'php8', 'sc', 'cxx', 'hh', 'h', 'mm', 'jsonc', 'yml', 'toml', 'xsd', 'mdx', 'scala', 'swift', 'dart', 'cs', 'java', 'exe', ''"


@query(
    rf"""WITH p AS (SELECT DISTINCT path FROM nodes UNION SELECT p_name || '.' || ([{_MANY_ENDINGS}])[CAST(p_partkey % 28 + 1 AS INT)] FROM part)
    SELECT {_EXT_SQL} AS language, count(*) AS n FROM (SELECT lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS e FROM p) GROUP BY ALL""",
    ("nodes",),
)
def language_by_extension(spark, d):
    g = Graph(spark, d)
    ending = F.expr(f"element_at(array({_MANY_ENDINGS}), cast(p_partkey % 28 + 1 AS int))")
    paths = g.nodes.select("path").union(g.table("part").select(F.concat("p_name", F.lit("."), ending))).distinct()
    return paths.groupBy(scores.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


_PLACES = "CASE id % 11 WHEN 0 THEN 'node_modules/' || path WHEN 1 THEN 'a/dist/' || path WHEN 2 THEN '.vscode-test/' || path WHEN 3 THEN 'x/.git/' || path WHEN 4 THEN 'distant/' || path WHEN 5 THEN 'a/target' WHEN 6 THEN '.claude/b' WHEN 7 THEN 'build/' || path ELSE path END"


@query(f"WITH p AS (SELECT DISTINCT {_PLACES} AS path FROM nodes) SELECT path FROM p WHERE len(list_intersect(string_split(path, '/'), ['.claude', '.git', 'target', 'node_modules', 'dist', '.next', '.vscode', '.vscode-test'])) = 0", ("nodes",))
def source_walk(spark, d):
    return Graph(spark, d).nodes.select(F.expr(_PLACES).alias("path")).distinct().where(~scores.is_skipped(F.col("path")))


_O = "SELECT o_orderkey AS id, (o_custkey % 100) / CAST(100 AS DOUBLE) AS score, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50) / CAST(50 AS DOUBLE) END AS rr, o_orderkey % 4 = 0 AS is_primary, CASE o_orderstatus WHEN 'F' THEN 'strong' WHEN 'O' THEN 'weak' ELSE 'none' END AS confidence FROM orders"


def _scored(spark, d):
    status = F.col("o_orderstatus")
    conf = F.when(status == "F", "strong").when(status == "O", "weak").otherwise("none")
    return Graph(spark, d).table("orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") % 100) / 100.0).alias("score"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 50) / 50.0).alias("rr"), (F.col("o_orderkey") % 4 == 0).alias("is_primary"), conf.alias("confidence"))


@query(f"WITH o AS ({_O}) SELECT id, round(CASE WHEN rr IS NOT NULL THEN rr WHEN is_primary THEN c ELSE least(score, c) END, 6) AS shown FROM (SELECT *, CASE confidence WHEN 'strong' THEN CAST(1.0 AS DOUBLE) WHEN 'weak' THEN 0.6 ELSE 0.4 END AS c FROM o)")
def display_score(spark, d):
    s = _scored(spark, d)
    return s.select("id", F.round(scores.display_score(F.col("score"), F.col("rr"), F.col("is_primary"), F.col("confidence")), 6).alias("shown"))


@query(f"WITH o AS ({_O}) SELECT id, CASE WHEN is_primary AND id % 8 = 0 THEN 0 WHEN rr >= 0.5 THEN 1 WHEN rr IS NULL THEN 2 ELSE 3 END AS band, round(CASE WHEN rr <= 0.5 THEN 0.1 + 0.9 * rr / 0.5 ELSE 1 + (rr - 0.5) / 0.5 END, 6) AS multiplier FROM o")
def rerank_bands(spark, d):
    s = _scored(spark, d)
    return s.select("id", scores.rerank_band(F.col("rr"), F.col("is_primary") & (F.col("id") % 8 == 0)).alias("band"), F.when(F.col("rr").isNotNull(), F.round(scores.rerank_multiplier(F.col("rr")), 6)).alias("multiplier"))


@query("SELECT id, CASE WHEN test_role > 0 THEN 'tests' WHEN id % 3 = 0 THEN 'exact' WHEN id % 3 = 1 THEN 'semantic' ELSE 'relevant' END AS source FROM nodes", ("nodes",))
def match_source(spark, d):
    kind = F.when(F.col("id") % 3 == 0, "anchor").when(F.col("id") % 3 == 1, "knn").otherwise("lexical")
    return Graph(spark, d).nodes.select("id", scores.match_source(kind, F.col("test_role") > 0).alias("source"))


@query(
    f"WITH o AS ({_O}) SELECT id, row_number() OVER (ORDER BY CASE WHEN is_primary THEN 0 WHEN rr IS NOT NULL THEN 1 ELSE 2 END, score DESC, id) AS position FROM o ORDER BY position LIMIT 200".replace("ORDER BY position LIMIT", "ORDER BY position LIMIT")
)
def final_order(spark, d):
    rank = F.when(F.col("is_primary"), 0).when(F.col("rr").isNotNull(), 1).otherwise(2)
    best = _scored(spark, d).withColumn("r", rank).orderBy("r", F.desc("score"), "id").limit(200)
    return best.select("id", F.row_number().over(W.orderBy("r", F.desc("score"), "id")).alias("position"))


@query("SELECT o_custkey AS query_id, round(CASE WHEN count(*) FILTER (o_orderpriority <> '5-LOW') = 0 THEN 0.5 ELSE count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'F') / CAST(count(*) FILTER (o_orderpriority <> '5-LOW') AS DOUBLE) END, 6) AS coverage FROM orders GROUP BY o_custkey")
def token_coverage(spark, d):
    """The share of a query's content words that were resolved; a half for a query without any."""
    o = Graph(spark, d).table("orders").select("o_custkey", (F.col("o_orderpriority") != "5-LOW").alias("content"), (F.col("o_orderstatus") == "F").alias("resolved"))
    share = F.avg(F.when(F.col("content"), F.col("resolved").cast("int")))
    return o.groupBy(F.col("o_custkey").alias("query_id")).agg(F.round(F.coalesce(share, F.lit(0.5)), 6).alias("coverage"))


@query("WITH s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) AS sim FROM embeddings WHERE vec_id <> 7) SELECT vec_id, round(sim, 6) AS sim FROM s WHERE sim >= 0.1 ORDER BY sim DESC, vec_id LIMIT 20")
def doc_lane(spark, d):
    from skein.functions.identifiers import cosine

    e = Graph(spark, d).table("embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("v"))
    s = e.where("vec_id <> 7").crossJoin(F.broadcast(q)).select("vec_id", cosine(F.col("embedding"), F.col("v")).alias("sim"))
    return s.where("sim >= 0.1").orderBy(F.desc("sim"), "vec_id").limit(20).select("vec_id", F.round("sim", 6).alias("sim"))


@query("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT id) FROM nodes WHERE signature <> '') AS n_words, (SELECT count(*) FROM nodes) = (SELECT count(DISTINCT id) FROM nodes WHERE signature <> '') AS parity", ("nodes",))
def lexical_parity(spark, d):
    n = Graph(spark, d).nodes
    return n.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct(F.when(F.col("signature") != "", F.col("id"))).alias("n_words")).withColumn("parity", F.col("n_nodes") == F.col("n_words"))


@query(
    "SELECT '  \"' || s.signature || '\" -> \"' || t.signature || '\" [label=\"' || e.kind || '\"];' AS line FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id WHERE e.kind = 'defines/binding'",
    NE,
)
def graph_dot(spark, d):
    g = Graph(spark, d)
    return render.dot_lines(joins.with_signatures(g.edges.where("kind = 'defines/binding'").select("src", "dst", "kind"), g.nodes))


@query(_spine_sql(20000000006, 3, 4, "depth, src, repeat('  ', depth) || CAST(dst AS VARCHAR) AS line"), NE)
def graph_tree(spark, d):
    from skein.operators.traverse import call_spine

    g = Graph(spark, d)
    return render.tree_lines(call_spine(g.edges, g.nodes.select("id", F.col("corpus").alias("component")), spark.createDataFrame([(20000000006,)], "id long"), 3, 4))


@query("SELECT c_custkey AS setting, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'cli' END, CASE WHEN c_custkey % 3 = 0 THEN 'env' END, CASE WHEN c_custkey % 2 = 0 THEN 'repo' END, 'default') AS value, CASE WHEN c_custkey % 5 = 0 THEN 'cli' WHEN c_custkey % 3 = 0 THEN 'env' WHEN c_custkey % 2 = 0 THEN 'repo' ELSE 'default' END AS source FROM customer")
def layered_config(spark, d):
    k = F.col("c_custkey")
    value, source = scores.layered(("cli", F.when(k % 5 == 0, "cli")), ("env", F.when(k % 3 == 0, "env")), ("repo", F.when(k % 2 == 0, "repo")), ("default", F.lit("default")))
    return Graph(spark, d).table("customer").select(k.alias("setting"), value.alias("value"), source.alias("source"))


@query("WITH s(term, alias) AS (VALUES " + ", ".join(f"('{t}', '{a}')" for t, own in SYNONYMS.items() for a in own) + "), a AS (SELECT DISTINCT 'store' AS term, event_type AS alias FROM events) SELECT * FROM s WHERE term <> 'delete' UNION SELECT * FROM a WHERE alias <> 'view'")
def synonym_table(spark, d):
    """The table after adding aliases to one term, removing one alias and one term."""
    old = spark.createDataFrame([(t, a) for t, own in SYNONYMS.items() for a in own], "term string, alias string")
    added = Graph(spark, d).table("events").select(F.lit("store").alias("term"), F.col("event_type").alias("alias")).distinct()
    return old.where("term <> 'delete'").union(added.where("alias <> 'view'")).distinct()


@query("SELECT language, count(*) AS symbols, count(*) FILTER (line IS NOT NULL) AS placed, CASE WHEN count(*) FILTER (line IS NOT NULL) = 0 THEN 'syntax' WHEN count(*) FILTER (line IS NULL) = 0 THEN 'semantic' ELSE 'partial' END AS phase FROM nodes GROUP BY language", ("nodes",))
def language_status(spark, d):
    placed = F.sum(F.col("line").isNotNull().cast("long"))
    n = F.count(F.lit(1))
    phase = F.when(placed == 0, "syntax").when(placed == n, "semantic").otherwise("partial")
    return Graph(spark, d).nodes.groupBy("language").agg(n.alias("symbols"), placed.alias("placed"), phase.alias("phase"))


@query("SELECT max(ts) AS last_event, count(*) AS n, count(*) FILTER (event_type = 'error') AS pending, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'ready' ELSE 'updating' END AS readiness FROM events")
def index_status(spark, d):
    pending = F.sum((F.col("event_type") == "error").cast("long"))
    return Graph(spark, d).table("events").agg(F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("n"), pending.alias("pending"), F.when(pending == 0, "ready").otherwise("updating").alias("readiness"))


@query("WITH r AS (SELECT user_id, event_type, max(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) SELECT user_id, event_type FROM r WHERE k <= 3")
def session_terms(spark, d):
    t = Graph(spark, d).table("events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), "event_type")
    return t.withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_type")
