"""Scans, filters, projections, sinks, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.catalog import Graph, query
from skein.functions import identifiers as I
from skein.operators import filters, joins, merge
from skein.sources.storage import counted, running

NE = ("nodes", "edges")

_STRUCTURAL_SQL = filters.STRUCTURAL


@query("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE provenance = 'live') AS n_live, (SELECT count(*) FROM edge_sites) AS n_sites", ("nodes", "edges", "edge_sites"))
def graph_stats(spark, d):
    g = Graph(spark, d)
    n = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = g.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum((F.col("provenance") == "live").cast("long")).alias("n_live"))
    return n.crossJoin(e).crossJoin(g.sites.agg(F.count(F.lit(1)).alias("n_sites")))


@query("SELECT language, count(*) AS n FROM nodes GROUP BY language", ("nodes",))
def language_distribution(spark, d):
    return Graph(spark, d).nodes.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, signature FROM nodes", ("nodes",))
def node_scan(spark, d):
    return Graph(spark, d).nodes.select("id", "signature")


@query("SELECT src, dst, kind, provenance FROM edges", ("edges",))
def edge_scan(spark, d):
    return Graph(spark, d).edges.select("src", "dst", "kind", "provenance")


@query("SELECT n.* FROM nodes n WHERE id IN (SELECT dst FROM edges WHERE kind = 'depends')", NE)
def node_lookup(spark, d):
    g = Graph(spark, d)
    return g.nodes.join(g.edges.where("kind = 'depends'").select(F.col("dst").alias("id")), "id", "left_semi")


@query("SELECT e.src, e.dst, e.kind FROM edges e JOIN nodes n ON e.src = n.id WHERE n.kind = 'file'", NE)
def out_edges(spark, d):
    g = Graph(spark, d)
    return g.edges.join(g.nodes.where("kind = 'file'").select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "kind")


@query("SELECT e.src, e.dst, e.kind FROM edges e JOIN nodes n ON e.dst = n.id WHERE n.kind = 'method'", NE)
def in_edges(spark, d):
    g = Graph(spark, d)
    return g.edges.join(g.nodes.where("kind = 'method'").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind")


@query("SELECT DISTINCT path, kind FROM nodes WHERE kind IN ('function', 'class', 'method')", ("nodes",))
def definitions_by_path(spark, d):
    return Graph(spark, d).nodes.where(F.col("kind").isin("function", "class", "method")).select("path", "kind").distinct()


@query(
    rf"""SELECT id, regexp_matches(path, '{filters.VENDORED}') OR regexp_matches(signature, 'local [0-9]+$') AS noise,
    regexp_matches(path, '{filters.VENDORED}') OR regexp_matches(signature, 'local [0-9]+$') OR kind IN ('doc-chunk', 'crate') OR starts_with(signature, 'scip:') OR regexp_matches(path, '{_STRUCTURAL_SQL}') AS structural FROM nodes""",
    ("nodes",),
)
def node_scan_noise_filtered(spark, d):
    p, s = F.col("path"), F.col("signature")
    return Graph(spark, d).nodes.select("id", filters.is_noise(p, s).alias("noise"), filters.is_structural_noise(p, s, F.col("kind")).alias("structural"))


@query("SELECT e.src, e.dst, e.kind FROM edges e JOIN nodes n ON e.dst = n.id WHERE n.corpus IN ('asia', 'parts')", NE)
def rbac_edges(spark, d):
    g = Graph(spark, d)
    return filters.visible_edges(g.edges, g.nodes, ["asia", "parts"]).select("src", "dst", "kind")


@query("SELECT src, dst, kind, provenance FROM edges WHERE provenance <> 'live'", ("edges",))
def provenance_filter(spark, d):
    return filters.by_provenance(Graph(spark, d).edges, "ratified").select("src", "dst", "kind", "provenance")


@query(
    """SELECT kind, provenance, kind IN ('ref/call', 'ref/field', 'ffi/call', 'is-implementation', 'overrides', 'resolves-to') AS is_semantic,
    kind = 'defines/binding' AS is_containment, kind = 'ref/call' AND provenance = 'tree-sitter' AS is_heuristic, count(*) AS n FROM edges GROUP BY ALL""",
    ("edges",),
)
def heuristic_edges(spark, d):
    return filters.edge_flags(Graph(spark, d).edges).groupBy("kind", "provenance", "is_semantic", "is_containment", "is_heuristic").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT id, signature, CASE WHEN signature = 'order_1' OR regexp_replace(signature, '^[^:]*:', '') = 'order_1' THEN 'exact' WHEN ends_with(signature, ':order_1') OR ends_with(signature, '.order_1') THEN 'suffix'
    WHEN starts_with(regexp_replace(signature, '^[^:]*:', ''), 'order_1') THEN 'prefix' END AS how FROM nodes
    WHERE kind = 'function' AND starts_with(regexp_replace(signature, '^[^:]*:', ''), 'order_1')""",
    ("nodes",),
)
def exact_only_search(spark, d):
    n = Graph(spark, d).nodes.where("kind = 'function'").withColumn("how", filters.exact_kind(F.lit("order_1"), F.col("signature")))
    return n.where("how IS NOT NULL AND how <> 'substring'").select("id", "signature", "how")


@query("SELECT id, path FROM nodes WHERE path = 'brand_2/economy.rs' OR ends_with(path, '/brand_2/economy.rs') OR starts_with(path, 'brand_2/economy.rs/') OR contains(path, 'brand_2/economy.rs')", ("nodes",))
def path_hint(spark, d):
    return Graph(spark, d).nodes.where(filters.match_path_hint(F.col("path"), "brand_2/economy.rs")).select("id", "path")


_SEG = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), ' '), lambda x: x <> '')"
SEG = _SEG.format


@query(f"SELECT id, signature FROM nodes WHERE list_contains({SEG(c='signature')}, 'widget')", ("nodes",))
def segment_match(spark, d):
    return Graph(spark, d).nodes.where(I.contains_token("widget", F.col("signature"))).select("id", "signature")


@query(f"SELECT kind, list_distinct({SEG(c='signature')})[1] AS first, count(*) AS n, CAST(sum(len(list_distinct({SEG(c='signature')}))) AS BIGINT) AS segments FROM nodes WHERE kind IN ('file', 'class', 'type', 'package') GROUP BY ALL".replace(f"list_distinct({SEG(c='signature')})[1]", f"({SEG(c='signature')})[1]"), ("nodes",))
def identifier_segments(spark, d):
    n = Graph(spark, d).nodes.where(F.col("kind").isin("file", "class", "type", "package")).withColumn("s", I.segments(F.col("signature")))
    return n.groupBy("kind", F.element_at("s", 1).alias("first")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("s")).alias("segments"))


@query(
    """SELECT f.id, CAST(max(CASE WHEN c.test_role = 1 THEN 2 WHEN c.test_role = 2 THEN 1 ELSE 0 END) AS INT) AS role FROM nodes f JOIN nodes c ON f.path = c.path AND f.line BETWEEN c.line AND c.end_line
    WHERE f.kind = 'function' AND c.kind = 'class' AND c.test_role > 0 GROUP BY f.id""",
    ("nodes",),
)
def test_roles(spark, d):
    n = Graph(spark, d).nodes
    scopes = n.where("kind = 'class' AND test_role > 0").select("path", F.col("line").alias("a"), F.col("end_line").alias("b"), F.when(F.col("test_role") == 1, 2).otherwise(1).alias("rank"))
    return n.where("kind = 'function'").join(scopes, "path").where("line BETWEEN a AND b").groupBy("id").agg(F.max("rank").alias("role"))


@query(
    """, a AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS root FROM nodes WHERE id % 1000 = 7),
    s AS (SELECT id, path, (id % 100) / 100.0 AS norm FROM nodes) SELECT id, path FROM s WHERE NOT (array_to_string(string_split(path, '/')[1:2], '/') NOT IN (SELECT root FROM a) AND CAST(norm AS DOUBLE) < 0.3)""".lstrip(", ").join(("WITH ", "")),
    ("nodes",),
)
def scope_gate(spark, d):
    n = Graph(spark, d).nodes
    anchors = n.where("id % 1000 = 7").select(I.package_root(F.col("path")).alias("root")).distinct().withColumn("inside", F.lit(True))
    s = n.select("id", "path", ((F.col("id") % 100) / 100.0).cast("double").alias("norm"), I.package_root(F.col("path")).alias("root"))
    return s.join(counted(anchors), "root", "left").where("inside OR norm >= 0.3").select("id", "path")


@query("SELECT id, greatest(1, (strlen(signature) + strlen(kind) + strlen(path)) // 4) AS cost FROM nodes", ("nodes",))
def token_cost(spark, d):
    return Graph(spark, d).nodes.select("id", I.token_cost(F.col("signature"), F.col("kind"), F.col("path")).alias("cost"))


@query("SELECT id, CASE WHEN kind = 'file' THEN path WHEN kind = 'method' THEN regexp_replace(signature, '^[^:]*:', '') ELSE signature END AS label, list_last(string_split(regexp_replace(signature, '^[^:]*:', ''), '.')) AS leaf FROM nodes", ("nodes",))
def display_label(spark, d):
    s = F.col("signature")
    label = F.when(F.col("kind") == "file", F.col("path")).when(F.col("kind") == "method", F.regexp_replace(s, "^[^:]*:", "")).otherwise(s)
    return Graph(spark, d).nodes.select("id", label.alias("label"), I.leaf_of(s).alias("leaf"))


@query("SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS package_key, count(*) AS n FROM nodes GROUP BY ALL", ("nodes",))
def package_key(spark, d):
    return Graph(spark, d).nodes.groupBy(I.package_key(F.col("path")).alias("package_key")).agg(F.count(F.lit(1)).alias("n"))


# Sinks


@query(
    """WITH b AS (SELECT src, dst, kind, provenance FROM edges UNION ALL SELECT src, dst, kind, CASE (src + dst + 1) % 3 WHEN 0 THEN 'tree-sitter' WHEN 1 THEN 'scip' ELSE 'live' END FROM edges WHERE src % 2 = 0)
    SELECT src, dst, kind, provenance FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY CASE provenance WHEN 'scip' THEN 0 WHEN 'live' THEN 1 ELSE 2 END) AS n FROM b) WHERE n = 1""",
    ("edges",),
)
def provenance_upsert(spark, d):
    e = Graph(spark, d).edges.select("src", "dst", "kind", "provenance")
    again = e.where("src % 2 = 0").withColumn("provenance", F.expr("CASE (src + dst + 1) % 3 WHEN 0 THEN 'tree-sitter' WHEN 1 THEN 'scip' ELSE 'live' END"))
    return merge.provenance_upsert(e.union(again))


@query("SELECT src AS id, max(line) AS line, CAST(arg_max(dst, line * 100000000000 + dst) AS BIGINT) AS dst FROM edge_sites GROUP BY src", ("edge_sites",))
def staging_flush(spark, d):
    return merge.staging_flush(Graph(spark, d).sites.select(F.col("src").alias("id"), "line", "dst"))


@query(
    """WITH gone AS (SELECT id FROM nodes WHERE starts_with(path, 'parts/brand_1'))
    SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS nodes_left, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) AS edges_left, (SELECT count(*) FROM gone) AS tombstones""",
    NE,
)
def delete_prefix_tombstones(spark, d):
    g = Graph(spark, d)
    n, e, t = merge.delete_prefix(g.nodes, g.edges, "parts/brand_1")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(n, "nodes_left").crossJoin(count(e, "edges_left")).crossJoin(count(t, "tombstones"))


@query(
    """WITH old AS (SELECT id, signature, line, end_line FROM nodes WHERE kind = 'class'), new AS (SELECT id, CASE WHEN id % 9 = 0 THEN signature || '_v2' ELSE signature END AS signature, line, end_line FROM nodes WHERE kind = 'class' AND id % 10 <> 0),
    c AS (SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NULL THEN 'removed' WHEN old.id IS NULL THEN 'added' WHEN old.signature <> new.signature THEN 'changed' END AS change FROM old FULL JOIN new ON old.id = new.id)
    SELECT c.id, change, coalesce(n, 0) AS callers FROM c LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM edges GROUP BY dst) ON dst = c.id WHERE change IS NOT NULL""",
    NE,
)
def reindex_replace_report(spark, d):
    g = Graph(spark, d)
    old = g.nodes.where("kind = 'class'")
    new = old.where("id % 10 <> 0").withColumn("signature", F.when(F.col("id") % 9 == 0, F.concat("signature", F.lit("_v2"))).otherwise(F.col("signature")))
    return merge.replace_report(old, new, g.edges)


@query(
    """WITH lost AS (SELECT id FROM nodes WHERE kind = 'method' AND id % 9 = 0)
    SELECT path, count(DISTINCT dst) AS removed, count(*) AS refs FROM edges JOIN lost ON dst = lost.id JOIN nodes s ON src = s.id WHERE path NOT IN (SELECT path FROM nodes WHERE kind = 'method') GROUP BY path""",
    NE,
)
def dirty_callers(spark, d):
    g = Graph(spark, d)
    old = g.nodes.where("kind = 'method'")
    return merge.dirty_files(old, old.where("id % 9 <> 0"), g.nodes, g.edges).withColumnRenamed("references", "refs")


@query(r"SELECT page_id, replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g'), '<', '&lt;'), '>', '&gt;') AS clean FROM pages")
def sanitize_text(spark, d):
    from skein.functions.text import sanitize

    return Graph(spark, d).table("pages").select("page_id", sanitize(F.col("html")).alias("clean"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '/(home|Users)/[^/\s]+', '/\1/[user]', 'g'), '(?i)bearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [redacted]', 'g'),
    '\b(sk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{12,}', '[redacted]', 'g'), '(?i)\b(api[_-]?key|token|secret|password)\b(\s*[=:]\s*)\S+', '\1\2[redacted]', 'g') AS redacted FROM documents"""
)
def redact_secrets(spark, d):
    from skein.functions.text import redact

    return Graph(spark, d).table("documents").select("doc_id", redact(F.col("text")).alias("redacted"))


# Joins


@query("SELECT e.src, e.dst, e.kind, coalesce(s.signature, '') AS src_sig, coalesce(t.signature, '') AS dst_sig FROM edges e LEFT JOIN nodes s ON e.src = s.id LEFT JOIN nodes t ON e.dst = t.id WHERE e.kind <> 'exports'", NE)
def edge_signatures(spark, d):
    g = Graph(spark, d)
    return joins.with_signatures(g.edges.where("kind <> 'exports'").select("src", "dst", "kind"), g.nodes).select("src", "dst", "kind", "src_sig", "dst_sig")


@query(
    """WITH s AS (SELECT DISTINCT path, CAST(line + 3 AS INT) AS line FROM nodes WHERE kind = 'function')
    SELECT path, line, coalesce((SELECT arg_min(n.id, (n.end_line - n.line) * 1000000000000 + n.id) FROM nodes n WHERE n.path = s.path AND s.line BETWEEN n.line AND n.end_line), (SELECT min(id) FROM nodes f WHERE f.kind = 'file' AND f.path = s.path)) AS owner FROM s""",
    ("nodes",),
)
def span_attribution(spark, d):
    n = Graph(spark, d).nodes
    sites = n.where("kind = 'function'").select("path", (F.col("line") + 3).cast("int").alias("line")).distinct()
    return joins.span_attribution(sites, n)


@query(
    """WITH r AS (SELECT id AS ref_id, path, signature, CAST(line + id % 13 - 4 AS INT) AS line FROM nodes WHERE line IS NOT NULL),
    j AS (SELECT ref_id, n.id AS node_id, abs(r.line - n.line) AS gap, NOT (r.line BETWEEN n.line AND n.end_line) AS out FROM r JOIN nodes n ON r.path = n.path AND r.signature = n.signature WHERE r.line BETWEEN n.line AND n.end_line OR abs(r.line - n.line) <= 5)
    SELECT ref_id, node_id, CAST(gap AS INT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY out, gap, node_id) AS k FROM j) WHERE k = 1""",
    ("nodes",),
)
def nearest_line(spark, d):
    n = Graph(spark, d).nodes
    refs = n.where("line IS NOT NULL").select(F.col("id").alias("ref_id"), "path", "signature", (F.col("line") + F.col("id") % 13 - 4).cast("int").alias("line"))
    return joins.nearest_line(refs, n)


@query(
    """WITH f AS (SELECT id AS sym_id, CASE WHEN id % 3 = 0 THEN path ELSE 'moved/' || path END AS path, language, CASE WHEN id % 7 = 0 THEN 'sym:gone' ELSE signature END AS symbol FROM nodes WHERE kind IN ('class', 'method', 'function')),
    n AS (SELECT id, path, language, list_last(string_split(regexp_replace(signature, '^[^:]*:', ''), '.')) AS leaf FROM nodes WHERE kind NOT IN ('file', 'doc-chunk', 'package')),
    g AS (SELECT *, list_last(string_split(regexp_replace(symbol, '^[^:]*:', ''), '.')) AS leaf FROM f),
    a AS (SELECT sym_id, min(n.id) AS one FROM g JOIN n ON g.leaf = n.leaf AND g.path = n.path GROUP BY sym_id),
    b AS (SELECT sym_id, min(n.id) AS two FROM g JOIN n ON g.leaf = n.leaf AND g.language = n.language WHERE sym_id NOT IN (SELECT sym_id FROM a) GROUP BY sym_id HAVING count(DISTINCT n.id) = 1)
    SELECT g.sym_id, coalesce(one, two) AS node_id, CASE WHEN one IS NOT NULL THEN 'same-file' WHEN two IS NOT NULL THEN 'unique' ELSE 'missed' END AS rung FROM g LEFT JOIN a USING (sym_id) LEFT JOIN b USING (sym_id)""",
    ("nodes",),
)
def unify_ladder(spark, d):
    n = Graph(spark, d).nodes
    f = n.where("kind IN ('class', 'method', 'function')").select(F.col("id").alias("sym_id"), F.expr("CASE WHEN id % 3 = 0 THEN path ELSE 'moved/' || path END").alias("path"), "language", F.expr("CASE WHEN id % 7 = 0 THEN 'sym:gone' ELSE signature END").alias("symbol"))
    return joins.unify(f, n)


#: Definitions as a compiler would name them, beside the graph's nodes with copies of some; read alike by Spark and by the SQL that defines the results.
_TWICE = """SELECT id, path, language, signature, kind, line, end_line FROM nodes
    UNION ALL SELECT id + 1000000000000, 'copy/' || path, language, signature, kind, line, end_line FROM nodes WHERE id % 10 = 8 AND kind IN ('class', 'method', 'function')
    UNION ALL SELECT id + 2000000000000, path, language, signature, kind, line + 60, end_line + 60 FROM nodes WHERE id % 10 = 3 AND kind IN ('class', 'method', 'function')"""
_FOREIGN = """SELECT id * 2 AS sym_id, signature AS symbol, CASE WHEN id % 10 = 7 THEN '<describe x>' WHEN kind = 'method' THEN split_part(regexp_replace(signature, '^[^:]*:', ''), '.', 1) END AS container,
    CASE WHEN id % 10 = 0 THEN '<it works>' WHEN id % 10 = 5 THEN 'gone' WHEN kind = 'method' THEN split_part(regexp_replace(signature, '^[^:]*:', ''), '.', 2) ELSE regexp_replace(signature, '^[^:]*:', '') END AS name,
    CASE WHEN kind = 'class' THEN 'class' ELSE 'function' END AS kind, language, CASE WHEN id % 10 = 2 THEN 'vendor/' || path WHEN id % 10 = 8 THEN 'users/app.py' ELSE path END AS path,
    CASE id % 10 WHEN 6 THEN CAST(NULL AS INT) WHEN 1 THEN line + 3 WHEN 3 THEN line + 1000 WHEN 8 THEN line + 5000 ELSE line END AS line FROM nodes WHERE kind IN ('class', 'method', 'function')
    UNION ALL SELECT id * 2 + 1, signature, NULL, regexp_replace(signature, '^[^:]*:', ''), CASE WHEN kind = 'class' THEN 'class' ELSE 'function' END, language, 'users/app.py', line + 7000 FROM nodes WHERE id % 10 = 4 AND kind IN ('class', 'method', 'function')"""
_SORT = "CASE WHEN kind IN ('function', 'method', 'constructor') THEN 'function' WHEN kind IN ('class', 'interface', 'struct', 'enum', 'trait', 'type') THEN 'class' ELSE 'variable' END"
_RUNGS = f"""WITH two AS ({_TWICE}), fo AS ({_FOREIGN}),
    k AS (SELECT id AS node_id, path, language AS fam, {_SORT} AS sort, regexp_replace(signature, '^[^:]*:', '') AS nm, line AS a, end_line AS b FROM two WHERE kind NOT IN ('file', 'doc-chunk', 'package')),
    f AS (SELECT *, {_SORT} AS sort, name LIKE '<it%' AS block, coalesce(container LIKE '<desc%', false) AND name NOT LIKE '<it%' AS inside, path IN (SELECT path FROM two) AS indexed FROM fo),
    g AS (SELECT * EXCLUDE (container), CASE WHEN inside THEN NULL ELSE container END AS container, CASE WHEN inside OR container IS NULL THEN name ELSE container || '.' || name END AS nm, indexed AND line IS NOT NULL AND NOT block AS op FROM f),
    one AS (SELECT sym_id, first(node_id ORDER BY CASE WHEN line BETWEEN a AND b THEN 0 ELSE 1 END, CASE WHEN line BETWEEN a AND b THEN b - a ELSE abs(line - a) END, node_id) AS one FROM g JOIN k USING (path, sort, nm) WHERE op AND (line BETWEEN a AND b OR abs(line - a) <= 5) GROUP BY sym_id),
    grp AS (SELECT fam, sort, nm, path, first(node_id ORDER BY a, node_id) AS node_id FROM k GROUP BY ALL),
    far AS (SELECT fam, sort, nm, count(*) AS n, min(node_id) AS only_id FROM grp GROUP BY ALL),
    tw AS (SELECT symbol, arg_min(one, sym_id) AS two FROM g JOIN one USING (sym_id) GROUP BY symbol),
    ov AS (SELECT sym_id, symbol, node_id AS three FROM g JOIN grp ON g.language = fam AND g.sort = grp.sort AND g.nm = grp.nm AND g.path = grp.path WHERE op AND NOT inside AND container IS NOT NULL AND g.sort = 'function'),
    lt AS (SELECT symbol, arg_min(three, sym_id) AS late FROM ov GROUP BY symbol),
    al AS (SELECT g.*, one, CASE WHEN op AND NOT inside THEN two END AS two, three, CASE WHEN op AND NOT inside THEN late END AS late, CASE WHEN op AND NOT inside AND g.sort <> 'variable' THEN coalesce(n, 0) ELSE 0 END AS candidates, only_id
        FROM g LEFT JOIN one USING (sym_id) LEFT JOIN tw USING (symbol) LEFT JOIN (SELECT sym_id, three FROM ov) USING (sym_id) LEFT JOIN lt USING (symbol) LEFT JOIN far ON g.language = far.fam AND g.sort = far.sort AND g.nm = far.nm),
    res AS (SELECT sym_id, symbol, language, path, line, kind, coalesce(one, two, three, late, CASE WHEN candidates = 1 THEN only_id END) AS node_id,
        CASE WHEN block THEN 'dropped' WHEN NOT indexed THEN 'unindexed' WHEN line IS NULL THEN 'unplaced' WHEN one IS NOT NULL THEN 'span' WHEN inside THEN 'dropped' WHEN two IS NOT NULL THEN 'twin' WHEN three IS NOT NULL THEN 'overload' WHEN late IS NOT NULL THEN 'twin' WHEN candidates = 1 THEN 'family' WHEN candidates > 1 THEN 'ambiguous' ELSE 'missed' END AS rung, candidates FROM al)
    """


def _rungs(spark, d):
    n = Graph(spark, d).nodes
    return joins.unify_rungs(spark.sql(_FOREIGN.replace("FROM nodes", "FROM {nodes}"), nodes=n), spark.sql(_TWICE.replace("FROM nodes", "FROM {nodes}"), nodes=n))


@query(_RUNGS + "SELECT * FROM res", ("nodes",))
def unify_rungs(spark, d):
    return _rungs(spark, d)


@query(
    _RUNGS + """SELECT language, symbol, path, line, kind, candidates FROM (SELECT *, count(node_id) OVER (PARTITION BY symbol) AS met, row_number() OVER (PARTITION BY symbol ORDER BY sym_id) AS r FROM res WHERE rung NOT IN ('dropped', 'unindexed', 'unplaced')) WHERE met = 0 AND r = 1""",
    ("nodes",),
)
def unify_misses(spark, d):
    return joins.unify_misses(_rungs(spark, d))


@query("WITH al AS (SELECT id AS alias, id - id % 4 AS target FROM nodes WHERE kind = 'method' AND id % 4 <> 0) SELECT e.src, e.kind, coalesce(target, e.dst) AS callee FROM edges e LEFT JOIN al ON e.dst = al.alias WHERE e.kind IN ('ref/call', 'ffi/call')", NE)
def alias_rewrite(spark, d):
    g = Graph(spark, d)
    aliases = g.nodes.where("kind = 'method' AND id % 4 <> 0").select(F.col("id").alias("alias"), (F.col("id") - F.col("id") % 4).alias("target"))
    return joins.alias_rewrite(g.edges.where("kind IN ('ref/call', 'ffi/call')").select("src", "kind", F.col("dst").alias("callee")), aliases)


@query(
    """WITH files AS (SELECT path, min(id) AS id FROM nodes GROUP BY path),
    imp AS (SELECT id AS import_id, CASE WHEN id % 3 = 0 THEN 'java' WHEN id % 3 = 1 THEN 'rust' ELSE 'typescript' END AS language, 'import:' || CASE WHEN id % 2 = 0 THEN regexp_replace(path, '\\.[a-z]+$', '') ELSE regexp_replace(regexp_replace(path, '\\.[a-z]+$', ''), '^[^/]*/', '') END AS spec FROM files WHERE contains(path, '.')),
    k AS (SELECT import_id, CASE language WHEN 'java' THEN replace(substr(spec, 8), '.', '/') || '.java' WHEN 'rust' THEN substr(spec, 8) || '.rs' ELSE substr(spec, 8) || '.ts' END AS key FROM imp)
    SELECT DISTINCT import_id, f.id AS file_id FROM k JOIN files f ON f.path = key OR ends_with(f.path, '/' || key)""".replace("\\\\", "\\"),
    ("nodes",),
)
def import_resolution(spark, d):
    files = Graph(spark, d).nodes.groupBy("path").agg(F.min("id").alias("id"))
    bare = F.regexp_replace("path", "\\.[a-z]+$", "")
    spec = F.concat(F.lit("import:"), F.when(F.col("id") % 2 == 0, bare).otherwise(F.regexp_replace(bare, "^[^/]*/", "")))
    imports = files.where("contains(path, '.')").select(F.col("id").alias("import_id"), F.expr("CASE WHEN id % 3 = 0 THEN 'java' WHEN id % 3 = 1 THEN 'rust' ELSE 'typescript' END").alias("language"), spec.alias("spec"))
    return joins.resolve_imports(imports, files)


_IMPORTS = """WITH f AS (SELECT path, min(id) AS id FROM nodes GROUP BY path), d AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM f WHERE contains(path, '/'))"""


@query(
    _IMPORTS + """, g AS (SELECT id AS import_id, path, 'example.com/x/' || folder AS spec FROM d)
    SELECT import_id, g.path, t.id AS file_id, t.path AS target, 'module folder' AS rule FROM g JOIN d t ON g.spec = t.folder OR ends_with(g.spec, '/' || t.folder)
    UNION ALL SELECT d.id, d.path, t.id, t.path, 'relative' FROM d JOIN f t ON t.path = d.folder || '/building.ts' WHERE ends_with(d.path, '.ts')
    UNION ALL SELECT d.id, d.path, t.id, t.path, 'library' FROM d JOIN f t ON t.path = regexp_replace(d.path, '^[^/]*/', '') OR ends_with(t.path, '/' || regexp_replace(d.path, '^[^/]*/', '')) WHERE ends_with(d.path, '.md')""",
    ("nodes",),
)
def import_resolvers(spark, d):
    """Imports of three kinds made of all paths: a Go module of each folder, the sibling ./building of each script, a library of each document."""
    from skein.operators import imports

    files = Graph(spark, d).nodes.groupBy("path").agg(F.min("id").alias("file_id"))
    f = files.where("contains(path, '/')").select(F.col("file_id").alias("import_id"), "path", imports.folder(F.col("path")).alias("folder"))
    row = lambda df, language, spec: df.select("import_id", F.lit(language).alias("language"), spec.alias("spec"), "path")
    made = row(f, "go", F.concat(F.lit("import:example.com/x/"), "folder")).unionByName(row(f.where(F.col("path").endswith(".ts")), "typescript", F.lit("./building")))
    made = made.unionByName(row(f.where(F.col("path").endswith(".md")), "dart", F.concat(F.lit("package:"), "path")))
    return imports.resolve(made, files)


@query(
    """WITH f AS (SELECT path, min(id) AS id FROM nodes WHERE kind IN ('class', 'file') GROUP BY path), c AS (SELECT f.id AS importer, unnest([regexp_replace(path, '/[^/]*$', '') || '/machinery.ts', regexp_replace(path, '/[^/]*$', '') || '/machinery/index.ts', regexp_replace(path, '/[^/]*$', '') || '/building.ts']) AS candidate FROM f)
    SELECT importer, f.id AS target FROM c JOIN f ON candidate = f.path WHERE importer <> f.id""",
    ("nodes",),
)
def import_candidates(spark, d):
    from skein.operators.ingest import link_candidates

    files = Graph(spark, d).nodes.where("kind IN ('class', 'file')").groupBy("path").agg(F.min("id").alias("id"))
    return link_candidates(files, ["machinery.ts", "machinery/index.ts", "building.ts"])


@query("WITH f AS (SELECT id, package FROM nodes WHERE kind = 'file') SELECT a.id AS src, b.id AS dst, 'depends' AS kind FROM f a JOIN f b ON a.package = b.package AND a.id <> b.id", ("nodes",))
def copackage_edges(spark, d):
    return joins.copackage_edges(Graph(spark, d).nodes.where("kind = 'file'").select("id", "package"))


@query(
    """WITH c AS (SELECT id AS src, 'Native_Order' || CAST(id % 50 AS VARCHAR) AS name, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 3 END AS arity FROM nodes WHERE kind = 'class'), t AS (SELECT id AS dst, 'nativeorder' || CAST(id % 50 AS VARCHAR) AS name, id % 3 AS arity FROM nodes WHERE kind = 'method' AND id % 40 = 0),
    s AS (SELECT src, dst, 'ffi/call' AS kind, CAST(CASE WHEN c.arity IS NULL THEN 50 WHEN c.arity = t.arity THEN 90 ELSE 30 END AS INT) AS confidence FROM c JOIN t ON lower(regexp_replace(c.name, '[^A-Za-z0-9]', '', 'g')) = t.name)
    SELECT * FROM s UNION ALL SELECT dst, src, 'ref/call', confidence FROM s WHERE confidence >= 80""",
    ("nodes",),
)
def ffi_edges(spark, d):
    n = Graph(spark, d).nodes
    calls = n.where("kind = 'class'").select(F.col("id").alias("src"), F.lit("x").alias("corpus"), F.lit("rust").alias("target_language"), F.concat(F.lit("Native_Order"), (F.col("id") % 50).cast("string")).alias("name"), F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE id % 3 END").alias("arity"))
    targets = n.where("kind = 'method' AND id % 40 = 0").select("id", F.lit("x").alias("corpus"), "language", F.concat(F.lit("nativeorder"), (F.col("id") % 50).cast("string")).alias("name"), (F.col("id") % 3).alias("arity"))
    return joins.ffi_edges(calls, targets)


@query(
    """WITH w AS (SELECT p_partkey AS dep_id, p_brand AS workspace, p_name AS name FROM part), p AS (SELECT p_brand AS workspace, p_name AS name, CAST(p_size AS VARCHAR) AS version, p_partkey AS position FROM part WHERE p_partkey % 5 = 0)
    SELECT dep_id, workspace, name, coalesce((SELECT arg_max(version, position) FROM p WHERE p.workspace = w.workspace AND p.name = w.name), 'workspace') AS version FROM w"""
)
def workspace_versions(spark, d):
    p = Graph(spark, d).table("part")
    wanted = p.select(F.col("p_partkey").alias("dep_id"), F.col("p_brand").alias("workspace"), F.col("p_name").alias("name"))
    given = p.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("workspace"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_partkey").alias("position"))
    return joins.with_inherited_version(wanted, given).select("dep_id", "workspace", "name", "version")


@query(
    """WITH c AS (SELECT row_number() OVER (ORDER BY src, dst) AS call_id, e.src, 'rust' AS language, 'parts' AS corpus, CASE WHEN dst % 5 = 0 THEN 'method:none' ELSE n.signature END AS callee FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.kind = 'ffi/call'),
    j AS (SELECT call_id, count(n.id) AS k, max(n.id) AS target FROM c LEFT JOIN nodes n ON n.signature = c.callee AND n.language = c.language AND n.corpus = c.corpus AND n.kind IN ('function', 'method', 'class') GROUP BY call_id)
    SELECT c.call_id, CASE WHEN k = 1 THEN target END AS target FROM c JOIN j USING (call_id)""",
    NE,
)
def call_resolution(spark, d):
    g = Graph(spark, d)
    n = g.nodes
    e = g.edges.where("kind = 'ffi/call'").select("src", "dst").join(n.select(F.col("id").alias("dst"), "signature"), "dst")
    ranked = running(e.withColumn("_one", F.lit(1)), ["src", "dst"], "_one").select(F.col("number").cast("long").alias("call_id"), "src", F.lit("rust").alias("language"), F.lit("parts").alias("corpus"), F.when(F.col("dst") % 5 == 0, "method:none").otherwise(F.col("signature")).alias("callee"))
    return joins.resolve_calls(ranked, n)


@query("SELECT DISTINCT n.path FROM nodes n JOIN edges e ON n.id = e.src WHERE e.kind = 'depends' AND e.dst IN (SELECT id FROM nodes WHERE signature = 'class:Supplier_000000003')", NE)
def files_importing(spark, d):
    g = Graph(spark, d)
    target = g.nodes.where("signature = 'class:Supplier_000000003'").select(F.col("id").alias("dst"))
    return g.nodes.join(g.edges.where("kind = 'depends'").join(target, "dst", "left_semi").select(F.col("src").alias("id")), "id", "left_semi").select("path").distinct()


@query("SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE kind <> 'type') OR dst NOT IN (SELECT id FROM nodes WHERE kind <> 'type')", NE)
def orphan_edges(spark, d):
    g = Graph(spark, d)
    ids = g.nodes.where("kind <> 'type'").select("id")
    e = g.edges.select("src", "dst", "kind")
    no_src = e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "kind")
    no_dst = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "kind")
    return no_src.union(no_dst)


@query(
    """SELECT n.path, s.line, bool_or(e.kind = 'ref/call' AND e.provenance = 'tree-sitter') AS heuristic, bool_or(e.provenance = 'live') AS live, count(*) AS n
    FROM edge_sites s JOIN edges e ON s.src = e.src AND s.dst = e.dst AND s.kind = e.kind JOIN nodes n ON s.src = n.id GROUP BY n.path, s.line""",
    ("nodes", "edges", "edge_sites"),
)
def reference_sites(spark, d):
    g = Graph(spark, d)
    e = filters.edge_flags(g.edges).select("src", "dst", "kind", "is_heuristic", (F.col("provenance") == "live").alias("is_live"))
    j = g.sites.join(e, ["src", "dst", "kind"]).join(g.nodes.select(F.col("id").alias("src"), "path"), "src")
    return j.groupBy("path", "line").agg(F.bool_or("is_heuristic").alias("heuristic"), F.bool_or("is_live").alias("live"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT n.path FROM edges e JOIN nodes n ON e.src = n.id WHERE e.dst IN (SELECT id FROM nodes WHERE kind = 'method' AND id % 500 = 1) ORDER BY n.path LIMIT 64", NE)
def reverse_closure(spark, d):
    g = Graph(spark, d)
    dirty = g.nodes.where("kind = 'method' AND id % 500 = 1").select(F.col("id").alias("dst"))
    src = g.edges.join(dirty, "dst", "left_semi").select(F.col("src").alias("id"))
    return g.nodes.join(src, "id", "left_semi").select("path").distinct().orderBy("path").limit(64)


@query(
    """WITH h AS (SELECT o_orderkey AS hunk_id, n.path, CAST(o_orderkey % 1900 + 2 AS INT) AS a, CAST(o_orderkey % 1900 + 8 AS INT) AS b FROM orders JOIN nodes n ON n.id = 60000000000 + o_orderkey),
    t AS (SELECT hunk_id, n.id, n.line, n.end_line FROM h JOIN nodes n ON h.path = n.path WHERE n.line <= b AND n.end_line >= a)
    SELECT hunk_id, id FROM t WHERE NOT EXISTS (SELECT 1 FROM t i WHERE i.hunk_id = t.hunk_id AND i.id <> t.id AND i.line >= t.line AND i.end_line <= t.end_line AND i.end_line - i.line < t.end_line - t.line)""",
    ("nodes",),
)
def edit_overlap(spark, d):
    g = Graph(spark, d)
    o = g.table("orders").select(F.col("o_orderkey").alias("hunk_id"), (F.col("o_orderkey") + 60000000000).alias("id"), (F.col("o_orderkey") % 1900 + 2).alias("hunk_start"), (F.col("o_orderkey") % 1900 + 8).alias("hunk_end"))
    return joins.edit_overlap(o.join(g.nodes.select("id", "path"), "id").drop("id"), g.nodes)


# Aggregates


@query("SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY dst", ("edges",))
def in_degree(spark, d):
    return Graph(spark, d).edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


@query(f"SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest({SEG(c='signature')}) AS token FROM nodes) GROUP BY token", ("nodes",))
def document_frequency(spark, d):
    return Graph(spark, d).nodes.select("id", F.explode(I.segments(F.col("signature"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query("SELECT a AS id, count(DISTINCT b) AS degree FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) WHERE a <> b GROUP BY a", ("edges",))
def distinct_degree(spark, d):
    e = Graph(spark, d).edges
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    return both.where("a <> b").distinct().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


@query("SELECT id, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS norm FROM (SELECT dst AS id, count(*) AS n FROM edges WHERE kind = 'ref/call' GROUP BY dst)", ("edges",))
def max_normalised(spark, d):
    n = Graph(spark, d).edges.where("kind = 'ref/call'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).select("id", F.round(F.col("n") / F.col("top"), 6).alias("norm"))


_PK = "CASE WHEN contains({c}, '/') THEN string_split({c}, '/')[1] ELSE '(root)' END".format


@query(
    f"""WITH k AS (SELECT id, path, {_PK(c='path')} AS pk FROM nodes), x AS (SELECT s.pk AS a, t.pk AS b FROM edges e JOIN k s ON e.src = s.id JOIN k t ON e.dst = t.id WHERE s.pk <> t.pk)
    SELECT pk AS package_key, count(DISTINCT path) AS files, coalesce((SELECT count(*) FROM x WHERE a = pk), 0) AS edges_out, coalesce((SELECT count(DISTINCT a) FROM x WHERE b = pk), 0) AS dependents FROM k GROUP BY pk""",
    NE,
)
def overview_tiles(spark, d):
    from skein.operators.overview import tiles

    g = Graph(spark, d)
    return tiles(g.nodes, g.edges)


@query(
    """WITH s AS (SELECT id, unnest([array_to_string(string_split(path, '/')[1:k], '/') FOR k IN range(1, len(string_split(path, '/')))]) AS dir FROM nodes), x AS (SELECT DISTINCT t.dir, e.src FROM edges e JOIN s t ON e.dst = t.id)
    SELECT s.dir, count(*) AS symbols, coalesce(any_value(n), 0) AS dependents FROM s LEFT JOIN (SELECT dir, count(*) AS n FROM x GROUP BY dir) y ON s.dir = y.dir GROUP BY s.dir""",
    NE,
)
def repo_map(spark, d):
    from skein.operators.overview import directory_rollup

    g = Graph(spark, d)
    return directory_rollup(g.nodes, g.edges)


@query(
    """WITH p AS (SELECT coalesce(path, '') AS path, count(*) AS symbols, string_split(coalesce(path, ''), '/') AS parts FROM nodes GROUP BY 1),
    x AS (SELECT path, symbols, parts, unnest(range(0, len(parts))) AS depth FROM p),
    a AS (SELECT *, array_to_string(parts[1:depth], '/') AS dir, CASE WHEN depth + 1 < len(parts) THEN array_to_string(parts[1:depth + 1], '/') END AS child FROM x),
    f AS (SELECT depth, dir, sum(symbols) AS w, count(DISTINCT child) + max(CASE WHEN child IS NULL THEN 1 ELSE 0 END) - 1 AS added FROM a GROUP BY ALL HAVING count(child) > 0),
    s AS (SELECT depth, dir FROM (SELECT *, sum(added) OVER (ORDER BY w DESC, depth, dir ROWS UNBOUNDED PRECEDING) AS run FROM f) WHERE run + 1 <= 40),
    m AS (SELECT path, max(depth) AS d FROM a JOIN s USING (depth, dir) GROUP BY path),
    t AS (SELECT p.path, symbols, d IS NULL OR d + 1 < len(parts) AS whole, CASE WHEN d IS NULL THEN '' WHEN d + 1 < len(parts) THEN array_to_string(parts[1:d + 1], '/') WHEN d = 0 THEN '*' ELSE array_to_string(parts[1:d], '/') || '/*' END AS tile FROM p LEFT JOIN m USING (path)),
    i AS (SELECT DISTINCT s.path AS a, v.path AS b FROM edges JOIN nodes s ON src = s.id JOIN nodes v ON dst = v.id),
    u AS (SELECT tb.tile, tb.whole, count(DISTINCT a) AS n FROM i JOIN t ta ON ta.path = a JOIN t tb ON tb.path = b WHERE ta.tile <> tb.tile OR ta.whole <> tb.whole GROUP BY ALL)
    SELECT CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, symbols DESC, tile, whole) AS INT) AS rank, tile, whole, files, symbols, coalesce(n, 0) AS dependents
    FROM (SELECT tile, whole, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols FROM t GROUP BY ALL) LEFT JOIN u USING (tile, whole)""",
    NE,
)
def repo_map_budget(spark, d):
    from skein.operators.overview import repo_map as within

    g = Graph(spark, d)
    return within(g.nodes, g.edges, 40)


@query("SELECT s.corpus AS component, t.corpus AS target, round(sum(CASE e.kind WHEN 'ref/call' THEN 1.0 WHEN 'ffi/call' THEN 0.85 WHEN 'depends' THEN 0.5 ELSE 0.3 END), 4) AS weight FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id WHERE s.corpus <> t.corpus GROUP BY ALL".replace("round(sum", "CAST(round(sum").replace(", 4) AS", ", 4) AS DOUBLE) AS"), NE)
def component_deps(spark, d):
    from skein.operators.overview import component_dependencies

    g = Graph(spark, d)
    w = F.expr("CASE kind WHEN 'ref/call' THEN 1.0D WHEN 'ffi/call' THEN 0.85D WHEN 'depends' THEN 0.5D ELSE 0.3D END")
    return component_dependencies(g.nodes, g.edges.withColumn("weight", w), "corpus").select("component", "target", F.round("weight", 4).alias("weight"))


@query(
    """WITH r AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority = '1-URGENT' AS hit FROM orders), f AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS first FROM r GROUP BY query_id)
    SELECT count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit3, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f"""
)
def ir_metrics(spark, d):
    from pyspark.sql import Window as W

    from skein.operators.ranking import retrieval_metrics

    o = Graph(spark, d).table("orders")
    r = o.select(F.col("o_custkey").alias("query_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"), (F.col("o_orderpriority") == "1-URGENT").alias("hit"))
    return retrieval_metrics(r)


@query("SELECT count(*) AS n, count(*) FILTER (o IS NULL) AS abstained, round(avg(CASE WHEN (o IS NOT NULL) = (c_custkey % 4 <> 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey")
def abstain_accuracy(spark, d):
    """Customers are queries, their orders the results; those with a number of 1 modulo 4 are marked as without answer."""
    from skein.operators.ranking import abstain_accuracy

    g = Graph(spark, d)
    return abstain_accuracy(g.table("customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 4 != 1).alias("answerable")), g.table("orders").select(F.col("o_custkey").alias("query_id")))


@query("WITH a AS (SELECT DISTINCT src, dst FROM edge_sites), u AS (SELECT DISTINCT src, dst FROM edges WHERE provenance = 'scip'), m AS (SELECT * FROM a EXCEPT SELECT * FROM u) SELECT (SELECT count(*) FROM a) AS attempted, (SELECT count(*) FROM m) AS missed, round((SELECT count(*) FROM m) / (SELECT count(*) FROM a), 6) AS rate", ("edges", "edge_sites"))
def miss_rate(spark, d):
    g = Graph(spark, d)
    unified = g.edges.where("provenance = 'scip'").select("src", "dst").distinct().withColumn("hit", F.lit(1))
    j = g.sites.select("src", "dst").distinct().join(unified, ["src", "dst"], "left")
    missed = F.count(F.lit(1)) - F.count("hit")
    return j.agg(F.count(F.lit(1)).alias("attempted"), missed.alias("missed"), F.round(missed / F.count(F.lit(1)), 6).alias("rate"))


@query(
    """SELECT e.src, e.dst, e.kind FROM (SELECT src, dst, kind FROM edges UNION ALL SELECT src, src, 'ref/call' FROM edge_sites UNION ALL SELECT dst, src, 'is-implementation' FROM edges WHERE kind = 'exports') e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id
    WHERE e.src <> e.dst AND s.corpus = t.corpus AND ((e.kind = 'ref/call' AND t.kind IN ('function', 'method', 'fn', 'class', 'interface', 'struct', 'trait', 'enum', 'type', 'typedef', 'union', 'object', 'protocol', 'mixin', 'extension', 'namespace', 'init')) OR (e.kind = 'ref/field' AND t.kind = 'field') OR (e.kind = 'is-implementation' AND t.kind IN ('interface', 'trait', 'class', 'struct', 'protocol')))""",
    ("nodes", "edges", "edge_sites"),
)
def soundness_gate(spark, d):
    """Candidates are the graph's edges, calls of oneself, and the exports backwards as implementations."""
    from skein.operators.joins import sound

    g = Graph(spark, d)
    e = g.edges.select("src", "dst", "kind")
    back = e.where("kind = 'exports'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("is-implementation").alias("kind"))
    return sound(e.unionByName(g.sites.select("src", F.col("src").alias("dst"), "kind")).unionByName(back), g.nodes)


@query(
    rf"""SELECT id FROM nodes WHERE NOT (regexp_matches(path, '{filters.VENDORED}|{filters.STRUCTURAL}') OR regexp_matches(signature, 'local [0-9]+$') OR kind IN ('doc-chunk', 'crate') OR starts_with(signature, 'scip:')
    OR (starts_with(signature, 'pkg:') AND regexp_matches(path, '(^|/)\.(github|gitlab|circleci|buildkite)/')) OR coalesce(test_role, 0) > 0)""",
    ("nodes",),
)
def anchor_noise(spark, d):
    n = Graph(spark, d).nodes
    return n.where(~filters.is_anchor_noise(F.col("path"), F.col("signature"), F.col("kind"), F.col("test_role"))).select("id")


@query("SELECT round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.95), 6) AS p95 FROM (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def cosine_percentiles(spark, d):
    e = Graph(spark, d).table("embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select(I.cosine(F.col("embedding"), F.col("other")).alias("c")).agg(F.round(F.percentile("c", 0.5), 6).alias("p50"), F.round(F.percentile("c", 0.95), 6).alias("p95"))


# Sets and integrity


@query("SELECT DISTINCT src, dst, kind FROM (SELECT src, dst, kind FROM edges UNION ALL SELECT src, dst, kind FROM edge_sites)", ("edges", "edge_sites"))
def edge_dedupe(spark, d):
    g = Graph(spark, d)
    return g.edges.select("src", "dst", "kind").unionByName(g.sites.select("src", "dst", "kind")).dropDuplicates(["src", "dst", "kind"])


@query("SELECT DISTINCT src, dst FROM edge_sites EXCEPT SELECT src, dst FROM edges WHERE provenance = 'scip'", ("edges", "edge_sites"))
def attempted_minus_unified(spark, d):
    g = Graph(spark, d)
    return g.sites.select("src", "dst").distinct().join(g.edges.where("provenance = 'scip'").select("src", "dst"), ["src", "dst"], "left_anti")


@query(
    """WITH g AS (SELECT DISTINCT path FROM nodes WHERE path NOT IN (SELECT path FROM nodes WHERE id % 3 <> 0)) SELECT path FROM g WHERE (SELECT count(*) FROM g) <= greatest(100, 0.5 * (SELECT count(DISTINCT path) FROM nodes))""",
    ("nodes",),
)
def ghost_paths_breaker(spark, d):
    n = Graph(spark, d).nodes
    return merge.guarded_delete(n, n.where("id % 3 <> 0"))


@query(
    """WITH u AS (SELECT 'a' AS repo, src, dst, kind FROM edges WHERE src % 2 = 0 UNION ALL SELECT 'b', src, dst, kind FROM edges WHERE dst % 2 = 0) SELECT repo, kind, count(*) AS n, count(DISTINCT src) AS sources FROM u GROUP BY ALL""",
    ("edges",),
)
def multi_repo_overview(spark, d):
    e = Graph(spark, d).edges.select("src", "dst", "kind")
    u = e.where("src % 2 = 0").withColumn("repo", F.lit("a")).unionByName(e.where("dst % 2 = 0").withColumn("repo", F.lit("b")))
    return u.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


@query("SELECT e.src, e.dst FROM edges e WHERE kind = 'ref/call' AND EXISTS (SELECT 1 FROM edge_sites s WHERE s.src = e.src AND s.dst = e.dst AND s.kind = e.kind AND s.line > 3)", ("edges", "edge_sites"))
def retained_targets(spark, d):
    g = Graph(spark, d)
    return g.edges.where("kind = 'ref/call'").join(g.sites.where("line > 3").select("src", "dst", "kind"), ["src", "dst", "kind"], "left_semi").select("src", "dst")


@query(
    """WITH o AS (SELECT count(*) AS orphans FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)), s AS (SELECT count(*) AS self_refs FROM edges WHERE src = dst AND kind = 'ref/call'), n AS (SELECT count(*) AS n, count(DISTINCT id) AS ids FROM nodes)
    SELECT orphans, self_refs, n - ids AS repeated_ids, orphans = 0 AND self_refs = 0 AND n = ids AS healthy, CASE WHEN orphans = 0 AND self_refs = 0 AND n = ids THEN 'none' ELSE 'reindex' END AS recommendation FROM o, s, n""",
    NE,
)
def graph_health(spark, d):
    from skein.operators.integrity import health

    g = Graph(spark, d)
    return health(g.nodes, g.edges)


@query("SELECT n_nationkey AS repo_id, CASE WHEN n_nationkey % 4 = 0 THEN 'NotIndexed' WHEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 2 = 0) = 0 THEN 'IndexMissing' ELSE 'Indexed' END AS status FROM nation")
def registry_status(spark, d):
    from skein.operators.integrity import registry_status as status

    g = Graph(spark, d)
    repos = g.table("nation").select(F.col("n_nationkey").alias("repo_id"), (F.col("n_nationkey") % 4 != 0).alias("has_index"))
    return status(repos, g.table("customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("repo_id")))
