"""Tokens, ranking, fusion, search and the composed retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.catalog import Graph, query
from skein.functions import identifiers as I
from skein.operators import ingest, ranking, seeding
from skein.plans.relational import NE, SEG
from skein.sources.storage import written

def _terms_sql(c):
    """Segments of three bytes or more, as often as they occur, and the whole in lower case where it has no white space and isn't one of them."""
    own = f"list_filter({SEG(c=c)}, lambda x: strlen(x) >= 3)"
    return f"list_concat({own}, CASE WHEN strlen({c}) >= 3 AND NOT regexp_matches({c}, '\\s') AND NOT list_contains({own}, lower({c})) THEN [lower({c})] ELSE [] END)"


def _spark_terms(n, c="signature", field=""):
    return n.select("id", F.lit(field).alias("field"), I.index_terms(F.col(c)).alias("tokens"))


def _bm25_sql(terms, source, weights=(("", 1.0),)):
    parts = []
    for field, w in weights:
        own = f"(SELECT * FROM ({source}) WHERE field = '{field}')"
        terms_sql = " + ".join(
            f"ln(((SELECT count(*) FROM {own}) - (SELECT count(*) FROM {own} WHERE list_contains(tokens, '{t}')) + 0.5) / ((SELECT count(*) FROM {own} WHERE list_contains(tokens, '{t}')) + 0.5) + 1) * 2.2 * h{i} / (h{i} + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(len(tokens)) FROM {own})))"
            for i, t in enumerate(terms)
        )
        flags = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS h{i}" for i, t in enumerate(terms))
        parts.append(f"SELECT id, CAST({w} * ({terms_sql}) AS DOUBLE) AS s FROM (SELECT id, len(tokens) AS dl, {flags} FROM {own})")
    return f"SELECT id, round(sum(s), 6) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY id"


_ALL = f"SELECT id, '' AS field, {_terms_sql('signature')} AS tokens FROM nodes"


@query(_bm25_sql(["red", "widget"], _ALL), ("nodes",))
def bm25(spark, d):
    return ranking.bm25(_spark_terms(Graph(spark, d).nodes), ["red", "widget"]).select("id", F.round("score", 6).alias("score"))


_FIELDS = f"SELECT id, 'signature' AS field, {_terms_sql('signature')} AS tokens FROM nodes UNION ALL SELECT id, 'path', {_terms_sql('path')} FROM nodes"


@query(_bm25_sql(["brand", "ring", "economy"], _FIELDS, (("signature", 3.0), ("path", 1.0))), ("nodes",))
def bm25_fields(spark, d):
    n = Graph(spark, d).nodes
    docs = _spark_terms(n, "signature", "signature").union(_spark_terms(n, "path", "path"))
    return ranking.bm25(docs, ["brand", "ring", "economy"], {"signature": 3.0, "path": 1.0}).select("id", F.round("score", 6).alias("score"))


@query(
    """SELECT id, signature, rank FROM (SELECT id, signature, CASE WHEN signature = 'order_10' OR regexp_replace(signature, '^[^:]*:', '') = 'order_10' THEN 0 WHEN starts_with(regexp_replace(signature, '^[^:]*:', ''), 'order_10') THEN 1 ELSE 2 END AS rank FROM nodes WHERE contains(signature, 'order_10'))
    ORDER BY rank, id LIMIT 100""",
    ("nodes",),
)
def name_rank(spark, d):
    body = F.regexp_replace("signature", "^[^:]*:", "")
    rank = F.when((F.col("signature") == "order_10") | (body == "order_10"), 0).when(body.startswith("order_10"), 1).otherwise(2)
    return Graph(spark, d).nodes.where(F.col("signature").contains("order_10")).select("id", "signature", rank.alias("rank")).orderBy("rank", "id").limit(100)


_LEGS = """WITH a AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM (SELECT dst AS id, count(*) AS n FROM edges WHERE kind = 'ref/call' GROUP BY dst) ORDER BY n DESC, id LIMIT 50),
b AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM (SELECT dst AS id, count(*) AS n FROM edges WHERE kind = 'ffi/call' GROUP BY dst) ORDER BY n DESC, id LIMIT 50)"""


def _legs(spark, d):
    e = Graph(spark, d).edges
    leg = lambda k: ranking.top_ranked(e.where(F.col("kind") == k).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")), "n", 50).select("id", "rank")
    return leg("ref/call"), leg("ffi/call")


@query(_LEGS + " SELECT id, round(sum(s), 9) AS rrf FROM (SELECT id, CAST(1.0 AS DOUBLE) / (60 + rank) AS s FROM a UNION ALL SELECT id, CAST(1.0 AS DOUBLE) / (60 + rank) FROM b) GROUP BY id", ("edges",))
def rrf(spark, d):
    return ranking.reciprocal_rank_fusion(list(_legs(spark, d))).select("id", F.round("rrf", 9).alias("rrf"))


@query(f"SELECT token, round(greatest(0.05, least(1.0, ln((t.n + 1) / CAST(df + 1 AS DOUBLE)) / ln(t.n + 1))), 6) AS idf FROM (SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest({SEG(c='signature')}) AS token FROM nodes) GROUP BY token), (SELECT greatest(1000, count(*)) AS n FROM nodes) t", ("nodes",))
def idf(spark, d):
    n = Graph(spark, d).nodes
    df = n.select("id", F.explode(I.segments(F.col("signature"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = n.agg(F.greatest(F.lit(1000), F.count(F.lit(1))).alias("n"))
    return df.crossJoin(F.broadcast(total)).select("token", F.round(I.idf_weight(F.col("df"), F.col("n")), 6).alias("idf"))


@query(
    """SELECT id, position FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN kind IN ('function', 'method') THEN 0 WHEN kind = 'class' THEN 1 ELSE 2 END, coalesce(end_line - line, 0) DESC, id) AS position FROM
    (SELECT * FROM nodes WHERE line IS NOT NULL ORDER BY id LIMIT 6)) WHERE position <= 3""",
    ("nodes",),
)
def anchor_order(spark, d):
    window = Graph(spark, d).nodes.where("line IS NOT NULL").orderBy("id").limit(6)
    logic = F.when(F.col("kind").isin("function", "method"), 0).when(F.col("kind") == "class", 1).otherwise(2)
    w = W.orderBy(logic, F.desc(F.coalesce(F.col("end_line") - F.col("line"), F.lit(0))), "id")
    return window.select("id", F.row_number().over(w).alias("position")).where("position <= 3")


@query(
    """WITH r AS (SELECT n.id, n.path, n.id % 1000 AS score, CAST(n.id % 60 AS INT) AS position, 't' || CAST(n.id % 60 AS VARCHAR) AS token FROM nodes n), m AS (SELECT *, row_number() OVER (PARTITION BY position, token ORDER BY score DESC, id) AS t FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY position, token, t) AS p FROM m WHERE t <= 4) SELECT id, path, score, position, token FROM p WHERE t = 1 OR p <= 2""",
    ("nodes",),
)
def anchor_slots(spark, d):
    k = (F.col("id") % 60).cast("int")
    n = Graph(spark, d).nodes.select("id", "path", (F.col("id") % 1000).alias("score"), k.alias("position"), F.concat(F.lit("t"), k.cast("string")).alias("token"))
    return seeding.anchor_slots(n)


@query("SELECT id, path, score FROM (SELECT id, path, CAST(id % 1000 AS DOUBLE) AS score, row_number() OVER (PARTITION BY path ORDER BY CAST(id % 1000 AS DOUBLE) DESC, id) AS n FROM nodes) WHERE n <= 2", ("nodes",))
def per_path_cap(spark, d):
    return ranking.per_path_cap(Graph(spark, d).nodes.select("id", "path", (F.col("id") % 1000).cast("double").alias("score")))


@query("SELECT n.id, round((n.id % 100) / (1 + ln(CAST(greatest(1, coalesce(k, 0)) AS DOUBLE))), 6) AS score FROM nodes n LEFT JOIN (SELECT dst, count(*) AS k FROM edges GROUP BY dst) ON dst = n.id", NE)
def degree_damping(spark, d):
    g = Graph(spark, d)
    deg = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return g.nodes.select("id").join(deg, "id", "left").select("id", F.round(ranking.damped(F.col("id") % 100, F.coalesce("k", F.lit(0))), 6).alias("score"))


@query("SELECT id, kind, band, row_number() OVER (PARTITION BY band ORDER BY k, score DESC, id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY band, kind ORDER BY score DESC, id) AS k FROM (SELECT id, kind, id % 100 AS score, (id % 100) // 10 AS band FROM nodes))", ("nodes",))
def kind_diversity(spark, d):
    return _diverse(Graph(spark, d).nodes)


def _diverse(nodes):
    n = nodes.select("id", "kind", (F.col("id") % 100).alias("score"), F.expr("(id % 100) div 10").alias("band"))
    k = n.withColumn("k", F.row_number().over(W.partitionBy("band", "kind").orderBy(F.desc("score"), "id")))
    return k.select("id", "kind", "band", F.row_number().over(W.partitionBy("band").orderBy("k", F.desc("score"), "id")).alias("position"))


@query(
    """WITH c AS (SELECT id, greatest(1, (strlen(signature) + strlen(kind) + strlen(path)) // 4) AS cost, k FROM nodes JOIN (SELECT dst, count(*) AS k FROM edges GROUP BY dst) ON dst = id),
    r AS (SELECT id, cost, CAST(sum(cost) OVER (ORDER BY k DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, row_number() OVER (ORDER BY k DESC, id) AS position FROM c) SELECT * FROM r WHERE running <= 2000 OR position = 1""",
    NE,
)
def budget_prefix(spark, d):
    g = Graph(spark, d)
    c = g.nodes.withColumn("cost", I.token_cost(F.col("signature"), F.col("kind"), F.col("path"))).select("id", "cost").join(g.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id")
    return ranking.budget_prefix(c, 2000, [F.desc("k"), F.col("id")]).select("id", "cost", "running", "position")


@query()
def knapsack(spark, d):
    n = Graph(spark, d).nodes
    c = n.select(F.col("package").alias("query_id"), "id", I.token_cost(F.col("signature"), F.col("kind"), F.col("path")).alias("cost"), ((F.col("id") % 997) / 997.0).cast("double").alias("score"))
    return ranking.knapsack(c, 500)


_TRI = "list_distinct([substr({c}, i, 3) FOR i IN range(1, length({c}) - 1)])".format


@query(
    f"""WITH q AS (SELECT unnest(['buildingg', 'automobilee', 'machineryy', 'housholdd', 'furnitur', 'nation']) AS q), v AS (SELECT DISTINCT unnest({SEG(c='signature || path')}) AS token FROM nodes),
    j AS (SELECT q, token, len(list_intersect({_TRI(c='q')}, {_TRI(c='token')})) / CAST(len(list_distinct(list_concat({_TRI(c='q')}, {_TRI(c='token')}))) AS DOUBLE) AS sim FROM q, v WHERE length(token) >= 4),
    r AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY sim DESC, token) AS k FROM j WHERE sim >= 0.7), a AS (SELECT q, token, sim, max(CASE WHEN k = 2 THEN sim END) OVER (PARTITION BY q) AS next, k FROM r)
    SELECT q, CASE WHEN next IS NULL OR sim - next >= 0.05 THEN token END AS token, round(sim, 6) AS sim FROM a WHERE k = 1""",
    ("nodes",),
)
def typo_correct(spark, d):
    return _corrected(spark, Graph(spark, d).nodes)


_TYPOS = ("buildingg", "automobilee", "machineryy", "housholdd", "furnitur", "nation")


def _corrected(spark, n):
    from skein.plans.retrieval import corrections

    vocab = n.select(F.explode(I.segments(F.concat("signature", "path"))).alias("token")).distinct()
    words = spark.createDataFrame([(x,) for x in _TYPOS], "q string")
    return corrections(words, vocab).select("q", "token", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH q AS (SELECT unnest(['widget', 'brand', 'building']) AS q), v AS (SELECT DISTINCT unnest({SEG(c='signature || path')}) AS token FROM nodes),
    j AS (SELECT q, token, len(list_intersect({_TRI(c='q')}, {_TRI(c='token')})) / CAST(len(list_distinct(list_concat({_TRI(c='q')}, {_TRI(c='token')}))) AS DOUBLE) AS sim FROM q, v WHERE length(token) >= 4)
    SELECT q, token FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, token) AS k FROM j WHERE sim >= 0.4) WHERE k <= 16""",
    ("nodes",),
)
def vocab_expand(spark, d):
    return _expanded(spark, Graph(spark, d).nodes)


def _expanded(spark, n):
    from skein.plans.retrieval import similar_tokens

    vocab = n.select(F.explode(I.segments(F.concat("signature", "path"))).alias("token")).distinct()
    words = spark.createDataFrame([(x,) for x in ("widget", "brand", "building")], "q string")
    s = similar_tokens(words, vocab, 0.4).withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "token")))
    return s.where("k <= 16").select("q", "token")


@query(
    "WITH s(term, alias) AS (VALUES "
    + ", ".join(f"('{t}', '{a}')" for t, own in I.SYNONYMS.items() for a in own)
    + "), q AS (SELECT DISTINCT event_type AS q FROM events UNION SELECT 'delete' UNION SELECT 'store') SELECT q, q AS term FROM q UNION SELECT q, alias FROM q JOIN s ON s.term = q"
)
def synonym_expand(spark, d):
    from skein.plans.retrieval import with_synonyms

    q = Graph(spark, d).table("events").select(F.col("event_type").alias("q")).union(spark.createDataFrame([("delete",), ("store",)], "q string")).distinct()
    return with_synonyms(q, I.SYNONYMS)


@query(
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'calls |callers|called by') THEN 'callers' WHEN regexp_matches(lower(text), 'import|depends|dependency|dependencies') THEN 'deps'
    WHEN regexp_matches(lower(text), '^\s*how(\s|$)') OR regexp_matches(lower(text), 'explain|describe') THEN 'explain' WHEN regexp_matches(lower(text), 'between|relation') THEN 'relation' ELSE 'lookup' END AS intent FROM conversations"""
)
def intent(spark, d):
    return Graph(spark, d).table("conversations").select("conv_id", "turn", I.intent(F.col("text")).alias("intent"))


@query(
    r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE lang = 'en'), c AS (SELECT w, lower(w) AS l FROM t), s AS (SELECT w, CASE WHEN regexp_matches(l, '(ies|ied)$') THEN regexp_replace(l, '(ies|ied)$', 'y') WHEN ends_with(l, 'ing') THEN regexp_replace(l, 'ing$', '')
    WHEN ends_with(l, 'ed') THEN regexp_replace(l, 'ed$', '') WHEN regexp_matches(l, '(s|x|z|ch|sh)es$') THEN regexp_replace(l, 'es$', '') WHEN ends_with(l, 's') AND NOT ends_with(l, 'ss') THEN regexp_replace(l, 's$', '') END AS stem FROM c WHERE length(w) >= 5)
    SELECT w, stem FROM s WHERE length(stem) >= 4"""
)
def inflectional_stem(spark, d):
    t = Graph(spark, d).table("documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w")).distinct()
    return t.select("w", I.stem(F.col("w")).alias("stem")).where("stem IS NOT NULL")


@query(
    r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE lang = 'en'), c AS (SELECT w, lower(w) AS l FROM t WHERE length(w) >= 5),
    s AS (SELECT w, CASE WHEN ends_with(l, 'ing') THEN l[:-4] WHEN ends_with(l, 'ed') AND NOT ends_with(l, 'ied') THEN l[:-3] WHEN regexp_matches(l, '(s|x|z|ch|sh)es$') THEN l[:-3] END AS stem FROM c)
    SELECT w, stem || 'e' AS stem FROM s WHERE length(stem) >= 4"""
)
def stem_restoring_e(spark, d):
    t = Graph(spark, d).table("documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w")).distinct()
    return t.select("w", I.stem_with_e(F.col("w")).alias("stem")).where("stem IS NOT NULL")


@query(
    """WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, e.vec_id, list_cosine_similarity(v, CAST(e.embedding AS DOUBLE[])) AS sim FROM q, embeddings e WHERE e.vec_id <> q)
    SELECT q, vec_id, round(sim, 6) AS sim, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS k FROM s) WHERE k <= 10"""
)
def knn_cosine(spark, d):
    from skein.plans.retrieval import nearest_vectors

    e = Graph(spark, d).table("embeddings")
    return nearest_vectors(e, e.where("vec_id % 100 = 0"), 10)


@query(
    """WITH s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings WHERE vec_id <> 0)
    SELECT vec_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS k, max(sim) OVER () AS top FROM s) WHERE k <= 5 OR (sim >= 0.55 AND sim >= top - 0.13)"""
)
def semantic_validate(spark, d):
    from skein.plans.retrieval import validated

    e = Graph(spark, d).table("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("v"))
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", I.cosine(F.col("embedding"), F.col("v")).alias("sim"))
    return validated(s, "vec_id").select("vec_id", F.round("sim", 6).alias("sim"))


@query("SELECT vec_id, round(greatest(-1.0, least(1.0, 0.1 + (x - 0.55) / 0.22 * (0.8 - 0.1))), 6) AS mapped FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def calibration_map(spark, d):
    from skein.plans.retrieval import calibrated

    return Graph(spark, d).table("embeddings").select("vec_id", F.round(calibrated(F.element_at("embedding", 1).cast("double"), 0.1, 0.8), 6).alias("mapped"))


@query(
    """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 7 = 0 AND cov >= 0.6 THEN 'exact' WHEN o_orderkey % 5 = 0 AND cov >= 0.6 THEN 'strong' WHEN o_totalprice > 400000 AND cov >= 0.25 THEN 'strong' WHEN o_totalprice < 20000 THEN 'none' WHEN cov >= 0.25 OR o_orderkey % 5 = 0 THEN 'weak' ELSE 'none' END AS confidence
    FROM (SELECT *, (o_custkey % 100) / CAST(100 AS DOUBLE) AS cov FROM orders)"""
)
def confidence(spark, d):
    from skein.plans.retrieval import confidence as lattice

    o = Graph(spark, d).table("orders").withColumn("coverage", (F.col("o_custkey") % 100) / F.lit(100.0))
    c = lattice(rare=F.col("o_orderkey") % 7 == 0, specific=F.col("o_orderkey") % 5 == 0, confirmed=F.col("o_totalprice") > 400000, veto=F.col("o_totalprice") < 20000, seeds=F.lit(True), coverage=F.col("coverage"))
    return o.select(F.col("o_orderkey").alias("query_id"), c.alias("confidence"))


@query(
    """WITH q(q) AS (VALUES ('fn:order_5'), ('order_7'), ('nation_3'), ('missing')), h AS (SELECT q, n.id, CASE WHEN n.signature = q THEN 0 WHEN regexp_replace(n.signature, '^[^:]*:', '') = q THEN 1 WHEN regexp_replace(n.path, '^.*/', '') = q THEN 2 WHEN contains(n.signature, q) THEN 3 END AS rung FROM q JOIN nodes n ON contains(n.signature, q) OR contains(n.path, q)),
    b AS (SELECT q, min(rung) AS rung FROM h GROUP BY q) SELECT q, CAST(h.rung AS INT) AS rung, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM h JOIN b ON h.q = b.q AND h.rung = b.rung GROUP BY ALL""".replace("SELECT q, CAST(h.rung", "SELECT h.q, CAST(h.rung"),
    ("nodes",),
)
def symbol_ladder(spark, d):
    from skein.plans.retrieval import resolve_symbols

    q = spark.createDataFrame([("fn:order_5",), ("order_7",), ("nation_3",), ("missing",)], "q string")
    return resolve_symbols(q, Graph(spark, d).nodes)


@query()
def fuzzy_fused(spark, d):
    from skein.plans.retrieval import fuzzy_search

    return fuzzy_search(Graph(spark, d).nodes, "red widgt", 50)


@query()
def context(spark, d):
    from skein.plans.retrieval import context as assemble

    g = Graph(spark, d)
    return assemble(g.nodes, g.edges, "how does red widget ring 1615 depend on suppliers", 2000)


# Documents and dumps


@query(
    r"""WITH m AS (SELECT doc_id, '# ' || source || chr(10) || replace(text, chr(10), chr(10) || '## part ') AS text FROM documents), p AS (SELECT doc_id, string_split_regex(regexp_replace(chr(10) || text, '\n(#{1,6} )', chr(1) || '\1', 'g'), chr(1)) AS s FROM m)
    SELECT doc_id, CAST(i - 1 AS INT) AS position, regexp_extract(s[i], '^#{1,6} ([^\n]*)', 1) AS heading, CAST(length(s[i]) AS INT) AS n_chars FROM p, unnest(range(1, len(s) + 1)) AS u(i)"""
)
def markdown_sections(spark, d):
    docs = Graph(spark, d).table("documents")
    text = F.concat(F.lit("# "), "source", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## part ")))
    return ingest.markdown_sections(docs.select("doc_id", text.alias("text")))


@query(r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), m AS (SELECT doc_id, i AS line, ls[i] AS text, ls[i + 1] AS next_1 FROM l, unnest(range(1, len(ls) + 1)) AS u(i)) SELECT doc_id, CAST(line AS INT) AS line, text, next_1 FROM m WHERE regexp_matches(text, '^The .*(idiot|trash)')")
def pattern_search(spark, d):
    from skein.plans.retrieval import find_pattern

    return find_pattern(Graph(spark, d).table("documents"), "^The .*(idiot|trash)", 1)


@query("SELECT doc_id, string_split(text, chr(10))[2:3] AS snippet FROM documents".replace("string_split(text, chr(10))[2:3]", "array_to_string(string_split(text, chr(10))[2:3], chr(10))"))
def snippets_by_span(spark, d):
    return Graph(spark, d).table("documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 2), "\n").alias("snippet"))


@query(
    """WITH a AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h"""
)
def file_hash_delta(spark, d):
    docs = Graph(spark, d).table("documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    old = docs.where("doc_id % 10 <> 1").select(path, F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 10 <> 3").select(path, F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return ingest.file_delta(old, new)


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rid FROM lineitem)
    SELECT 'order_' || CAST(l_orderkey AS VARCHAR) || '.ts' AS path, l_linenumber AS line, 'part_' || CAST(l_partkey AS VARCHAR) AS symbol FROM r"""
)
def lsif_occurrences(spark, d):
    return _occurrences(spark, Graph(spark, d).table("lineitem"))


def _occurrences(spark, lineitem):
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.lit(10**12) + F.monotonically_increasing_id()).alias("rid"))
    from skein.sources.storage import written

    li = written(li)
    js = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()])).alias("value")
    lit = F.lit
    lines = (
        li.select("l_orderkey").distinct().select(js(id=F.col("l_orderkey"), type=lit("vertex"), label=lit("document"), path=F.concat(lit("order_"), F.col("l_orderkey").cast("string"), lit(".ts"))))
        .union(li.select(js(id=F.col("rid"), type=lit("vertex"), label=lit("range"), line=F.col("l_linenumber"))))
        .union(li.select("l_partkey").distinct().select(js(id=F.col("l_partkey") + 10**9, type=lit("vertex"), label=lit("resultSet"), symbol=F.concat(lit("part_"), F.col("l_partkey").cast("string")))))
        .union(li.select(js(type=lit("edge"), label=lit("contains"), outV=F.col("l_orderkey"), inV=F.col("rid"))))
        .union(li.select(js(type=lit("edge"), label=lit("item"), outV=F.col("l_partkey") + 10**9, inV=F.col("rid"))))
        .union(spark.createDataFrame([("not json",)], "value string"))
    )
    return ingest.lsif_occurrences(lines)


@query(
    r"""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'scip rust ' || replace(p_brand, '#', '_') || '#' WHEN 1 THEN 'scip rust ' || replace(p_brand, '#', '_') || '#' || replace(p_name, ' ', '_') || '().' ELSE 'scip rust ' || replace(p_brand, '#', '_') || '#' || replace(p_name, ' ', '_') || '.' END AS sym FROM part)
    SELECT p_partkey, regexp_extract(sym, '([A-Za-z0-9_]+)#[A-Za-z0-9_]+(?:\(\))?\.$', 1) AS container, regexp_extract(sym, '([A-Za-z0-9_]+)(#|\(\)\.|\.)$', 1) AS name, CASE WHEN ends_with(sym, '#') THEN 'class' WHEN ends_with(sym, '().') THEN 'method' ELSE 'field' END AS kind FROM s"""
)
def scip_names(spark, d):
    p = Graph(spark, d).table("part")
    brand, name = F.replace("p_brand", F.lit("#"), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit("_"))
    base = F.concat(F.lit("scip rust "), brand, F.lit("#"))
    sym = F.when(F.col("p_partkey") % 3 == 0, base).when(F.col("p_partkey") % 3 == 1, F.concat(base, name, F.lit("()."))).otherwise(F.concat(base, name, F.lit(".")))
    return p.select("p_partkey", *ingest.scip_parts(sym))


@query("SELECT event_id, ts, upper(event_type) AS level, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 500".replace("upper(event_type)", "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARN' END"))
def log_tail(spark, d):
    from skein.plans.retrieval import tail_log

    e = Graph(spark, d).table("events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    lines = e.select("event_id", "ts", F.to_json(F.struct(level.alias("level"), F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("value"))
    return tail_log(lines, "WARN", 500)


@query()
def python_symbols(spark, d):
    p = Graph(spark, d).table("part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    text = F.concat(F.lit("import os\nfrom a.b import c\n\nclass "), F.initcap("p_type"), F.lit(":\n    def "), name, F.lit("(self):\n        return 1\n\ndef run():\n    pass\n"))
    return ingest.extract_python(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text")))


@query("SELECT 'p' || CAST(p_partkey AS VARCHAR) || '/package.json' AS path, 'lib-' || CAST(p_size AS VARCHAR) AS name, '^' || CAST(p_size % 9 AS VARCHAR) || '.0.0' AS version FROM part")
def manifest_dependencies(spark, d):
    p = Graph(spark, d).table("part")
    text = F.concat(F.lit('{"name":"x","dependencies":{"lib-'), F.col("p_size").cast("string"), F.lit('":"^'), (F.col("p_size") % 9).cast("string"), F.lit('.0.0"}}'))
    return ingest.package_dependencies(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/package.json")).alias("path"), text.alias("text")))


def _questions(spark, d):
    """A query table: a question for each nation, part brand and type of event."""
    g = Graph(spark, d)
    ask = lambda df, c, code, words: df.select(F.concat(F.lit(words), F.col(c)).alias("query")).distinct().withColumn("code", F.lit(code))
    q = ask(g.table("nation"), "n_name", 1, "which suppliers and ordrs does ").unionByName(ask(g.table("part"), "p_brand", 2, "widgets of ")).unionByName(ask(g.table("events"), "event_type", 3, "how are users handled by "))
    return q.select(F.xxhash64("code", "query").alias("q"), "query")


def _near(spark, d, questions):
    """Vectors of the questions: each embedding stands for the document of its number, and a question for the embedding that its number falls on."""
    e = Graph(spark, d).table("embeddings")
    n = e.agg(F.max("vec_id").alias("n"))
    own = questions.crossJoin(F.broadcast(n)).select("q", F.expr("pmod(q, n + 1)").alias("vec_id")).join(e, "vec_id").select(F.col("q").alias("vec_id"), "embedding")
    from skein.plans.retrieval import nearest_vectors

    return nearest_vectors(e, own, 20).select("q", (F.lit(30000000000) + F.col("vec_id")).alias("id"), F.col("sim").alias("cosine"))


@query()
def seed_cascade(spark, d):
    from skein.operators.cascade import Cascade

    g, asked = Graph(spark, d), written(_questions(spark, d))
    s = Cascade(asked, g.nodes, _near(spark, d, asked)).seeds(g.edges)
    return s.select("q", "rank", "id", "source", "found", F.round("score", 9).alias("score"), F.round("weight", 6).alias("weight"))


@query()
def explain_lanes(spark, d):
    from skein.operators.cascade import explain

    g, asked = Graph(spark, d), written(_questions(spark, d))
    return explain(asked, g.nodes, g.edges, _near(spark, d, asked))
