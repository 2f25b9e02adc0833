"""The composed retrieval: corrections, fused search, confidence, and a context that fits a budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import identifiers as I
from skein.operators import filters, ranking, seeding, traverse
from skein.operators.cascade import Cascade
from skein.schemas import EDGE_WEIGHTS
from skein.sources.storage import counted, written

#: Vectors of a block, and queries that meet it at once.
VECTORS, QUERIES = 8192, 256


def similar_tokens(words: DataFrame, vocabulary: DataFrame, least: float) -> DataFrame:
    """(q, token, sim): words and vocabulary that share a trigram, by Jaccard similarity of their trigrams. An equality on trigrams, no pairs of all."""
    w = words.select("q", I.trigrams(F.col("q")).alias("wt"))
    v = vocabulary.where(F.length("token") >= 4).select("token", I.trigrams(F.col("token")).alias("vt"))
    both = w.withColumn("g", F.explode("wt")).join(v.withColumn("g", F.explode("vt")), "g").groupBy("q", "token").agg(F.count(F.lit(1)).alias("both"), F.first(F.size("wt")).alias("a"), F.first(F.size("vt")).alias("b"))
    return both.select("q", "token", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("sim")).where(F.col("sim") >= least)


def corrections(words: DataFrame, vocabulary: DataFrame, least: float = 0.7, margin: float = 0.05) -> DataFrame:
    """(q, token, sim): each word's nearest token; the token is null where another one is as near but for the margin, as the word is ambiguous then."""
    w = W.partitionBy("q").orderBy(F.desc("sim"), "token")
    s = similar_tokens(words, vocabulary, least).withColumns({"k": F.row_number().over(w), "next": F.lead("sim").over(w)})
    return s.where("k = 1").select("q", F.when(F.col("next").isNull() | (F.col("sim") - F.col("next") >= margin), F.col("token")).alias("token"), "sim")


def with_synonyms(words: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """(q, term): the word and its aliases, which are added and never take its place."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.coalesce(F.element_at(table, F.col("q")), F.array().cast("array<string>"))
    return words.select("q", F.explode(F.array_distinct(F.concat(F.array("q"), more))).alias("term"))


def _top_of_block(k: int):
    """The k most similar vectors of a block to each query. A product of matrices finds candidates; what they are ranked by is the sum that cosine() takes, in its order."""

    def dot(a, b):
        out = np.zeros(len(a))
        for i in range(a.shape[1]):
            out = out + a[:, i] * b[:, i]
        return out

    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})]
        if not len(vectors) or not len(queries):
            return out[0]
        vectors = vectors.sort_values("vec_id", ignore_index=True)
        v = np.array(vectors["embedding"].tolist(), float).reshape(len(vectors), -1)
        # Of equal vectors the least ids win: one more than k, as one may be the query.
        same = pd.Series([x.tobytes() for x in v + 0.0])
        kept = (same.groupby(same).cumcount() <= k).to_numpy()
        v, ids = v[kept], vectors["vec_id"].to_numpy()[kept]
        size = np.sqrt(dot(v, v))
        unit = np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > 0)
        for at in range(0, len(queries), QUERIES):
            own = queries.iloc[at : at + QUERIES]
            w, names = np.array(own["embedding"].tolist(), float).reshape(len(own), -1), own["vec_id"].to_numpy()
            length = np.sqrt(dot(w, w))
            near = np.divide(w, length[:, None], out=np.zeros_like(w), where=length[:, None] > 0) @ unit.T
            near[names[:, None] == ids[None, :]] = -2
            least = np.partition(near, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(own), -1.5)
            i, j = np.nonzero(near >= np.maximum(least - 1e-9, -1.5)[:, None])
            norm = size[j] * length[i]
            sim = np.divide(dot(v[j], w[i]), norm, out=np.zeros(len(i)), where=norm > 0)
            order = np.lexsort((ids[j], -sim, i))
            found = pd.DataFrame({"i": i[order], "q": names[i[order]], "vec_id": ids[j[order]], "sim": sim[order]})
            out.append(found.groupby("i").head(k).drop(columns="i"))
        return pd.concat(out)

    return run


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, at_most: int = 100_000) -> DataFrame:
    """(q, vec_id, sim, rank) of the k most similar vectors of each query, exactly. Queries are a stated set, checked to be small, and sent to where the vectors are.

    Vectors meet queries in blocks, each of which gives k rows a query. Vectors that are null, of another length than most or hold nulls, no numbers or extreme ones meet pair by pair.
    """
    n = queries.count()
    if n > at_most:
        raise ValueError(f"at most {at_most} query vectors a call")
    rows, width = vectors.agg(F.count(F.lit(1)), F.mode(F.size("embedding"))).first()
    x = F.col("embedding")
    fine = F.forall(x, lambda e: F.coalesce((e == 0) | F.abs(e).between(1e-150, 1e150), F.lit(False)))
    plain = F.col("vec_id").isNotNull() & F.coalesce((F.size(x) == (width or 0)) & fine & x.isNotNull(), F.lit(False)) & F.lit((width or 0) > 0)
    v, own = vectors.select("vec_id", "embedding", plain.alias("plain")), queries.select("vec_id", "embedding", plain.alias("plain"))
    blocks = max(1, -(-(rows or 0) // VECTORS))
    dealt = v.where("plain").select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"))
    asked = own.where("plain").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"))
    s = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(_top_of_block(k), "q long, vec_id long, sim double")
    q = own.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"), F.col("plain").alias("_p"))
    odd = lambda a, b: a.crossJoin(F.broadcast(b)).where("vec_id <> q").select(F.col("q").cast("long"), F.col("vec_id").cast("long"), I.cosine(x, F.col("v")).alias("sim"))
    s = s.unionByName(odd(v.where("NOT plain"), q)).unionByName(odd(v.where("plain"), q.where("NOT _p")))
    # Rank limits on a window become a top-k in each task before the shuffle.
    w = W.partitionBy("q").orderBy(F.desc("sim"), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "vec_id", F.round("sim", 6).alias("sim"), "rank")


def validated(scored: DataFrame, key: str, floor: float = 0.55, delta: float = 0.13, keep: int = 5) -> DataFrame:
    """Rows whose similarity is over the floor and near the best; the best few in any case."""
    top = scored.agg(F.max("sim").alias("top"))
    best = scored.orderBy(F.desc("sim"), key).limit(keep).select(key, F.lit(True).alias("kept"))
    j = scored.crossJoin(F.broadcast(top)).join(F.broadcast(best), key, "left")
    return j.where((F.col("sim") >= floor) & (F.col("sim") >= F.col("top") - delta) | F.col("kept")).select(*scored.columns)


def calibrated(x: Column, low: float, high: float) -> Column:
    """A model's similarity on the common scale; an empty range leaves it as it is."""
    if high <= low:
        return x
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), low + (x - 0.55) / 0.22 * (high - low)))


def confidence(rare: Column, specific: Column, confirmed: Column, veto: Column, seeds: Column, coverage: Column) -> Column:
    """The first rule that holds: exact, strong, none by veto, weak, none."""
    return (
        F.when(rare & (coverage >= 0.6), "exact").when(specific & (coverage >= 0.6), "strong").when(confirmed & (coverage >= 0.25), "strong").when(veto, "none").when(seeds & ((coverage >= 0.25) | specific), "weak").otherwise("none")
    )


def resolve_symbols(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, rung, candidates, id): the best rung on which a name is found: signature, bare name, file name, part of a signature; an id if it is the only one."""
    q = counted(queries, 1000)
    j = nodes.select("id", "signature", "path").join(q, F.col("signature").contains(F.col("q")) | F.col("path").contains(F.col("q")))
    rung = F.when(F.col("signature") == F.col("q"), 0).when(F.regexp_replace("signature", "^[^:]*:", "") == F.col("q"), 1).when(F.regexp_replace("path", "^.*/", "") == F.col("q"), 2).when(F.col("signature").contains(F.col("q")), 3)
    by = j.select("q", "id", rung.alias("rung")).where("rung IS NOT NULL").groupBy("q", "rung").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("id"))
    best = by.groupBy("q").agg(F.min(F.struct("rung", "candidates", "id")).alias("b"))
    return best.select("q", "b.rung", "b.candidates", F.when(F.col("b.candidates") == 1, F.col("b.id")).alias("id"))


def find_pattern(docs: DataFrame, pattern: str, after: int, key: str = "doc_id") -> DataFrame:
    """(doc_id, line, text, next_1..): lines that match, and the lines that follow them in the same document."""
    lines = F.split("text", "\n")
    m = docs.select(key, lines.alias("ls")).select(key, F.posexplode("ls").alias("at", "text"), "ls")
    return m.where(F.col("text").rlike(pattern)).select(key, (F.col("at") + 1).alias("line"), "text", *[F.try_element_at("ls", F.col("at") + 1 + i).alias(f"next_{i}") for i in range(1, after + 1)])


def tail_log(lines: DataFrame, least: str, n: int) -> DataFrame:
    """The last n lines (event_id, ts, value as JSON) of a level or above."""
    rank = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4}
    v = lines.select("event_id", "ts", F.from_json("value", "level string, k int").alias("v")).select("event_id", "ts", "v.level", "v.k")
    return v.where(F.col("level").isin([k for k, r in rank.items() if r >= rank[least]])).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def content_tokens(query: str) -> list[str]:
    """A query's words without punctuation around them and without stop words."""
    own = [w.strip("!\"#$%&'()*+,-/:;<=>?@[\\]^`{|}~").lower() for w in query.split()]
    return [w for w in own if len(w) >= 2 and w not in I.QUERY_STOP_WORDS]


def fuzzy_search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(id, signature, score): words, trigrams and exact names fused by rank; filters come before limits."""
    words = content_tokens(query)
    docs = nodes.select("id", F.lit("").alias("field"), I.index_terms(F.col("signature")).alias("tokens"))
    lexical = ranking.top_ranked(ranking.bm25(docs, words).where("score > 0"), "score", limit)
    grams = [w[i : i + 3] for w in words for i in range(len(w) - 2)]
    tri = nodes.select("id", F.lit("").alias("field"), I.trigrams(F.lower("signature")).alias("tokens"))
    near = ranking.top_ranked(ranking.bm25(tri, grams).where("score > 0"), "score", limit)
    rank = F.min(F.when(filters.exact_kind(F.lit(query), F.col("signature")) == "exact", 0))
    exact = nodes.where(filters.exact_kind(F.lit(query), F.col("signature")).isin("exact", "suffix")).groupBy("id").agg(rank.alias("x")).select("id", F.lit(1).alias("rank"))
    fused = ranking.reciprocal_rank_fusion([lexical, near, exact], weights=[1.0, 0.5, 2.0])
    return ranking.top_ranked(fused.join(nodes.select("id", "signature"), "id"), "rrf", limit).select("id", "signature", F.round("rrf", 9).alias("score"))


def seen_sources(edges: DataFrame, nodes: DataFrame, allowed: list[str]) -> DataFrame:
    """Edges from allowed corpora: walked against their direction, they lead to nothing else."""
    return edges.join(nodes.where(F.col("corpus").isin(allowed)).select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)


def context(nodes: DataFrame, edges: DataFrame, query: str, budget: int, allowed: list[str] | None = None, k: int = 200) -> DataFrame:
    """(id, position): what to read about a query within a budget of tokens.

    Seeds by the cascade, the best 20, without those beside a better one and with their callers; ranks by personalised PageRank over visible
    edges, damped by in-degree, chosen by a knapsack. A query without a seed gives no rows: that is an answer.
    """
    spark, edges = nodes.sparkSession, written(edges)
    asked = spark.range(1).select(F.lit(0).cast("long").alias("q"), F.lit(query).alias("query"))
    found = Cascade(asked, nodes, None, allowed)
    nodes = found.nodes
    visible = edges if allowed is None else written(filters.visible_edges(edges, nodes, allowed))
    best = found.seeds(visible).where("rank <= 20").select("id", "score", "weight")
    best = written(best)
    kept = seeding.apart(best.select("id", "score"), visible)
    seeds = seeding.with_callers(best.join(kept.select("id"), "id", "left_semi").select("id", "weight"), visible if allowed is None else seen_sources(visible, nodes, allowed))
    weighted = visible.withColumn("weight", F.coalesce(*[F.when(F.col("kind") == n, F.lit(w)) for n, w in EDGE_WEIGHTS.items()], F.lit(0.3)))
    rank = traverse.personalised_pagerank(weighted, seeds)
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    best = rank.join(degree, "id", "left").select("id", ranking.damped(F.col("score"), F.coalesce("k", F.lit(0))).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    items = best.join(nodes, "id").select(F.lit(0).alias("query_id"), "id", I.token_cost(F.col("signature"), F.col("kind"), F.col("path")).alias("cost"), "score")
    return ranking.knapsack(items, budget, limit=k).select("id", "position")
