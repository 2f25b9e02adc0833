"""Ranking: BM25, fusion, caps, budgets, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.sources.storage import counted, written

#: Saturation and length of BM25, and the constant of rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Of the exact knapsack, the largest table, the scale of values and the largest budget.
DP_CELLS, DP_SCALE, MAX_BUDGET = 1_000_000, 1e6, 32_000


def bm25(docs: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of documents (id, field, tokens), which hold a token as often as it occurs; fields add up by weight. Documents without a hit score 0 and stay.

    A term counts once however often the query holds it. Without terms all score 0, in the order given. Corpus statistics are one
    aggregate; a document's score needs no shuffle beyond its own fields.
    """
    weights = weights or {"": 1.0}
    d = docs.withColumn("dl", F.size("tokens"))
    hits = {t: f"h{i}" for i, t in enumerate(dict.fromkeys(terms))}
    # Tokens are made once: the table has a document's length and counts alone.
    d = written(d.withColumns({h: _times("tokens", t) for t, h in hits.items()}).select("id", "field", "dl", *hits.values()))
    stats = d.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(h) > 0).cast("long")).alias(f"df_{h}") for h in hits.values()])
    j = d.join(F.broadcast(stats), "field")  # a row per field
    score = F.lit(0.0)
    for h in hits.values():
        score = score + _weight(F.col(h), F.col("dl"), F.col("n"), F.col(f"df_{h}"), F.col("avgdl"))
    w = F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in weights.items()], F.lit(1.0))
    return j.select("id", (score * w).alias("score")).groupBy("id").agg(F.sum("score").alias("score"))


def _times(tokens: str, term: str) -> F.Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def _weight(count: F.Column, length: F.Column, n: F.Column, df: F.Column, average: F.Column) -> F.Column:
    """What a term adds to a document's score."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))


def bm25_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(q, id, score) of the documents (id, tokens) with a hit, for many queries' terms (q, form, none of them twice) at once.

    Documents' tokens meet the terms of all queries by an equality; a hot term's documents are counted before they move.
    """
    d = docs.select("id", F.size("tokens").alias("dl"), "tokens")
    facts = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("average"))
    # An outer explode: before an inner one, Catalyst takes the tokens apart once more to see whether there are any. The join drops its nulls.
    own = d.select("id", "dl", F.explode_outer("tokens").alias("form")).join(counted(terms.select("form").distinct()), "form", "left_semi")
    counts = written(own.groupBy("form", "id", "dl").agg(F.count(F.lit(1)).alias("tf")))
    df = counts.groupBy("form").agg(F.count(F.lit(1)).alias("df"))
    each = counts.join(df, "form").crossJoin(F.broadcast(facts)).select("form", "id", _weight(F.col("tf"), F.col("dl"), F.col("n"), F.col("df"), F.col("average")).alias("s"))
    return terms.join(each, "form").groupBy("q", "id").agg(F.sum("s").alias("score"))


def reciprocal_rank_fusion(legs: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(id, rrf) of ranked legs (id, rank)."""
    weights = weights or [1.0] * len(legs)
    parts = [leg.select("id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for leg, w in zip(legs, weights)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("s").alias("rrf"))


def top_ranked(rows: DataFrame, score: str, n: int, key: str = "id") -> DataFrame:
    """The n best rows with their ranks: a top-n in each task, then a rank over n rows."""
    best = rows.orderBy(F.desc(score), key).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), key)))


def per_path_cap(rows: DataFrame, cap: int = 2, score: str = "score") -> DataFrame:
    w = W.partitionBy("path").orderBy(F.desc(score), "id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def damped(score: F.Column, in_degree: F.Column) -> F.Column:
    return score / (1 + F.log(F.greatest(F.lit(1), in_degree).cast("double")))


def budget_prefix(rows: DataFrame, budget: int, order: list, cost: str = "cost") -> DataFrame:
    """The first rows in order whose running cost fits the budget; the first always stays. Each row costs one at least, so that no more than the budget can fit."""
    best = rows.orderBy(*order).limit(budget + 1)
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = best.withColumn("running", F.sum(cost).over(w)).withColumn("position", F.row_number().over(W.orderBy(*order)))
    return out.where((F.col("running") <= budget) | (F.col("position") == 1))


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """One row of n, hit1, hit3, hit10, mrr from (query_id, rank, hit)."""
    f = ranked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    hit = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}")
    return f.agg(F.count(F.lit(1)).alias("n"), hit(1), hit(3), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def abstain_accuracy(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row of n, abstained, accuracy from queries (query_id, answerable) and their results (query_id, ...): right are no results where there is no answer and some where there is one."""
    j = queries.join(ranked.select("query_id").distinct().withColumn("_some", F.lit(True)), "query_id", "left")
    some = F.col("_some").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum((~some).cast("long")).alias("abstained"), F.round(F.avg((some == F.col("answerable")).cast("double")), 6).alias("accuracy"))


def choose(costs: list[int], scores: list[float], budget: int) -> list[int]:
    """Positions chosen by a 0-1 knapsack: exact while the table is small, else by ratio, items that don't fit skipped."""
    n = len(costs)
    if not n or budget <= 0 or budget > MAX_BUDGET:
        return []
    if n * budget > DP_CELLS:
        chosen, left = [], budget
        for i in sorted(range(n), key=lambda i: -scores[i] / costs[i]):
            if costs[i] <= left:
                chosen.append(i)
                left -= costs[i]
        return chosen
    import numpy as np

    values = [max(1, round(s * DP_SCALE)) for s in scores]
    best = np.zeros(budget + 1, np.int64)
    taken = np.zeros((n, budget + 1), bool)
    for i in range(n):
        c = costs[i]
        if c <= budget:
            with_it = best[: budget + 1 - c] + values[i]
            taken[i, c:] = with_it > best[c:]
            best[c:] = np.maximum(best[c:], with_it)
    chosen, left = [], budget
    for i in range(n - 1, -1, -1):
        if taken[i, left]:
            chosen.append(i)
            left -= costs[i]
    return sorted(chosen, key=lambda i: -values[i])


def knapsack(candidates: DataFrame, budget: int, group: str = "query_id", limit: int = 200) -> DataFrame:
    """(group, id, position): for each group the choice among its best candidates (id, cost, score); a group is at most `limit` rows in its task."""
    import pandas as pd

    w = W.partitionBy(group).orderBy(F.desc("score"), "id")
    best = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)

    def run(pdf):
        pdf = pdf.sort_values("_n")
        at = choose(pdf["cost"].tolist(), pdf["score"].tolist(), budget)
        return pd.DataFrame({group: pdf[group].iloc[:1].tolist() * len(at), "id": pdf["id"].iloc[at].tolist(), "position": range(len(at))}).astype({"position": "int32"})

    kind = dict(candidates.dtypes)
    return best.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, id {kind['id']}, position int")
