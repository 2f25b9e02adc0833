r"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source, its documents in order of doc_id, are cut into blocks; only the last may be shorter. Of each output shard's slots,
sources get multinomial counts, drawn by (seed, shard) in two steps beyond GROUP sources: groups, then sources of a group. The j-th slot of a source of n
blocks, counted over all shards, takes block p(j mod n), where p is a pseudorandom permutation for the source and the round j div n; so a
block is taken once before any is taken twice. Slots that a source draws beyond its quota go to sources that drew too few, by number, so that totals are the
quotas. Slots and blocks then meet by (source, block).

A quota is the target in blocks, rounded; a source's taken words differ from its target by a block or two. Targets: sources in order of their code
points (null last) have the weights in turn and share a multiple of all words by weight; a target stops at `most` times its source's size and what is
above is shared anew by weight, until none is above.

Words are [^\x20\x09-\x0D]+; a null text has none. Documents without words are in no block and are taken 0 times. Rows of one doc_id go by size and each is a
document of its own; null ids come first and stay null. Sources may be any number, a third of all rows may be of one: rows are ranged by (source, doc_id), so that a
source lies in many tasks, and a range's base is the sum of the ranges before. A very long document is many blocks. Draws depend on
seed and data alone, so reruns agree. Other columns are left out, whatever their names. An empty table, or one without words, has no slots.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import common as C

#: Words of a block, slots of a shard, and sources whose counts are drawn at once.
BLOCK, SHARD, GROUP = 32, 65_536, 4096
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def _in_order(df: DataFrame, group: str, order: list, value: str) -> DataFrame:
    """The rows with key (unique), and before (the sum of value over earlier rows of the group), in order within each group. The rows are ranged and written once, so later readings agree."""

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", part long, key long, before long"

    def run(batches):
        from pyspark import TaskContext

        part, seen, now, total = TaskContext.get().partitionId(), 0, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            g, v = pdf[group].to_numpy(), pdf[value].to_numpy()
            new = np.append(g[0] != now, g[1:] != g[:-1])
            ends = np.cumsum(v)
            first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
            opening = (ends - v)[first]  # what the batch holds before the group
            before = ends - v - opening
            before[: int(np.argmax(new)) if new.any() else len(v)] += total
            now, total = g[-1], int(before[-1] + v[-1])
            yield pdf.assign(part=part, key=(part << 33) + seen + np.arange(len(v)), before=before)
            seen += len(pdf)

    laid = C.written(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInPandas(run, schema))
    sums = laid.groupBy(group, "part").agg(F.sum(value).alias("_sum"))
    bases = sums.select(group, "part", (F.sum("_sum").over(W.partitionBy(group).orderBy("part")) - F.col("_sum")).alias("_base"))
    return laid.join(C.checked(bases), [group, "part"]).withColumn("before", F.col("before") + F.col("_base")).drop("_base", "part")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, rank (from 0), size, weight, target of sources (source, size), none of them twice."""
    numbered = _in_order(sizes.select("source", "size", F.lit(0).alias("all"), F.lit(1).alias("one")), "all", [F.col("source").asc_nulls_last()], "one")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    table = C.written(numbered.select("source", F.col("before").alias("rank"), "size", w.alias("weight")))
    whole = table.agg(F.sum("size")).first()[0] or 0
    level, cap = 0.0, most * F.col("size")
    while True:
        # The level rises as sources that are full leave their share to the others; when no more are full, it stays.
        full = cap <= level * F.col("weight")
        held, open_ = table.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (share * whole - (held or 0.0)) / open_ if open_ else level
        if now <= level:
            return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
        level = now


def permuted(i: np.ndarray, n: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of [0, n), chosen by keys, puts i: a Feistel network over the next power of four, repeated until the value is below n."""
    key = np.zeros(len(i), np.uint64)
    for k in keys:
        key = C.mix(key + k.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2).astype(np.uint64)
    bits += (np.uint64(1) << (np.uint64(2) * bits)) < n.astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, at = i.astype(np.uint64), np.arange(len(i))
    while len(at):
        b, m = bits[at], low[at]
        left, right = out[at] >> b, out[at] & m
        for r in range(6):
            left, right = right, left ^ (C.mix(right + key[at] + np.uint64((r + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) & m)
        out[at] = (left << b) | right
        at = at[out[at] >= n[at].astype(np.uint64)]
    return out.astype(np.int64)


def _drawn(sources: DataFrame, slots: int, seed: int, shard: int, group: int) -> DataFrame:
    """shard, rank, count, offset (of the source's first slot in the shard): multinomial counts by the quotas."""
    spark = sources.sparkSession
    own = sources.where("quota > 0").select((F.col("rank") / group).cast("long").alias("group"), "rank", "quota")
    groups = C.written(own.groupBy("group").agg(F.sum("quota").alias("quota"), F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("own")))
    odds = groups.agg(F.sort_array(F.collect_list(F.struct("group", "quota"))).alias("odds")).select(F.col("odds.group").alias("items"), F.col("odds.quota").alias("quotas"))
    size = F.least(F.lit(shard), F.lit(slots) - F.col("id") * shard)
    shards = spark.range(-(-slots // shard)).select(F.col("id").alias("shard"), size.alias("size"), F.lit(0).cast("long").alias("offset"), F.lit(-1).cast("long").alias("group"))

    def draw(batches):
        for pdf in batches:
            out = []
            for n, size, offset, g, items, quotas in zip(pdf["shard"], pdf["size"], pdf["offset"], pdf["group"], pdf["items"], pdf["quotas"]):
                q = np.asarray(quotas, float)
                counts = np.random.default_rng([seed, n, g + 1]).multinomial(size, q / q.sum())
                at = np.flatnonzero(counts)
                out.append(pd.DataFrame({"shard": n, "item": np.asarray(items)[at], "count": counts[at], "offset": offset + (np.cumsum(counts) - counts)[at]}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["shard", "item", "count", "offset"])

    drawn = "shard long, item long, count long, offset long"
    first = shards.crossJoin(F.broadcast(odds)).mapInPandas(draw, drawn)  # the one row holds a number for each GROUP sources
    second = first.select("shard", F.col("item").alias("group"), F.col("count").alias("size"), "offset").join(groups.select("group", F.col("own.rank").alias("items"), F.col("own.quota").alias("quotas")), "group")
    return second.mapInPandas(draw, drawn).withColumnRenamed("item", "rank")


def _slots(sources: DataFrame, slots: int, seed: int, shard: int, group: int) -> DataFrame:
    """shard, slot, rank, block."""
    drawn = C.written(_drawn(sources, slots, seed, shard, group))
    totals = drawn.groupBy("rank").agg(F.sum("count").alias("got"))
    s = C.written(sources.where("quota > 0").join(totals, "rank", "left").select("rank", "quota", "blocks", F.coalesce("got", F.lit(0)).alias("got")))
    based = drawn.withColumn("base", F.sum("count").over(W.partitionBy("rank").orderBy("shard")) - F.col("count")).join(C.checked(s), "rank")
    each = based.select("shard", "rank", "quota", "blocks", F.explode(F.sequence("base", F.col("base") + F.col("count") - 1)).alias("j"), (F.col("offset") - F.col("base")).alias("shift"))
    each = each.select("shard", (F.col("j") + F.col("shift")).alias("place"), "rank", "quota", "blocks", "j")
    over = _in_order(s.where("got > quota").select("rank", (F.col("got") - F.col("quota")).alias("n"), F.lit(0).alias("all")), "all", ["rank"], "n").select("rank", "before")
    under = _in_order(s.where("got < quota").select("rank", "blocks", "got", (F.col("quota") - F.col("got")).alias("n"), F.lit(0).alias("all")), "all", ["rank"], "n")
    free = under.select("rank", "blocks", "got", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select((F.col("before") + F.col("k")).alias("number"), "rank", "blocks", (F.col("got") + F.col("k")).alias("j"))
    spare = each.where("j >= quota").join(C.checked(over), "rank").select("shard", "place", (F.col("before") + F.col("j") - F.col("quota")).alias("number"))
    taken = each.where("j < quota").select("shard", "place", "rank", "blocks", "j").unionByName(spare.join(free.hint("merge"), "number").select("shard", "place", "rank", "blocks", "j"))

    def locate(batches):
        for pdf in batches:
            n, rank, j, own = (pdf[c].to_numpy() for c in ("blocks", "rank", "j", "shard"))
            size = np.minimum(shard, slots - own * shard)
            salt = np.full(len(pdf), seed)
            yield pd.DataFrame({"shard": own, "slot": permuted(pdf["place"].to_numpy(), size, salt, own), "rank": rank, "block": permuted(j % n, n, salt, rank + 1, j // n + 1)})

    return taken.mapInPandas(locate, "shard long, slot long, rank long, block long")


class Mixture:
    """What mix() makes: documents (key, doc_id, source, rank, size, source_size, target) and spans (shard, slot, block, key, rank, first, words)."""

    def __init__(self, documents: DataFrame, spans: DataFrame | None):
        self.documents, self.spans = documents, spans

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: a row for each document."""
        own = self.documents.select("key", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        if self.spans is not None:
            none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("size", "long"), ("source_size", "long"), ("target", "double"))]
            own = own.union(self.spans.select("key", *none, F.col("words").alias("taken")))
        facts = own.groupBy("key").agg(*[F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
        return C.shown(facts.drop("key"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 1, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mixture:
    C.prepare(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    light = C.written(docs.select(C.hidden(id_col), F.col(source_col).cast("string").alias("source"), size.alias("size")))
    sizes = light.groupBy("source").agg(F.sum("size").alias("size"))
    blocks = F.ceil(F.col("size") / block)
    quota = F.when(F.col("size") > 0, F.least(F.floor(most * blocks), F.round(F.col("target") * blocks / F.col("size")))).otherwise(0).cast("long")
    sources = C.written(targets(sizes, weights, share, most).withColumns({"blocks": blocks.cast("long"), "quota": quota}))
    of = C.checked(sources.select(F.col("source").alias("_source"), "rank", F.col("size").alias("source_size"), "target"))
    ranked = light.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = C.written(_in_order(ranked, "rank", ["doc_id", "size"], "size"))
    slots = sources.agg(F.sum("quota")).first()[0] or 0
    if not slots:
        return Mixture(laid, None)
    end = F.col("before") + F.col("size")
    b = F.explode(F.sequence(F.expr(f"before div {block}"), F.expr(f"(before + size - 1) div {block}"))).alias("block")
    pieces = laid.where("size > 0").select("key", "rank", "before", end.alias("end"), b)
    low = F.greatest("before", F.col("block") * block)
    pieces = pieces.select("key", "rank", "block", (low - F.col("before")).alias("first"), (F.least("end", (F.col("block") + 1) * block) - low).alias("words"))
    # Both sides are exploded: they have far more rows than the tables that Spark judges their size by, and are not to be broadcast.
    return Mixture(laid, _slots(sources, slots, seed, shard, group).join(pieces.hint("merge"), ["rank", "block"]))


def mixed_texts(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, slot, doc_id, first, text: the words that each slot takes from documents, joined by spaces; a slot's rows go by doc_id. Ids of docs must be unique."""
    spans = mixture.spans.join(mixture.documents.select("key", "doc_id"), "key")
    words = docs.select(C.hidden(id_col), F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)).alias("_words"))
    text = F.array_join(F.slice("_words", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    return C.shown(spans.join(words, "doc_id").select("shard", "slot", "doc_id", "first", text.alias("text")))
