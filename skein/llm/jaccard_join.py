"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

Sets fall into size bands. In a band at most H shingles differ between two sets that are similar enough. The universe
of shingles is hashed into m segments, q of them wider. Each set indexes the subset it has in a segment; in
the q wider ones also the subset's one-deletion neighbourhood. If two sets had no indexed key in common, each plain
segment would differ by one shingle at least and each wide one by two, H + 1 + 2k in all; k is how many of its plain
segments a set may leave out. It leaves out the smallest, whose subsets sets share by chance. allocate() weighs m, q and k by
the keys they index and the chance meetings they leave.

Sets with a key in common are candidates. In a block, and then over all blocks, the members of a key link to its
smallest member only. Candidates pass an exact bound (sizes, and counts of shingles in cells modulo 4, whose circular
distances can't add up to more than the sets' difference) and are then verified on the whole sets. Where a key of three members
or more has some in different components, those are compared as well by the same bound, so that no link between
components is missed; a key with very many members is compared in tiles, each a task's matter. Only pairs that pass the
bound become rows, and only at the smallest key that both are known to have.

Texts without words have an empty set and no links; null text is such a text. Equal sets (of one shingle or more) are one class. Rows with the
same doc_id are one document if their texts are equal, else they are linked by their id. A null doc_id is left as it is and links nothing
but takes no part in ids of components. A very long text is a block of its own and its set is held whole by one task. Columns other than
the id and the text are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common as C
from skein.llm.components import components

SHINGLE = 5
#: The threshold, in hundredths, and the ratio of sizes from one band to the next.
PERCENT, BAND = 80, 1.25
WIDE = 4
#: Cells of a sketch at least; a set has a quarter as many as shingles, or more.
CELLS = 512
#: Members of a key compared with so many others at once, and members of a key in a tile.
SLICE, TILE = 256, 4096
#: Of a document's open keys, the smallest so many are known wherever it is compared.
FIRST_KEYS = 16
#: Pairs that a task remembers in order to pass each on once; beyond, some pass twice until they are told apart by a shuffle.
REMEMBERED = 200_000
#: What a chance meeting counts for, in indexed keys, up to so many documents; beyond, as the square root of their number.
MEETING, MEETING_ROWS = 25.0, 250_000

#: Of keys that several sets have: each member beside the least one. wide: the key may have three members or more.
_LISTS = "key long, least long, doc_id long, wide boolean"
#: Packed keys, each one's least document in a block and whether it has others there; with members: all members of the keys that several of the block's sets have.
_ENTRIES = "part int, keys binary, least binary, several binary, members binary"


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles; a shorter text is one shingle."""
    h = C.word_hashes(C.split(text.lower()))
    if not len(h):
        return h
    return np.unique(C.rolling(h, min(width, len(h))))


def most_differing(small: int) -> int:
    """The most shingles that differ between similar sets if the smaller has so many."""
    return (small + small * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


@lru_cache(None)
def bands() -> np.ndarray:
    """The least size of each band. Sets smaller than the first link to equal sets only."""
    first = next(n for n in range(1, 1000) if most_differing(n))
    edges = [first]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * BAND)))
    return np.array(edges, np.int64)


@lru_cache(None)
def allocate(band: int, meeting: float = MEETING) -> tuple[int, int, int]:
    """(m, q, k) of a band, the cheapest that the pigeonhole allows."""
    size = int(bands()[band + 1]) - 1
    h = most_differing(size)

    def poisson(mean: float, upto: int) -> float:
        return sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(upto + 1))

    best = None
    for k in sorted({0, *(h * i // 32 for i in range(1, 13))}):
        for q in sorted({0, 1, 2, *(h * i // 64 for i in range(1, 9)), (h + 2) // 2}):
            m = h + 1 + 2 * k - q
            if m < max(1, q, k + q):
                continue
            unit = size / (m - q + q * WIDE)
            small = (m - q) * poisson(unit, 1)
            meetings = max(0.0, small - k) + 0.2 * (m - q) * poisson(unit, 2) / (1 + k) + q * poisson(unit * WIDE, 2)
            cost = (m - q - k) + q * (1 + unit * WIDE) + meeting * meetings
            if best is None or cost < best[0]:
                best = cost, m, q, k
    return best[1:]


def keys_of(sets: list[np.ndarray], meeting: float = MEETING) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the set) of all keys that the sets index."""
    sizes = np.array([len(s) for s in sets], np.int64)
    edges = bands()
    own = np.searchsorted(edges, sizes, "right") - 1
    lowest = np.searchsorted(edges, -(-sizes * PERCENT // 100), "right") - 1
    out_keys, out_sets = [], []
    for step in range(int((own - lowest).max(initial=0)) + 1):
        use = np.flatnonzero((own >= 0) & (own - step >= np.maximum(lowest, 0)))
        if not len(use):
            continue
        band = own[use] - step
        plans = np.array([allocate(int(b), meeting) for b in band], np.int64)
        m, q, k = plans.T
        flat = np.concatenate([sets[i] for i in use])
        at = np.repeat(np.arange(len(use)), sizes[use])
        salt = C.mix((band + 1).astype(np.uint64))
        value = C.mix(flat ^ salt[at])
        place = (value % (m - q + q * WIDE)[at].astype(np.uint64)).astype(np.int64)
        wide = q[at] * WIDE
        segment = np.where(place < wide, place // WIDE, place - wide + q[at])
        base = np.cumsum(m) - m
        spot = base[at] + segment
        total = int(m.sum())
        element = C.mix(value)
        low = np.bincount(spot, (element & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
        high = np.bincount(spot, (element >> np.uint64(32)).astype(float), total).astype(np.uint64)
        summed = low + (high << np.uint64(32))
        count = np.bincount(spot, minlength=total)
        owner = np.repeat(np.arange(len(use)), m)
        index = np.arange(total) - base[owner]
        plain = index >= q[owner]
        tag = C.mix(salt[owner] + (index + 1).astype(np.uint64))
        order = np.lexsort((index, count, ~plain, owner))
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total) - base[owner[order]]
        kept = ~plain | (rank >= k[owner])
        out_keys.append(C.mix(summed + tag)[kept])
        out_sets.append(use[owner[kept]])
        less = segment < q[at]
        out_keys.append(C.mix(summed[spot[less]] - element[less] + tag[spot[less]]))
        out_sets.append(use[at[less]])
    if not out_keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_sets)


def similar(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in cells modulo 4, in Gray code: the Hamming distance of two sketches is the sum of the counts' circular distances, which each differing shingle raises by one at most."""
    width = CELLS
    while 4 * width < len(s):
        width *= 2
    counts = np.bincount((s >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width) & 3
    return _coded(counts)


def _coded(counts: np.ndarray) -> bytes:
    gray = counts ^ (counts >> 1)
    return np.packbits(np.concatenate([gray & 1, gray >> 1]).astype(np.uint8)).tobytes()


def folded(sketch_: bytes) -> bytes:
    """The sketch with half as many cells."""
    low, high = np.unpackbits(np.frombuffer(sketch_, np.uint8)).reshape(2, -1)
    counts = 2 * high + (low ^ high)
    return _coded((counts[::2] + counts[1::2]) & 3)


def _words(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to so many bytes."""
    out = []
    for x in sketches:
        while len(x) > size:
            x = folded(x)
        out.append(x)
    return np.frombuffer(b"".join(out), np.uint64).reshape(len(out), -1)


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Least differences of the sets that pairs of sketches allow."""
    sizes = np.minimum([len(x) for x in a], [len(x) for x in b])
    out = np.empty(len(a), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.bitwise_count(_words([a[i] for i in at], size) ^ _words([b[i] for i in at], size)).sum(1)
    return out


def _bounded(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow."""
    of = lambda x: measured.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def allowed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            far = distances(list(pdf["sketch_a"]), list(pdf["sketch_b"]))
            yield pdf.loc[(100 + PERCENT) * far <= (100 - PERCENT) * (pdf["n_a"] + pdf["n_b"]).to_numpy(), ["a", "b"]]

    return joined.mapInPandas(allowed, "a long, b long")


def near_pairs(key: int, docs: np.ndarray, roots: np.ndarray, sizes: np.ndarray, chunks: np.ndarray, firsts: np.ndarray, sketches: list[bytes]):
    """Pairs (least, greatest) of a key's documents of different roots that sizes and sketches allow, but for those that meet at a smaller key.

    chunks: with two of them, pairs of one chunk are left out. firsts: each document's smallest keys, in order.
    """
    order = np.argsort(sizes, kind="stable")
    docs, roots, sizes, chunks, firsts = docs[order], roots[order], sizes[order], chunks[order], firsts[order]
    sketches = [sketches[i] for i in order]
    tiled = len(chunks) and chunks.min() != chunks.max()
    upto = np.searchsorted(sizes, sizes * 100 // PERCENT, "right")
    starts = C.runs(np.array([len(x) for x in sketches]))
    for first, last in zip(starts, np.append(starts[1:], len(docs))):
        # Those of one width, and behind them the larger ones that may be similar, folded to it.
        words = _words(sketches[first : upto[last - 1]], len(sketches[first]))
        for i in range(first, last, SLICE):
            rows = np.arange(i, min(i + SLICE, last))
            for j in range(i, int(upto[rows[-1]]), SLICE):
                others = np.arange(j, min(j + SLICE, int(upto[rows[-1]])))
                ok = (others[None, :] > rows[:, None]) & (others[None, :] < upto[rows][:, None]) & (roots[rows][:, None] != roots[others][None, :])
                if tiled:
                    ok &= chunks[rows][:, None] != chunks[others][None, :]
                x, y = np.nonzero(ok)
                x, y = rows[x], others[y]
                far = np.bitwise_count(words[x - first] ^ words[y - first]).sum(1, dtype=np.int64)
                near = (100 + PERCENT) * far <= (100 - PERCENT) * (sizes[x] + sizes[y])
                x, y = x[near], y[near]
                for k in range(0, len(x), 4096):
                    a, b = x[k : k + 4096], y[k : k + 4096]
                    smaller = ((firsts[a][:, :, None] == firsts[b][:, None, :]).any(2) & (firsts[a] < key)).any(1)
                    a, b = docs[a[~smaller]], docs[b[~smaller]]
                    if len(a):
                        yield np.minimum(a, b), np.maximum(a, b)


def _across(entries: DataFrame, measured: DataFrame) -> DataFrame:
    """Pairs (a, b) of a key's members (key, doc_id, root, members: their number) in different components that sizes and sketches allow."""
    parts = F.ceil(F.col("members") / TILE).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    tiles = (
        entries.withColumns({"parts": parts, "chunk": own})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "doc_id", "root", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    )

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held: list[pd.DataFrame] = []
        waiting = None

        def flush():
            pdf = pd.concat(held) if len(held) > 1 else held[0]
            names = pdf[["key", "low", "high"]].to_numpy()
            columns = [pdf[c].to_numpy() for c in ("doc_id", "root", "n", "chunk")]
            firsts = np.full((len(pdf), FIRST_KEYS), np.iinfo(np.int64).max)
            for own, x in zip(firsts, pdf["firsts"]):
                own[: len(x)] = x
            columns.append(firsts)
            sketches = list(pdf["sketch"])
            starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(1)))
            for a, b in zip(starts, np.append(starts[1:], len(names))):
                for x, y in near_pairs(int(names[a, 0]), *(c[a:b] for c in columns), sketches[a:b]):
                    fresh = set(zip(x.tolist(), y.tolist())) - seen
                    if fresh:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.update(fresh)
                        yield pd.DataFrame(list(fresh), columns=["a", "b"])

        for pdf in batches:
            if not len(pdf):
                continue
            # Rows of the batch's last tile wait for the next batch.
            names = pdf[["key", "low", "high"]].to_numpy()
            differ = np.flatnonzero((names != names[-1]).any(1))
            split = int(differ[-1]) + 1 if len(differ) else 0
            if split or held and waiting != tuple(names[-1]):
                held.append(pdf.iloc[:split])
                yield from flush()
                held.clear()
            held.append(pdf.iloc[split:])
            waiting = tuple(names[-1])
        if held:
            yield from flush()

    firsts = entries.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    known = measured.select("doc_id", "n", "sketch").join(firsts, "doc_id")
    placed = tiles.join(known, "doc_id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.select("key", "low", "high", "doc_id", "root", "n", "chunk", "firsts", "sketch").mapInPandas(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, plain: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets' intersection and union."""
    ends = pairs.select(F.col("a").alias("doc_id"), F.lit(True).alias("first")).union(pairs.select(F.col("b").alias("doc_id"), F.lit(False).alias("first")))
    needed = C.written(ends.groupBy("doc_id").agg(F.bool_or("first").alias("is_a"), F.bool_or(~F.col("first")).alias("is_b")))

    def build(batches):
        for pdf in batches:
            yield pdf.drop(columns="text").assign(shingles=[C.squeeze_sorted(shingles(t, width)) for t in pdf["text"]])

    wanted = C.thinned(plain, "doc_id", C.bitmap(needed, "doc_id")).join(C.checked(needed), "doc_id").select("doc_id", "text", "is_a", "is_b")
    sets = C.written(wanted.mapInPandas(build, "doc_id long, is_a boolean, is_b boolean, shingles binary"))
    of = lambda x: sets.where(f"is_{x}").select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))

    def verify(batches):
        for pdf in batches:
            rows, last = [], (None, None)
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["set_a"], pdf["set_b"]):
                if last[0] != a:
                    last = a, C.unsqueeze_sorted(x)
                rows.append((a, b, *similar(last[1], C.unsqueeze_sorted(y))))
            yield pd.DataFrame(rows, columns=["a", "b", "both", "either"])

    return pairs.join(of("b"), "b").join(of("a"), "a").mapInPandas(verify, "a long, b long, both long, either long")


def _indexed(docs: DataFrame, ranges: int, width: int, meeting: float) -> DataFrame:
    """In one reading of the texts, rows of two kinds: a document's doc_id, n, h1, h2 (a 128-bit hash of the set) and sketch; a block's packed keys (part is set)."""

    def run(batches):
        C.release()
        for ids, texts in C.gathered(batches):
            measured, sets = [], {}
            for doc, text in zip(ids, texts):
                s = shingles(text, width)
                h1, h2 = (int(np.add.reduce(C.mix(s ^ np.uint64(x)), initial=np.uint64(0)).astype(np.int64)) for x in (0, 0xD6E8FEB86659FD93))
                measured.append((doc, len(s), h1, h2, sketch(s)))
                # Of equal sets in a block, one indexes; a document without an id doesn't.
                if len(s) >= bands()[0] and doc != C.NO_ID and (h1, h2) not in sets or (h1, h2) in sets and C.NO_ID < doc < sets[h1, h2][0]:
                    sets[h1, h2] = doc, s
            yield pd.DataFrame(measured, columns=["doc_id", "n", "h1", "h2", "sketch"]).assign(part=-1, keys=None, least=None, several=None, members=None)
            rows = _packed(list(sets.values()), ranges, meeting)
            if rows:
                yield pd.DataFrame(rows, columns=["part", "keys", "least", "several", "members"]).assign(doc_id=0, n=0, h1=0, h2=0, sketch=None)

    return docs.mapInPandas(lambda batches: (x.astype(object) for x in run(batches)), "doc_id long, n long, h1 long, h2 long, sketch binary, " + _ENTRIES)


def _packed(sets: list[tuple[int, np.ndarray]], ranges: int, meeting: float) -> list[tuple]:
    """A block's (document, set) as rows of _ENTRIES."""
    docs = np.array([d for d, _ in sets], np.int64)
    keys, at = keys_of([s for _, s in sets], meeting)
    if not len(keys):
        return []
    own = docs[at]
    order = np.lexsort((own, keys))
    keys, own = keys[order], own[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]))
    keys, own = keys[fresh], own[fresh]
    starts = C.runs(keys)
    ends = np.append(starts[1:], len(keys))
    least, unique, shared = own[starts], keys[starts], ends - starts > 1
    cut = C.range_starts(unique, ranges)
    rows = [(p, C.squeeze_sorted(unique[a:b]), C.squeeze(least[a:b]), np.packbits(shared[a:b]).tobytes(), None) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    several = np.repeat(shared, ends - starts)
    if several.any():
        # The block's own members of a key pass through any range's task: none gathers a frequent key's.
        any_range = int(keys[0] % np.uint64(ranges))
        rows.append((any_range, C.squeeze_sorted(keys[several]), C.squeeze(np.repeat(least, ends - starts)[several]), None, C.squeeze(own[several])))
    return rows


def _candidates(entries: DataFrame) -> DataFrame:
    """Sets that have a key in common with others, beside the least of them: in a block, and the blocks' least ones over all blocks."""

    def meet(pdf):
        inner = pdf["members"].notna()
        keys = [C.unsqueeze_sorted(b) for b in pdf["keys"][~inner]]
        out = [pd.DataFrame({"key": C.unsqueeze_sorted(k).view(np.int64), "least": C.unsqueeze(a, np.int64), "doc_id": C.unsqueeze(m, np.int64), "wide": True}) for k, a, m in zip(pdf["keys"][inner], pdf["least"][inner], pdf["members"][inner])]
        if keys:
            flat = np.concatenate(keys)
            docs = np.concatenate([C.unsqueeze(b, np.int64) for b in pdf["least"][~inner]])
            others = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(pdf["several"][~inner], keys)])
            order = np.lexsort((docs, flat))
            flat, docs, others = flat[order], docs[order], others[order]
            starts = C.runs(flat)
            sizes = np.diff(np.append(starts, len(flat)))
            members = sizes + np.add.reduceat(others.astype(np.int64), starts)
            met = np.repeat(sizes > 1, sizes)
            found = pd.DataFrame({"key": flat.view(np.int64), "least": np.repeat(docs[starts], sizes), "doc_id": docs, "wide": np.repeat(members > 2, sizes)})[met]
            # Of a key with two members the pair is all there is.
            pairs = found.loc[~found["wide"] & (found["least"] < found["doc_id"])].drop_duplicates(["least", "doc_id"])
            out += [found[found["wide"]], pairs]
        return pd.concat(out, ignore_index=True)

    return entries.groupBy("part").applyInPandas(meet, _LISTS)


def jaccard_join(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    C.prepare(docs.sparkSession)
    rows, size = C.extent(docs, text_col)
    every = C.texts(docs, id_col, text_col)
    plain = every.where(F.col("doc_id") != F.expr("-9223372036854775807L - 1L"))
    meeting = MEETING * max(1.0, (rows / MEETING_ROWS) ** 0.5)
    indexed = C.written(_indexed(every, C.ranges_of(size, 0.8), width, meeting), "uncompressed")
    measured = indexed.where("part < 0").select("doc_id", "n", "h1", "h2", "sketch")
    known = measured.where(F.col("doc_id") != F.expr("-9223372036854775807L - 1L"))
    one_each = known.dropDuplicates(["doc_id"])

    lists = C.written(_candidates(indexed.where("part >= 0").select("part", "keys", "least", "several", "members")))
    stars = lists.select(F.col("least").alias("a"), F.col("doc_id").alias("b")).where("a < b").distinct()
    tested = C.written(_verified(C.written(_bounded(stars, one_each)), plain, width))
    linked = f"100 * both >= {PERCENT} * either"
    classes = C.written(known.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    equal = known.join(C.checked(classes), ["n", "h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("class").alias("v"))
    links = tested.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v")).union(equal)
    roots = C.written(components(links))

    # Keys whose members are in several components: compare across the components. Two members are a pair that is tested already.
    root = F.coalesce("root", "doc_id").alias("root")
    entries = C.written(lists.where("wide").select("key", "doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", root))
    open_keys = entries.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("members")).where("x <> y AND members > 2").select("key", "members")
    across = C.written(_across(C.written(entries.join(open_keys, "key")), one_each).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    if across.count():
        more = _verified(across, plain, width).where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = C.written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)))
    out = measured.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return C.shown(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")))
