"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

The probability of a word after others mixes estimates of falling order, each with a weight by the bucket of its context's
frequency, in powers of two: P3 = l3[b(u v)] c(u v w)/c(u v) + (1 - l3) P2, P2 = l2[b(v)] c(v w)/c(v) + (1 - l2) P1,
P1 = l1 c(w)/N + (1 - l1)/(V + 1). A context that doesn't occur has weight 0, so that each level is a distribution. Weights come
from expectation-maximisation over held-out events: the training documents of one fold, with the counts of the others. Events
enter as a histogram by buckets and by steps of the estimates' logarithms, each cell with its events' mean logarithms; it has a
bounded size whatever the input and covers every event of the fold. Scores then use the counts of all training documents.

Counts cover all training documents. N-grams are told apart by 59 bits of their hashes: of n different words two share them with probability
n^2 / 2^60, and a longer n-gram shares its count with another one with probability n / 2^59. The input is written once as blocks of documents; blocks count their
distinct n-grams, and counts meet by ranges of their hashes; a block gets back, in the order of its own sorted keys, the training
count of each. A frequent word is one entry per block. No table of counts is ever broadcast or gathered.

Null text is empty: such a document is one end token. A very long text is a block of its own and is held whole by one task. Documents
of fold 0 are held out of training, those of fold 1 are the held-out events for the weights. Without events the weights are a half each;
without training documents every word is unknown and the uniform estimate decides. A null doc_id is in no fold that trains. Rows
with the same doc_id are scored each for itself. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common as C

FOLDS, ADDED = 10, 0.1
#: Buckets of context frequency: 0, then powers of two, the last one open.
BUCKETS = 24
#: Steps of a histogram's estimates in decades, and the smallest step.
STEP, LOWEST = 0.5, -40
ROUNDS = 60
#: Least share that a level leaves to the next one.
FLOOR = 1e-7
#: The highest order of n-grams.
ORDER = 3

#: Keys are the upper 60 bits, the last of which tells words from longer n-grams. The end token and the place before a text have keys of their own.
_LOW, _WORD, _HASH = np.uint64(4), np.uint64(16), np.uint64(0xFFFFFFFFFFFFFFE0)
_END, _START = np.uint64(0x5851F42D4C957F30), np.uint64(0x14057B7EF7678150)
_ENTRIES = "part int, block long, held boolean, keys binary, counts binary"
_ANSWERS = "block long, part int, n long, counts binary, others binary, tokens long, types long, other_tokens long, other_types long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_CELLS = [f"b{k}" for k in range(2, ORDER + 1)] + [f"s{k}" for k in range(1, ORDER + 1)]
_SUMS = ["n"] + [f"log{k}" for k in range(1, ORDER + 1)]


class Grams:
    """The n-grams of a block: entries of the n-gram that ends in each token, and of its context, by order."""

    def __init__(self, texts: list[bytes], trains: np.ndarray):
        hashes = [C.word_hashes(C.split(t.lower())) for t in texts]
        self.lengths = np.array([len(h) + 1 for h in hashes], np.int64)
        total, docs = int(self.lengths.sum()), len(texts)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        token = np.full(total, _END)
        inside = np.ones(total, bool)
        inside[ends - 1] = False
        if total:
            token[inside] = np.concatenate(hashes) & _HASH | _WORD
        grams, mixed = [token], C.mix(token)
        for k in range(2, ORDER + 1):
            before = np.empty(total, np.uint64)
            before[1:] = grams[-1][:-1]
            before[self.starts] = _START
            grams.append(C.mix(before * np.uint64(2 * k + 1) + mixed) & _HASH)
        flat = np.concatenate([*grams, np.full(docs, _START)])
        trained = np.repeat(trains, self.lengths)
        weight = np.concatenate([*[trained] * ORDER, trains]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        sorted_ = flat[order]
        starts = C.runs(sorted_)
        self.keys = sorted_[starts]
        self.counts = np.add.reduceat(weight[order], starts) if len(flat) else weight
        entry = np.empty(len(flat), np.int32)
        entry[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(flat))))
        self.grams = [entry[k * total : (k + 1) * total] for k in range(ORDER)]
        self.contexts = []
        for own in self.grams[:-1]:
            context = np.empty(total, np.int32)
            context[1:] = own[:-1]
            context[self.starts] = entry[ORDER * total :]
            self.contexts.append(context)

    def estimates(self, counts: np.ndarray, tokens: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(maximum-likelihood estimates of each order, frequencies of the contexts of each order from 2) of every token."""
        context = [counts[c] for c in self.contexts]
        return [counts[self.grams[0]] / max(1, tokens), *(counts[g] / np.maximum(c, 1) for g, c in zip(self.grams[1:], context))], context


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _log(p: np.ndarray) -> np.ndarray:
    return np.log10(np.where(p > 0, p, 1))


def _step(p: np.ndarray) -> np.ndarray:
    """The estimate's step; LOWEST: it is zero."""
    return np.where(p > 0, np.maximum(np.rint(_log(p) / STEP), LOWEST + 1), LOWEST).astype(np.int64)


def histogram_of(estimates: list[np.ndarray], contexts: list[np.ndarray]) -> pd.DataFrame:
    """Events by buckets and steps: columns _CELLS and _SUMS."""
    cells = {f"b{k}": bucket(c) for k, c in enumerate(contexts, 2)} | {f"s{k}": _step(p) for k, p in enumerate(estimates, 1)}
    return pd.DataFrame(cells | {"n": 1} | {f"log{k}": _log(p) for k, p in enumerate(estimates, 1)}).groupby(_CELLS)[_SUMS].sum().reset_index()


def mixed(weights: np.ndarray, estimates: list[np.ndarray], contexts: list[np.ndarray], uniform: float) -> np.ndarray:
    """The probability of each token: weights[k - 1] are those of order k by bucket."""
    p = weights[0, 0] * estimates[0] + (1 - weights[0, 0]) * uniform
    for w, own, c in zip(weights[1:], estimates[1:], contexts):
        share = w[bucket(c)]
        p = share * own + (1 - share) * p
    return p


def learn_weights(histogram: pd.DataFrame, uniform: float) -> np.ndarray:
    """(ORDER, BUCKETS) weights, by expectation-maximisation over the histogram's events; order 1 has one context and so one weight.

    Contexts that don't occur weigh nothing. A bucket without events takes the weight of the nearest one below that has any.
    """
    weights = np.full((ORDER, BUCKETS), 0.5)
    weights[1:, 0] = 0
    if not len(histogram):
        return weights
    n = histogram["n"].to_numpy(float)
    p = [np.where(histogram[f"s{k}"] > LOWEST, 10.0 ** (histogram[f"log{k}"] / n), 0.0) for k in range(1, ORDER + 1)]
    b = [np.zeros(len(n), np.int64), *(histogram[f"b{k}"].to_numpy() for k in range(2, ORDER + 1))]
    events = [np.bincount(x, n, BUCKETS) for x in b]
    for _ in range(ROUNDS):
        share = [w[x] for w, x in zip(weights, b)]
        level = [np.full(len(n), uniform)]  # the mixture up to each order
        for s, own in zip(share, p):
            level.append(s * own + (1 - s) * level[-1])
        reach = n / level[-1]  # events by probability, times what higher orders leave
        for k in range(ORDER - 1, -1, -1):
            took, left = reach * share[k] * p[k], reach * (1 - share[k]) * level[k]
            of, all_ = np.bincount(b[k], took, BUCKETS), np.bincount(b[k], took + left, BUCKETS)
            weights[k] = np.where(all_ > 0, of / np.where(all_ > 0, all_, 1), weights[k])
            reach = reach * (1 - share[k])
    for k in range(ORDER):
        for x in range(1, BUCKETS):
            if not events[k][x] and (k or x):
                weights[k, x] = weights[k, x - 1] if x > 1 else weights[k, x]
    weights = np.minimum(weights, 1 - FLOOR)
    weights[1:, 0] = 0
    return weights


def lm_scoring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    C.prepare(docs.sparkSession)
    ranges = C.ranges_for(docs, 0.8 * ORDER, text_col)
    fold = F.coalesce(C.fold(FOLDS, id_col), F.lit(0)).cast("int")
    blocks = C.block_table(C.texts(docs, id_col, text_col, F.least(fold, F.lit(2)).alias("fold")), F.col("fold"))

    def emit(batches):
        for pdf in batches:
            for block, *packed in zip(*(pdf[c] for c in ("block", "ids", "sizes", "marks", "texts"))):
                _, texts, folds = C.block_rows(*packed)
                g = Grams(texts, folds != 0)
                at, held = C.range_starts(g.keys, ranges), bool(folds[0] == 1)
                rows = [(p, block, held, C.squeeze_sorted(g.keys[a:b] >> _LOW), C.squeeze(g.counts[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["part", "block", "held", "keys", "counts"])

    def meet(pdf):
        keys = [C.unsqueeze_sorted(b) << _LOW for b in pdf["keys"]]
        sizes = [len(k) for k in keys]
        flat = np.concatenate(keys)
        own = np.concatenate([C.unsqueeze(b, np.uint32) for b in pdf["counts"]]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        sorted_ = flat[order]
        starts = C.runs(sorted_)
        lengths = np.diff(np.append(starts, len(flat)))
        words = sorted_[starts]
        words = (words & _WORD > 0) & (words != _START)

        def over(counts):
            summed = np.add.reduceat(counts[order], starts)
            of_all = np.empty(len(flat), np.int64)
            of_all[order] = np.repeat(summed, lengths)
            return np.split(of_all, np.cumsum(sizes)[:-1]), int(summed[words].sum()), int((summed[words] > 0).sum())

        held = pdf["held"].to_numpy(bool)
        of_all, tokens, types = over(own)
        others, other_tokens, other_types = over(own * np.repeat(~held, sizes))
        out = pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "n": sizes})
        out["counts"] = [C.squeeze(x) for x in of_all]
        out["others"] = [C.squeeze(x) if h else None for x, h in zip(others, held)]
        out[["tokens", "types", "other_tokens", "other_types"]] = 0
        out.loc[out.index[0], ["tokens", "types", "other_tokens", "other_types"]] = tokens, types, other_tokens, other_types
        return out

    answers = C.written(blocks.mapInPandas(emit, _ENTRIES).groupBy("part").applyInPandas(meet, _ANSWERS))
    tokens, types, other_tokens, other_types = (int(x or 0) for x in answers.agg(*(F.sum(c) for c in ("tokens", "types", "other_tokens", "other_types"))).first())
    uniform = 1 / (types + 1)

    def counted(rows, answer, column):
        """The block's documents and n-grams, and the training counts of its keys."""
        ids, texts, folds = C.block_rows(*rows.iloc[0][["ids", "sizes", "marks", "texts"]])
        counts = np.concatenate([C.unsqueeze(b, np.int64) for b in answer.sort_values("part")[column]])
        return ids, folds, Grams(texts, folds != 0), counts

    def events(rows, answer):
        *_, g, counts = counted(rows, answer, "others")
        return histogram_of(*g.estimates(counts, other_tokens))

    cells = ", ".join([*(f"{c} long" for c in _CELLS), "n long", *(f"{c} double" for c in _SUMS[1:])])
    held = blocks.where("substring(marks, 1, 1) = X'01'")
    met = held.groupBy("block").cogroup(answers.where("others IS NOT NULL").groupBy("block"))
    histogram = met.applyInPandas(events, cells).groupBy(*_CELLS).agg(*(F.sum(c).alias(c) for c in _SUMS)).toPandas()
    weights = learn_weights(histogram, 1 / (other_types + 1))

    def score(rows, answer):
        ids, folds, g, counts = counted(rows, answer, "counts")
        p = mixed(weights, *g.estimates(counts, tokens), uniform)
        c1 = counts[g.grams[0]]
        base = np.log10((c1 + ADDED) / (tokens + ADDED * (types + 1)))
        add = lambda x: np.add.reduceat(x, g.starts)
        return pd.DataFrame({"doc_id": ids, "held_out": folds == 0, "n_tokens": g.lengths, "n_known": add((c1 > 0).astype(np.int64)), "train_tokens": tokens, "base_score": add(base), "score": add(np.log10(p))})

    return C.shown(blocks.groupBy("block").cogroup(answers.select("block", "part", "counts").groupBy("block")).applyInPandas(score, _SCORES))
