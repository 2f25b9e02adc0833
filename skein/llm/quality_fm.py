"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: its words hashed into WORD_BUCKETS (square roots of their counts, scaled to length one),
and for each statistic of its structure and its size the one of a few quantile bins that it falls into. Score =
sigmoid(b + sum w_i x_i + sum over i<j of <v_i, v_j> x_i x_j); the pairwise part is half the sum over factors of
(sum v x)^2 - sum (v x)^2, in time linear in the entries. Weights and factors are learned by Adagrad on the logistic loss.

Labels come from a bounded sample (sample_rows, by a hash of the id); a row has at most WORD_BUCKETS entries of four bytes. Every document is
scored by its whole text. Null text is empty and is scored like any other. Rules for labels are those of the toxicity operator.
Without labels of both kinds every score is 0. An empty table gives an empty result.
A very long text is measured whole by one task. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common as C
from skein.llm.toxicity import FOLDS, HELD_OUT, isotonic, labelled

THRESHOLD = 0.7
WORD_BUCKETS, FACTORS, BINS = 4096, 8, 10
EPOCHS, BATCH, RATE, RIDGE = 12, 128, 0.08, 1e-5

_symbols, _upper, _lower, _digits = re.compile(rb"[#*$%&|<>]"), re.compile(rb"[A-Z]"), re.compile(rb"[a-z]"), re.compile(rb"[0-9]")
STATISTICS = "bytes words mean_word distinct top_word symbols capitals digits marks stops lines line_words dup_lines pairs longest".split()


def statistics(text: bytes, words: list[bytes], hashes: np.ndarray) -> list[float]:
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = len(_upper.findall(text)), len(_lower.findall(text))
    _, counts = np.unique(hashes, return_counts=True)
    pairs = C.rolling(hashes, 2)
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, len(counts) / n, counts.max(initial=0) / n, len(_symbols.findall(text)) / n,
        upper / max(1, upper + lower), len(_digits.findall(text)) / n, (text.count(b"!") + text.count(b"?")) / n, text.count(b".") / n, len(lines), len(words) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), len(np.unique(pairs)) / max(1, len(pairs)), max(map(len, words), default=0),
    ]


def measure(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Statistics, and each text's word buckets and their values."""
    stats, buckets, values = [], [], []
    for t in texts:
        words = C.split(t.lower())
        hashes = C.word_hashes(words)
        stats.append(statistics(t, words, hashes))
        own, counts = np.unique((hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), return_counts=True)
        v = np.sqrt(counts)
        buckets.append(own)
        values.append(v / max(1e-9, np.sqrt((v * v).sum())))
    return np.array(stats, float).reshape(len(texts), len(STATISTICS)), buckets, values


@dataclass
class Machine:
    cuts: list[np.ndarray]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def entries(self, stats: np.ndarray, buckets: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, start of each row) of the sparse rows."""
        bins = np.stack([WORD_BUCKETS + f * BINS + np.searchsorted(c, stats[:, f]) for f, c in enumerate(self.cuts)], 1)
        index = np.concatenate([np.concatenate([b, s]) for b, s in zip(buckets, bins)])
        value = np.concatenate([np.concatenate([v, np.ones(len(self.cuts))]) for v in values])
        lengths = np.array([len(b) + len(self.cuts) for b in buckets])
        return index, value, np.cumsum(lengths) - lengths

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factors[index] * value[:, None]
        square, squares = np.add.reduceat(vx, starts) ** 2, np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * (square - squares).sum(1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.weights) or not texts:
            return np.zeros(len(texts))
        raw = self.raw(*self.entries(*measure(texts)))
        return 0.998 * np.interp(raw, self.at, self.value) + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(stats: np.ndarray, buckets: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> Machine:
    rng = np.random.default_rng(7)
    size = WORD_BUCKETS + BINS * stats.shape[1]
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(stats.shape[1])]
    mean = np.clip(y.mean(), 0.01, 0.99)
    m = Machine(cuts, float(np.log(mean / (1 - mean))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), np.empty(0), np.empty(0))
    sw, sv, sb = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            index, value, starts = m.entries(stats[own], [buckets[k] for k in own], [values[k] for k in own])
            row = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(index))))
            vx = m.factors[index] * value[:, None]
            summed = np.add.reduceat(vx, starts)
            raw = m.bias + np.add.reduceat(m.weights[index] * value, starts) + 0.5 * (summed**2 - np.add.reduceat(vx * vx, starts)).sum(1)
            g = (1 / (1 + np.exp(-raw)) - y[own]) / len(own)
            gx = g[row] * value
            touched, at = np.unique(index, return_inverse=True)
            gw = np.bincount(at, gx) + RIDGE * m.weights[touched]
            inner = gx[:, None] * (summed[row] - vx)
            gv = np.stack([np.bincount(at, inner[:, f]) for f in range(FACTORS)], 1) + RIDGE * m.factors[touched]
            sw[touched] += gw**2
            sv[touched] += gv**2
            sb += g.sum() ** 2
            m.weights[touched] -= RATE * gw / np.sqrt(sw[touched])
            m.factors[touched] -= RATE * gv / np.sqrt(sv[touched])
            m.bias -= RATE * g.sum() / np.sqrt(sb)
    return m


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 12_000) -> Machine:
    """sample_rows bounds the labelled rows used and with them what is broadcast and what the driver gets. A fifth of them calibrates."""
    sample = labelled(docs, labels, label_col, sample_rows)

    def collect(batches):
        for pdf in batches:
            stats, buckets, values = measure(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "stats": list(stats), "buckets": [b.astype(np.uint16).tobytes() for b in buckets], "values": [v.astype(np.float32).tobytes() for v in values]})

    rows = sample.mapInPandas(collect, "doc_id long, label int, stats array<double>, buckets binary, values binary").orderBy("doc_id").toPandas()
    if rows["label"].nunique() < 2:
        return Machine([], 0.0, np.empty(0), np.empty((0, FACTORS)), np.empty(0), np.empty(0))
    stats, y = np.array(rows["stats"].tolist()), rows["label"].to_numpy(float)
    buckets = [np.frombuffer(b, np.uint16).astype(np.int64) for b in rows["buckets"]]
    values = [np.frombuffer(b, np.float32).astype(float) for b in rows["values"]]
    rest = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[~rest])) < 2 or len(np.unique(y[rest])) < 2:
        rest = np.ones(len(y), bool)
        learn = rest
    else:
        learn = ~rest
    pick = lambda use: (stats[use], [b for b, u in zip(buckets, use) if u], [v for v, u in zip(values, use) if u])
    m = train(*pick(learn), y[learn])
    m.at, m.value = isotonic(m.raw(*m.entries(*pick(rest))), y[rest])
    return m


def quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    spark = C.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(machine)  # some 300 kB whatever the input

    def apply(batches):
        m = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                own = pdf.iloc[i : i + 256]
                s = m.score(list(own["text"]))
                yield pd.DataFrame({"doc_id": own["doc_id"], "held_out": own["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    held_out = F.coalesce(C.fold(FOLDS, id_col) == HELD_OUT, F.lit(False)).alias("held_out")
    return C.shown(C.texts(docs, id_col, text_col, held_out).mapInPandas(apply, "doc_id long, held_out boolean, score double, predicted int"))
