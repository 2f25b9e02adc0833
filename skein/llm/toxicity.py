"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of two lexicons (a fixed seed list and one learned from the labelled texts), the nearness of lexicon
words to a second person, and rates of capitals, punctuation and obfuscation. Trees are boosted with Newton steps on
histograms of the features; the calibration is fitted on scores that each fold's trees give to rows they have not seen.

Labels come from a bounded sample (sample_rows, by a hash of the id); its features, some twenty numbers a row, are
all that the driver gets. Every document is scored by its whole text.

Null text is empty and is scored like any other. Labelled rows without a label or without a document are left out; of repeated labels of an id
the largest counts. Without labels of both kinds there is no evidence, and every score is 0. An empty table gives an empty result.
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

#: Insults that mark hostile texts, and second-person words of the corpus's languages.
SEED_WORDS = "clown disgusting dumb filth fool freak garbage idiot imbecile jerk loser moron pathetic scum stupid trash trashy ugly useless vermin worthless".split()
SECOND_PERSON = "dein deine deinen deiner dich dir du euch euer ihr te ti toi tu tus tú u ur usted ustedes votre vos vosotros vous you your yours yourself".split()

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 3, 0.2, 32, 20, 1.0
#: Words in the learned lexicon, and how near a second person counts.
LEXICON, NEAR = 200, 5

_punct = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_hidden = re.compile(rb"[A-Za-z]+(?:[0-9@$!*._|-]+[A-Za-z]+)+|[0-9@$]+[A-Za-z]+[A-Za-z0-9@$!*]*")
_letters = bytes.maketrans(b"013457@$!|", b"oieastasil")
_upper, _lower = re.compile(rb"[A-Z]"), re.compile(rb"[a-z]")
_marks, _symbols = re.compile(rb"[!?]"), re.compile(rb"[#*$%&|<>@^~_]")
_upper_words, _mark_runs = re.compile(rb"\b[A-Z]{2,}\b"), re.compile(rb"[!?]{2,}")

FEATURES = "log_words seed seed_density learned learned_density learned_weight learned_kinds near_second second_density hidden_hits hidden_density capitals capital_words marks mark_runs symbols punctuation".split()


def clean(words: list[bytes]) -> list[bytes]:
    return [w.strip(_punct) for w in words]


def features(text: bytes, learned: dict[bytes, float], seeds: frozenset, second: frozenset) -> list[float]:
    raw = C.split(text)
    words = clean(C.split(text.lower()))
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in learned or w in seeds]
    you = [i for i, w in enumerate(words) if w in second]
    near = 0
    if hits and you:
        at = np.array(you)
        spot = np.searchsorted(at, hits)
        gap = np.minimum(np.abs(at[np.minimum(spot, len(at) - 1)] - hits), np.abs(at[np.maximum(spot - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    own = [words[i] for i in hits]
    in_seed, in_learned = sum(w in seeds for w in own), [learned[w] for w in own if w in learned]
    hidden = [re.sub(rb"[^a-z]", b"", m.lower().translate(_letters)) for m in _hidden.findall(text)]
    disguised = sum(w in seeds or w in learned for w in hidden)
    upper, lower = len(_upper.findall(text)), len(_lower.findall(text))
    marks, symbols = len(_marks.findall(text)), len(_symbols.findall(text))
    return [
        np.log1p(len(raw)), in_seed, in_seed / n, len(in_learned), len(in_learned) / n, sum(in_learned), len(set(own)), near, len(you) / n,
        disguised, len(hidden) / n, upper / max(1, upper + lower), len(_upper_words.findall(text)) / n, marks / n, len(_mark_runs.findall(text)) / n, symbols / n, (marks + text.count(b".") + text.count(b",")) / n,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth: at each inner node a feature and a cut, at each leaf a value."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on histograms."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    cuts = [np.unique(np.concatenate([c, [0.0]])) for c in cuts]  # many densities are mostly zero
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    bins = max(len(c) for c in cuts) + 1
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    inner = 2**DEPTH - 1
    least = max(1, min(LEAF, int(min(y.sum(), n - y.sum()) / 4)))  # few labels of a kind: smaller leaves
    features_, cuts_, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-9)
            chosen: list[tuple[int, int] | None] = [None] * count
            for f in range(width):
                at = local * bins + binned[:, f]
                gs, hs, ns = (np.bincount(at, w, count * bins).reshape(count, bins) for w in (g, h, None))
                gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < least) | (nt - nl < least)] = 0
                gain = gain[:, : len(cuts[f])]
                for i, b in enumerate(gain.argmax(1)):
                    if gain[i, b] > best[i]:
                        best[i], chosen[i] = gain[i, b], (f, int(b))
            for i, c in enumerate(chosen):
                if c:
                    feature[first + i], cut[first + i] = c[0], cuts[c[0]][c[1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_at = node - inner
        leaf = -np.bincount(leaf_at, g, 2**DEPTH) / (np.bincount(leaf_at, h, 2**DEPTH) + RIDGE) * RATE
        raw += leaf[leaf_at]
        features_.append(feature)
        cuts_.append(cut)
        leaves.append(leaf)
    return Trees(base, np.array(features_), np.array(cuts_), np.array(leaves))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (raw, value) of the non-decreasing fit of least squares, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, least raw, largest raw
    for r, v in zip(raw[order], y[order]):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], high]
    at = np.array([[b[2], b[3]] for b in blocks]).ravel()
    return at, np.repeat([b[0] / b[1] for b in blocks], 2)


@dataclass
class Model:
    learned: dict[bytes, float]
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the calibrated probability, and within its steps by the trees."""
        if self.trees is None or not len(x):
            return np.zeros(len(x))
        raw = self.trees.raw(x)
        return 0.998 * np.interp(raw, self.at, self.value) + 0.002 / (1 + np.exp(-raw))

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        seeds, second = _lists()
        return np.array([features(t, self.learned, seeds, second) for t in texts], float).reshape(len(texts), len(FEATURES))


def _lists() -> tuple[frozenset, frozenset]:
    return frozenset(w.encode() for w in SEED_WORDS), frozenset(w.encode() for w in SECOND_PERSON)


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Words of the labelled texts (text, label) that mark label 1, with their log-odds: at most LEXICON.

    A word must follow many different words, so that words of one text that was copied a hundred times don't count.
    """

    def count(batches):
        held: dict[bytes, list[int]] = {}
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                words = clean(C.split(text.lower()))
                after = dict(zip(words[1:], words))
                for w in set(words):
                    if 2 <= len(w) <= 64:
                        c = held.setdefault(w, [0, 0, 0])
                        c[label] += 1
                        if label:
                            c[2] |= 1 << (C.word_hashes([after.get(w, b"")])[0] & np.uint64(63)).item()
        for i in range(0, len(keys := list(held)), 50_000):
            own = [held[k] for k in keys[i : i + 50_000]]
            bits = np.array([c[2] for c in own], np.uint64).view(np.int64)
            yield pd.DataFrame({"word": keys[i : i + 50_000], "zeros": [c[0] for c in own], "ones": [c[1] for c in own], "contexts": bits})

    zeros, ones = (sample.where(F.col("label") == k).count() for k in (0, 1))
    least = max(3, ones // 100)
    by_word = sample.select("text", "label").mapInPandas(count, "word binary, zeros long, ones long, contexts long").groupBy("word").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.bit_or("contexts").alias("contexts"))
    odds = F.log((F.col("ones") + 0.5) / (ones + 1.0)) - F.log((F.col("zeros") + 0.5) / (zeros + 1.0))
    found = by_word.where((F.col("ones") >= least) & (F.bit_count("contexts") >= min(16, least))).withColumn("odds", odds).where("odds >= 2").orderBy(F.desc(F.col("odds") * F.sqrt("ones")), "word").limit(LEXICON)
    return {bytes(r["word"]): float(r["odds"]) for r in found.collect()}


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most sample_rows labelled documents outside the held-out fold."""
    own = labels.where(F.col(label_col).isin(0, 1) & (C.fold(FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return C.written(C.texts(docs).join(F.broadcast(chosen), "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = 20_000) -> Model:
    """sample_rows bounds the labelled rows used and with them what is broadcast and what the driver gets."""
    sample = labelled(docs, labels, label_col, sample_rows)
    learned = learn_lexicon(sample)
    blank = Model(learned, None, np.empty(0), np.empty(0))

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": list(blank.of_texts(list(pdf["text"])))})

    rows = sample.mapInPandas(measure, "doc_id long, label int, x array<double>").orderBy("doc_id").toPandas()
    if rows["label"].nunique() < 2:
        return blank
    x, y = np.array(rows["x"].tolist()), rows["label"].to_numpy(float)
    part = np.arange(len(y)) % 3
    unseen = np.empty(len(y))
    for k in range(3):
        unseen[part == k] = boost(x[part != k], y[part != k]).raw(x[part == k])
    return Model(learned, boost(x, y), *isotonic(unseen, y))


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    spark = C.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # LEXICON words and TREES small trees

    def apply(batches):
        C.release()
        m = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                own = pdf.iloc[i : i + 512]
                s = m.score(m.of_texts(list(own["text"])))
                yield pd.DataFrame({"doc_id": own["doc_id"], "held_out": own["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    held_out = F.coalesce(C.fold(FOLDS, id_col) == HELD_OUT, F.lit(False)).alias("held_out")
    return C.shown(C.texts(docs, id_col, text_col, held_out).mapInPandas(apply, "doc_id long, held_out boolean, score double, predicted int"))
