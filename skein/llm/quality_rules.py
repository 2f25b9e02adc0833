"""Quality rules as a short-circuit cascade.

Rules are predicates over a document's measures. On a sample of whole documents each rule's cost (seconds a document, with all that it
has to measure) and its selectivity are estimated where the cascade will run it: over the documents that the rules before it
leave, with what those have measured already known. The rule that rejects most per cost comes next. Rules then run in that order,
each over the documents that no earlier rule rejected. The order changes only what the verdict costs: a document is kept if no rule
rejects it.

Null text has no words; a text without words is rejected. A very long text is measured whole by one task. Repeated rows get equal results.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common as C

#: Different texts (those with the smallest hashes) on which costs and selectivities are estimated. No verdict depends on it.
SAMPLE = 400
#: Words of texts counted at once for repeated windows.
WORDS_AT_ONCE = 1 << 20
WINDOW = 5

_symbols = re.compile(rb"[#*$%&|<>]")
_letters = regex.compile(r"\p{L}")
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]")


class Document:
    """A text and what rules measure of it, each measured once when first asked for."""

    def __init__(self, text: bytes, words: list[bytes], repeated: int | None = None):
        self.text, self.words, self.n_words = text, words, len(words)
        self._known = {} if repeated is None else {"repeated": repeated}

    def once(self, name: str, measure: Callable):
        if name not in self._known:
            self._known[name] = measure(self)
        return self._known[name]

    @property
    def string(self) -> str:
        return self.once("string", lambda d: d.text.decode("utf-8", "replace"))

    @property
    def n_repeat_words(self) -> int:
        return self.once("repeated", lambda d: repeated_window_words([C.word_hashes(d.words)])[0])

    @property
    def word_chars(self) -> int:
        return self.once("word_chars", lambda d: len(d.string) - sum(d.text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))

    @property
    def n_symbols(self) -> int:
        return self.once("n_symbols", lambda d: len(_symbols.findall(d.text)))

    @property
    def n_dup_lines(self) -> int:
        def measure(d):
            lines = [x for x in d.text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            return len(lines) - len(set(lines))

        return self.once("n_dup_lines", measure)

    @property
    def n_lines(self) -> int:
        return self.once("n_lines", lambda d: sum(1 for x in d.text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")))

    @property
    def n_letters(self) -> int:
        return self.once("n_letters", lambda d: len(_letters.findall(d.string)))

    @property
    def n_upper(self) -> int:
        return self.once("n_upper", lambda d: len(_upper.findall(d.string)))

    @property
    def distinct_words(self) -> int:
        return self.once("distinct", lambda d: len(set(d.words)))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def default_rules() -> list[Rule]:
    """Thresholds are of a kind usual for web text; each rejects plain junk and leaves prose of any of our languages alone."""
    return [
        Rule("few_words", lambda d: d.n_words < 10),
        Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
        Rule("mean_word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 18 * d.n_words),
        Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
        Rule("duplicate_lines", lambda d: 100 * d.n_dup_lines > 30 * d.n_lines),
        Rule("letters", lambda d: 100 * d.n_letters < 60 * d.word_chars),
        Rule("capitals", lambda d: 100 * d.n_upper > 40 * max(1, d.n_letters)),
        Rule("one_word_over_and_over", lambda d: d.n_words >= 50 and 100 * d.distinct_words < 10 * d.n_words),
    ]


def repeated_window_words(hashes: list[np.ndarray]) -> list[int]:
    """For each text's word hashes: words in windows of WINDOW words that occur twice or more in that text."""
    out = []
    i = 0
    while i < len(hashes):
        k, total = i, 0
        while k < len(hashes) and (k == i or total + len(hashes[k]) <= WORDS_AT_ONCE):
            total += len(hashes[k])
            k += 1
        own = hashes[i:k]
        lengths = np.array([len(h) for h in own])
        flat = np.concatenate(own) if total else np.empty(0, np.uint64)
        starts = np.cumsum(lengths) - lengths
        rolled = C.rolling(flat, WINDOW)
        doc = np.repeat(np.arange(len(own)), lengths)
        inside = doc[: len(rolled)] == doc[WINDOW - 1 :] if len(rolled) else np.empty(0, bool)
        at = np.flatnonzero(inside)
        keys = C.mix(rolled[at] ^ C.mix(doc[at].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        same = sorted_keys[1:] == sorted_keys[:-1]
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edges = np.zeros(total + 1, np.int32)
        found = at[order[twice]]
        np.add.at(edges, found, 1)
        np.add.at(edges, found + WINDOW, -1)
        covered = np.append(0, np.cumsum(np.cumsum(edges[:-1]) > 0))
        out += [int(covered[s + n] - covered[s]) for s, n in zip(starts, lengths)]
        i = k
    return out


def measured(texts: list[bytes]) -> list[Document]:
    words = [C.split(t) for t in texts]
    return [Document(*x) for x in zip(texts, words, repeated_window_words([C.word_hashes(w) for w in words]))]


def order_of(texts: list[bytes], rules: list[Rule]) -> list[int]:
    """The rules by rejection per cost, each measured on the texts that those before it leave."""
    docs, left, order = [Document(t, C.split(t)) for t in texts], list(range(len(rules))), []
    while left:
        ranked = []
        for i in left:
            # Copies, so that every rule pays for what it measures itself, and only for that.
            own = [Document(d.text, d.words) for d in docs]
            for d, known in zip(own, docs):
                d._known = dict(known._known)
            began = time.perf_counter()
            rejected = [rules[i].rejects(d) for d in own]
            cost = (time.perf_counter() - began) / max(1, len(own)) + 1e-9
            ranked.append((-(sum(rejected) / max(1, len(own))) / cost, cost, i, own, rejected))
        _, _, best, own, rejected = min(ranked, key=lambda x: x[:3])
        order.append(best)
        left.remove(best)
        docs = [d for d, r in zip(own, rejected) if not r]
    return order


def plan_cascade(docs: DataFrame, rules: Callable[[], list[Rule]]) -> list[int]:
    """Where each rule stands, measured on SAMPLE different texts by one task; no text goes to the driver."""
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    sample = hashed.where(F.col("h") <= max(chosen, default=0)).dropDuplicates(["h"]).select("text")

    def measure(batches):
        texts = [t for pdf in batches for t in pdf["text"]]
        yield pd.DataFrame({"rule": order_of(texts, rules())})

    return [r["rule"] for r in sample.coalesce(1).mapInPandas(measure, "rule int").collect()]


def run_cascade(docs: list[Document], rules: list[Rule]) -> list[str | None]:
    """The first rule in this order that rejects each document; None: kept."""
    verdict: list[str | None] = [None] * len(docs)
    alive = range(len(docs))
    for rule in rules:
        left = []
        for i in alive:
            if rule.rejects(docs[i]):
                verdict[i] = rule.name
            else:
                left.append(i)
        alive = left
    return verdict


_COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, rules: Callable[[], list[Rule]] = default_rules, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed (few words or repeated windows) and kept; without counts doc_id, n_words, kept alone, and no rule measures more than the cascade reaches."""
    C.prepare(docs.sparkSession)
    plain = C.texts(docs, id_col, text_col)
    order = plan_cascade(plain, rules)

    def judge(batches):
        made = rules()
        cascade = [made[i] for i in order]
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                own = pdf.iloc[i : i + 512]
                found = measured(list(own["text"])) if counts else [Document(t, C.split(t)) for t in own["text"]]
                kept = np.array([v is None for v in run_cascade(found, cascade)], bool)
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if counts else ("n_words",)
                out = pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), **{c: [getattr(d, c) for d in found] for c in names}})
                if counts:
                    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
                    kept &= ~out["base_failed"].to_numpy()
                yield out.assign(kept=kept)

    return C.shown(plain.mapInPandas(judge, _COLUMNS if counts else "doc_id long, n_words long, kept boolean"))
