"""Substring deduplication by Rabin-Karp hashes of every fixed-length window of words.

The input is written once as blocks of documents. A block hashes each window and reduces to one entry per distinct hash: the
smallest doc_id that has it there. Entries meet by hash range, where the smallest doc_id of all is found; a block gets back, for
each of its hashes, only whether a document before all of its own has it. It then knows for each window whether its word
sequence also starts in a document with a smaller doc_id. Such windows merge into maximal removal intervals.

A window in a third of all documents is one entry per block, so no key gathers in a task, and a block's answer is one
bit per entry. Windows are told apart by 80 bits: the rolling hash that they are sorted by, and 16 bits of a second one in
another base. Two different windows of n in all share them with probability n^2 / 2^81.

Null text has no words and nothing is removed. Texts shorter than a window are left alone; a very long text is a block of its own and is
held whole by one task. Rows with the same doc_id count as one document: they don't remove from each other. A null doc_id counts as the
smallest. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common as C

WINDOW = 13

#: Base of the second rolling hash.
_SECOND = 0xC2B2AE3D27D4EB4F
_ENTRIES = "part int, block long, keys binary, tags binary, first binary"
_SPANS = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept_text binary, carried string"


class Windows:
    """The windows of a block's documents: flat hashes, where each starts, and the documents' words."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], width: int):
        self.words = [C.split(t) for t in texts]
        words = [C.word_hashes(w) for w in self.words]
        self.counts = np.array([max(0, len(h) - width + 1) for h in words], np.int64)
        flat = np.concatenate([C.rolling(h, width) for h in words]) if words else np.empty(0, np.uint64)
        tag = np.concatenate([C.rolling(h, width, _SECOND).astype(np.uint16) for h in words]) if words else np.empty(0, np.uint16)
        self.doc = np.repeat(np.asarray(ids, np.int64), self.counts)
        order = np.lexsort((self.doc, tag, flat))
        sorted_, tags = flat[order], tag[order]
        starts = np.flatnonzero(np.append(True, (sorted_[1:] != sorted_[:-1]) | (tags[1:] != tags[:-1]))) if len(flat) else np.empty(0, np.int64)
        self.keys, self.tags, self.first = sorted_[starts], tags[starts], self.doc[order][starts]
        self.entry = np.empty(len(flat), np.int64)
        self.entry[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))

    def removed(self, earlier: np.ndarray) -> list[np.ndarray]:
        """Window starts of each document that go; earlier: by entry, whether a document before all of the block has it."""
        goes = earlier[self.entry] | (self.doc > self.first[self.entry])
        return [np.flatnonzero(x) for x in np.split(goes, np.cumsum(self.counts)[:-1])]


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + width).tolist()))


def find_spans(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), originals: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, spans (of words, removed), kept_text (bytes; kept words joined by one space), carried.

    carried is a struct of the columns in carry, so that they need no join; originals: a text that loses nothing is its own kept_text.
    """
    C.prepare(docs.sparkSession)
    ranges = C.ranges_for(docs, text_col=text_col)
    kept = F.to_json(F.struct(*carry)).alias("carried") if carry else F.lit("{}").alias("carried")
    blocks = C.block_table(C.texts(docs, id_col, text_col, kept), carry=F.col("carried"))

    def emit(batches):
        C.release()
        for pdf in batches:
            for block, *packed in zip(*(pdf[c] for c in ("block", "ids", "sizes", "marks", "texts"))):
                ids, texts, _ = C.block_rows(*packed)
                w = Windows(ids, texts, width)
                if len(w.keys):
                    at = C.range_starts(w.keys, ranges)
                    rows = [(p, block, C.squeeze_sorted(w.keys[a:b]), w.tags[a:b].tobytes(), C.squeeze(w.first[a:b])) for p, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
                    yield pd.DataFrame(rows, columns=["part", "block", "keys", "tags", "first"])

    def meet(pdf):
        keys = [C.unsqueeze_sorted(b) for b in pdf["keys"]]
        flat, first = np.concatenate(keys), np.concatenate([C.unsqueeze(b, np.int64) for b in pdf["first"]])
        tags = np.frombuffer(b"".join(pdf["tags"]), np.uint16)
        order = np.lexsort((tags, flat))
        sorted_, own = flat[order], tags[order]
        starts = np.flatnonzero(np.append(True, (sorted_[1:] != sorted_[:-1]) | (own[1:] != own[:-1])))
        least = np.minimum.reduceat(first[order], starts)
        of_all = np.empty(len(flat), np.int64)
        of_all[order] = np.repeat(least, np.diff(np.append(starts, len(flat))))
        bits = [np.packbits(x).tobytes() for x in np.split(of_all < first, np.cumsum([len(k) for k in keys])[:-1])]
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "n": [len(k) for k in keys], "bits": bits})

    answers = C.written(blocks.mapInPandas(emit, _ENTRIES).groupBy("part").applyInPandas(meet, "block long, part int, n long, bits binary"))

    def judge(rows, answer):
        ids, texts, _ = C.block_rows(*rows.iloc[0][["ids", "sizes", "marks", "texts"]])
        w = Windows(ids, texts, width)
        answer = answer.sort_values("part")
        earlier = np.concatenate([np.empty(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(answer["bits"], answer["n"]))]).astype(bool)
        out = []
        for doc, text, words, starts, carried in zip(ids.tolist(), texts, w.words, w.removed(earlier), C.carried_of(rows["carried"].iloc[0])):
            spans, kept, at = intervals(starts, width), [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((doc, len(words), len(words) - len(kept), [{"start": a, "stop": b} for a, b in spans], text if originals and not spans else b" ".join(kept), carried))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text", "carried"])

    out = C.shown(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(judge, _SPANS))
    return out.withColumn("carried", F.from_json("carried", docs.select(*carry).schema)) if carry else out.drop("carried")


def substring_dedup(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256."""
    return find_spans(docs, width, id_col, text_col).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
