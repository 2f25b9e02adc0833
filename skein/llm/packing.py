"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of `length` tokens serves each source queue its target share. Queues have weights: targets gives them, and a source
without one weighs its own share of all tokens; without targets all queues end together. In a round each queue earns length times
its weight over that of the queues that are not empty. It is served what it has earned, rounded to whole tokens, and its
deficit, the part of a token by which that differs, goes to its next round; a queue that runs dry leaves its share to the
others in proportion to their weights. Rounds follow each other without a gap, so that windows are exactly full. No queue is ever
more than one token off what it has earned.

The state after any number of rounds has a closed form: with T_i tokens and weight w_i, queue i has earned min(T_i, w_i v), where the
virtual time v is such that all queues together have earned the round's tokens. So any partition can cut its own documents from
their start positions alone, with no state handed from one to the next: deficits carry across windows and partitions.

A queue is a source's documents in the order they are read; start positions are prefix sums over (task, source). The sources with a
target and the largest others, QUEUES in all, have queues of their own; the rest share one, in the order of their names, which
weighs what they weigh together.

Null text is empty, and a document is at least its end token. A very long text is cut like any other; a task holds one such text's ids at
once. A null source is a queue of its own. Rows with the same doc_id are documents of their own. An empty table gives no pieces. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import common as C
from skein.llm.tokens import encoder

#: Documents encoded at once.
BATCH = 256
#: Queues at most; their totals are known to the driver and all tasks.
QUEUES = 4096

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


class Schedule:
    """Which window and offset each token of each queue gets. weights: by queue, of any scale; by default the queues' totals."""

    def __init__(self, totals: list[int], length: int, weights: list[Fraction | int] | None = None):
        self.totals, self.length, self.total = totals, length, sum(totals)
        exact = [Fraction(w) for w in (totals if weights is None else weights)]
        scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
        self.weights = [int(w * scale) for w in exact]
        # Phases, between which a queue runs dry: tokens up to there, tokens of dry queues, weight of the others.
        order = sorted(range(len(totals)), key=lambda i: Fraction(totals[i], self.weights[i]))
        dry, alive, self._phases = 0, sum(self.weights), []
        for i in order:
            self._phases.append((dry + alive * Fraction(totals[i], self.weights[i]), dry, alive))
            dry, alive = dry + totals[i], alive - self.weights[i]
        self._ends = [p[0] for p in self._phases]
        self._rounds: dict[int, tuple[list[int], list[int]]] = {}

    def served(self, rounds: int) -> tuple[list[int], list[int]]:
        """(tokens of each queue in the first so many rounds, the same summed up to each queue)."""
        found = self._rounds.get(rounds)
        if found is None:
            tokens = min(rounds * self.length, self.total)
            _, dry, alive = self._phases[min(bisect_left(self._ends, tokens), len(self._ends) - 1)]
            p, q = tokens - dry, alive  # the virtual time
            own = [min(t, (2 * w * p + q) // (2 * q)) for t, w in zip(self.totals, self.weights)]
            if len(self._rounds) > max(64, (1 << 20) // len(self.totals)):
                self._rounds.clear()
            found = self._rounds[rounds] = own, [0, *accumulate(own)]
        return found

    def round_of(self, queue: int, token: int) -> int:
        """The round that serves a queue's token."""
        a, b = 2 * token + 1, 2 * self.weights[queue]
        earned = sum(min(t * b, w * a) for t, w in zip(self.totals, self.weights)) // b
        at = max(0, earned // self.length)
        while at and self.served(at)[0][queue] > token:
            at -= 1
        while self.served(at + 1)[0][queue] <= token:
            at += 1
        return at

    def cuts(self, queue: int, start: int, n: int):
        """(window, offset in the window, position in the document, length) of each piece of a document that starts there in its queue."""
        at, end, turn = start, start + n, self.round_of(queue, start)
        while at < end:
            (low, before), (high, after) = self.served(turn), self.served(turn + 1)
            stop = min(high[queue], end)
            place = before[-1] + after[queue] - before[queue] + at - low[queue]
            while at < stop:
                window, offset = divmod(place, self.length)
                size = min(stop - at, self.length - offset)
                yield window, offset, at - start, size
                at, place = at + size, place + size
            turn += 1


def _name(source):
    """A source's name as text; a null source's is empty."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, keep_space: bool) -> DataFrame:
    """doc_id, source, ids (flat unsigned 16-bit where all ids of the tokenizer fit, else 32-bit), n, task, start in the task's part of the source."""

    def encode(batches):
        from pyspark import TaskContext

        task, enc, starts = TaskContext.get().partitionId(), encoder(tokenizer, keep_space), {}
        narrow = max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                own = pdf.iloc[i : i + BATCH]
                ids = [b + end for b in enc.encode(list(own["text"]))]
                n = [len(b) // 4 for b in ids]
                start = []
                for source, k in zip(own["source"], n):
                    start.append(starts.get(source, 0))
                    starts[source] = start[-1] + k
                yield pd.DataFrame({"doc_id": own["doc_id"], "source": own["source"], "ids": [np.frombuffer(b, "<u4").astype("<u2").tobytes() for b in ids] if narrow else ids, "n": n, "task": task, "start": start})

    plain = docs.select(C.hidden(), F.coalesce("text", F.lit("")).alias("text"), _name(F.col("source")).alias("source"))
    return C.written(plain.mapInPandas(encode, "doc_id long, source string, ids binary, n long, task int, start long"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, keep_space: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_ids: bool = False, targets: dict | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, and ids if asked for.

    targets: positive weights by source (None: the null source).
    """
    spark = C.prepare(docs.sparkSession)
    wanted = {"" if k is None else f"={k}": Fraction(str(w)) for k, w in (targets or {}).items()}
    if len(wanted) >= QUEUES or any(w <= 0 for w in wanted.values()):
        raise ValueError(f"targets are positive, and fewer than {QUEUES}")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    encoded = _encoded(plain, tokenizer, end_id, keep_space)
    parts = C.written(encoded.groupBy("source", "task").agg(F.sum("n").alias("n")))
    sums = parts.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    largest = sums.orderBy(F.col("source").isin(list(wanted)).desc(), F.desc("n"), "source").limit(QUEUES - 1).collect()
    own = sorted((r["source"], r["n"]) for r in largest)
    pooled = total - sum(n for _, n in own)
    names, totals = [x for x, _ in own], [n for _, n in own] + [pooled] * (pooled > 0)
    weights = [wanted.get(x, Fraction(n, total)) for x, n in own] + [Fraction(pooled, max(1, total))] * (pooled > 0)
    schedule = Schedule(totals, length, weights)
    queues = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "source string, queue int")
    placed_parts = parts.join(F.broadcast(queues), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    bases = placed_parts.select("source", "task", "queue", (F.sum("n").over(W.partitionBy("queue").orderBy("source", "task")) - F.col("n")).alias("base"))
    placed = encoded.join(C.checked(bases, parts.count()), ["source", "task"]).select("doc_id", "queue", "ids", "n", (F.col("start") + F.col("base")).alias("at"))

    def cut(batches):
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                own, rows, kept = pdf.iloc[i : i + BATCH], [], []
                for doc, queue, packed, total, at in zip(own["doc_id"], own["queue"], own["ids"], own["n"], own["at"]):
                    ids = np.frombuffer(packed, "<u2" if len(packed) == 2 * total else "<u4").astype("<u4")
                    raw = memoryview(ids.tobytes())
                    for window, offset, start, n in schedule.cuts(queue, at, total):
                        rows.append((doc, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, window, offset, queue))
                        if keep_ids:
                            kept.append(ids[start : start + n])
                out = pd.DataFrame({x.split()[0]: np.array(c, np.int64) for x, c in zip(_PIECES.split(", "), zip(*rows))}).astype({"queue": np.int32})
                yield out.assign(ids=kept) if keep_ids else out

    return C.shown(placed.mapInPandas(cut, _PIECES + ", ids array<long>" * keep_ids))
