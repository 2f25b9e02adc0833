"""Exact deduplication with counting quotient filters.

Each input partition builds one filter for each range of the 64-bit fingerprint space. A fingerprint's quotient names its
home slot; its remainder lies there or as near behind as the filter's order allows, with three bits a slot that tell which homes
are occupied, which remainders continue a run and which are shifted; a repeated remainder is followed by a slot that holds its
count. Filters of a range merge losslessly: each is already sorted, and the merge runs through their sorted remainders, whatever
number of quotient bits each one's size gave it. Only the fingerprints with a count above one, and no others, go to byte
verification: their texts are compared as bytes.

Null text is empty text. Rows with the same text and the same id are one row for the keep rule; all such rows are
kept or none. A null id is kept only where no row of the text has an id. A very long text is hashed as a whole and shuffled only if its
fingerprint repeats. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common as C

#: Fingerprints in a range's filter, about.
FILTER_SIZE = 1 << 19
#: Fingerprints that a task gathers before it emits its filters.
FLUSH = 1 << 21
#: Share of a filter's slots that may be full.
LOAD = 0.75


_OCCUPIED, _CONTINUES, _SHIFTED, _COUNTS = 1, 2, 4, 8


class CountingQuotientFilter:
    """A table of 2^q homes and as many slots as its fingerprints need behind the last one. slots: remainders and counts; state: each slot's bits."""

    def __init__(self, q: int, slots: np.ndarray, state: np.ndarray):
        self.q, self.slots, self.state = q, slots, state

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        keys = np.sort(fingerprints)
        starts = C.runs(keys)
        return cls._placed(keys[starts], np.diff(np.append(starts, len(keys))))

    @classmethod
    def _placed(cls, keys: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """The filter of sorted distinct fingerprints and their counts."""
        need = 1 + (counts > 1)
        q = max(1, int(np.ceil(np.log2(max(1, need.sum()) / LOAD))))
        home = (keys >> np.uint64(64 - q)).astype(np.int64)
        # Linear probing of sorted homes: an entry starts at its home or behind the last one.
        before = np.cumsum(need) - need
        at = np.maximum.accumulate(home - before) + before if len(keys) else home
        size = max(1 << q, int(at[-1] + need[-1])) if len(keys) else 1 << q
        slots, state = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        slots[at] = keys & np.uint64((1 << (64 - q)) - 1)
        again = np.append(False, home[1:] == home[:-1])
        state[at] |= np.where(again, _CONTINUES, 0).astype(np.uint8) | np.where(at != home, _SHIFTED, 0).astype(np.uint8)
        many = counts > 1
        slots[at[many] + 1] = counts[many]
        state[at[many] + 1] |= _COUNTS
        state[home] |= _OCCUPIED
        # An empty slot has no bit of its own but occupied; the first of a run at home has none either and is told by its home's bit.
        return cls(q, slots, state)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted fingerprints, counts), read from the slots."""
        homes = np.flatnonzero(self.state & _OCCUPIED)
        counted = self.state & _COUNTS > 0
        # Runs come in the order of their homes: a run starts in a shifted slot that continues none, or in an occupied one that is not shifted.
        starts = ~counted & (self.state & _CONTINUES == 0) & ((self.state & _SHIFTED > 0) | (self.state & _OCCUPIED > 0))
        full = np.flatnonzero(starts | (~counted & (self.state & _CONTINUES > 0)))
        quotient = homes[np.cumsum(starts[full]) - 1] if len(full) else homes
        counts = np.ones(len(full), np.int64)
        behind = np.minimum(full + 1, len(self.state) - 1)
        has = counted[behind] & (behind > full)
        counts[has] = self.slots[behind[has]]
        return (quotient.astype(np.uint64) << np.uint64(64 - self.q)) | self.slots[full], counts

    def to_bytes(self) -> tuple[int, bytes, bytes]:
        return self.q, C.squeeze(self.slots), C.squeeze(self.state)

    @classmethod
    def from_bytes(cls, q: int, slots: bytes, state: bytes) -> CountingQuotientFilter:
        return cls(q, C.unsqueeze(slots, np.uint64), C.unsqueeze(state, np.uint8))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: the filters' sorted entries interleave, equal ones add their counts."""
        read = [f.entries() for f in filters]
        keys, counts = (np.concatenate(x) for x in zip(*read))
        order = np.argsort(keys, kind="stable")  # merges the sorted runs that it finds
        keys = keys[order]
        starts = C.runs(keys)
        return cls._placed(keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts)


_FILTERS = "part int, q int, slots binary, state binary"


def repeated_fingerprints(fingerprints: DataFrame, column: str, rows: int) -> DataFrame:
    """(fp long, n long) of the fingerprints that occur more than once."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / FILTER_SIZE)))

    def build(batches):
        def flush(held):
            fps = np.concatenate(held)
            parts = (fps >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fps), np.int64)
            order = np.argsort(parts, kind="stable")
            fps, parts = fps[order], parts[order]
            out = []
            for own in np.split(fps, C.runs(parts)[1:]):
                part = int(own[0] >> np.uint64(64 - bits)) if bits else 0
                out.append((part, *CountingQuotientFilter.of(own << np.uint64(bits)).to_bytes()))
            return pd.DataFrame(out, columns=["part", "q", "slots", "state"])

        held, n = [], 0
        for pdf in batches:
            a = pdf[column].to_numpy(np.int64).view(np.uint64)
            if len(a):
                held.append(a)
                n += len(a)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def merge(pdf):
        part = np.uint64(pdf["part"].iloc[0])
        f = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(*x) for x in zip(pdf["q"], pdf["slots"], pdf["state"])])
        fps, counts = f.entries()
        fps = fps >> np.uint64(bits)
        if bits:
            fps |= part << np.uint64(64 - bits)
        many = counts > 1
        return pd.DataFrame({"fp": fps[many].view(np.int64), "n": counts[many]})

    return fingerprints.select(column).mapInPandas(build, _FILTERS).groupBy("part").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays."""
    C.prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    light = C.written(whole.select("doc_id", "fp", F.sha2(F.col("text"), 256).alias("text_sha256")))
    repeated = C.written(repeated_fingerprints(light, "fp", light.count()))
    # Byte verification: grouping by the text compares bytes; a hot text is one row per task before the shuffle.
    # The bitmap thins the rows before they move; the semi-join leaves the repeated fingerprints' alone.
    groups = (
        C.thinned(whole, "fp", C.bitmap(repeated, "fp"))
        .join(C.checked(repeated.select("fp")), "fp", "left_semi")
        .groupBy("fp", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2(F.col("text"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = C.written(groups)
    joined = light.join(C.checked(groups), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
