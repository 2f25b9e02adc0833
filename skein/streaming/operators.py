"""Incremental operators: each is a function that a batch and a stream share, or a pair whose batch twin defines the result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _micros(c) -> F.Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def debounce(events: DataFrame, key: str, kind: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, kind, n): events of a key within the gap of each other are one; the last kind counts. late: a stream's watermark."""
    if late:
        events = events.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return events.groupBy(key, w).agg(F.max_by(kind, "ts").alias("kind"), F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "kind", "n")


def since(events: DataFrame, start: str) -> DataFrame:
    """Replayed events from before the start go."""
    return events.where(F.col("ts") >= F.lit(start).cast("timestamp"))


def apply_tombstones(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tombstone; applying tombstones twice is applying them once."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def consume_tombstones(stream: DataFrame, read, write, key: str, checkpoint: str):
    """A streaming query that applies each batch of tombstones to a table; read() and write(df, batch_id) are the table's, and a batch that comes again changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        write(apply_tombstones(read(), batch, key), batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def overlay(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest state of each key, by one aggregation that combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("m")).select(*keys, f"m.{order}", *[f"m.{c}" for c in rest])


#: A reference's row in a change to a file; dst: what it resolves to, null while that is not known.
REFERENCES = "array<struct<src:long,line:int,col:int,name:string,dst:long>>"
_KEY = ["src", "line", "col", "name"]
_VIEW = "path string, seq long, src long, line int, col int, name string, dst long, state string, relabelled boolean"


def overlay_files(changes: DataFrame) -> DataFrame:
    """What an overlay of references holds after changes (path, seq, op, rows: REFERENCES): (path, src, line, col, name, dst, state, relabelled).

    replace: the file's live references are these and no others. upsert: these are set beside the others. ratify: the file's committed references are these, and
    its live ones go; a committed one that was live with that target is relabelled. Other ops and null rows change nothing but for the ops above.
    state: pending (no dst), resolved or committed (a row without dst is none). seq orders a file's changes and is unique in it; in one change the greatest dst of a reference counts.
    Each file's last replace and ratify, by three aggregates that combine before they shuffle, tell which changes still count; rows meet once, by reference.
    """
    c = changes.where("path IS NOT NULL AND seq IS NOT NULL")
    base = F.col("op").isin("replace", "ratify")
    last = c.where(base).groupBy("path").agg(F.max("seq").alias("_base"), F.max(F.when(F.col("op") == "ratify", F.col("seq"))).alias("_ratified"))
    before = c.where(base).join(last, "path").where("seq < _ratified").groupBy("path").agg(F.max("seq").alias("_before"))
    j = c.where(base | (F.col("op") == "upsert")).join(last.join(before, "path", "left"), "path", "left")
    at_least = lambda b: b.isNull() | (F.col("seq") >= b)
    role = F.when((F.col("op") == "ratify") & (F.col("seq") == F.col("_ratified")), "commit")
    role = role.when((F.col("op") != "ratify") & at_least(F.col("_base")), "live")
    role = role.when((F.col("op") != "ratify") & at_least(F.col("_before")) & (F.col("seq") < F.col("_ratified")), "claim")
    r = j.withColumn("_role", role).where("_role IS NOT NULL").select("path", "_role", "seq", F.inline("rows"))
    of = lambda what: F.max(F.when(F.col("_role") == what, F.struct("seq", "dst")))
    held = r.groupBy("path", *_KEY).agg(of("live").alias("live"), of("commit").alias("commit"), of("claim").alias("claim"))
    live = F.when(F.col("live").isNotNull(), F.struct(F.col("live.dst").alias("dst"), F.when(F.col("live.dst").isNull(), "pending").otherwise("resolved").alias("state"), F.lit(False).alias("relabelled")))
    done = F.when(F.col("commit.dst").isNotNull(), F.struct(F.col("commit.dst").alias("dst"), F.lit("committed").alias("state"), F.coalesce(F.col("claim.dst") == F.col("commit.dst"), F.lit(False)).alias("relabelled")))
    return held.select("path", *_KEY, F.inline(F.array_compact(F.array(live, done))))


def _fold(seq: int, live: dict, done: dict, change) -> tuple[int, dict, dict]:
    """A file's overlay after one more change; a change that came before changes nothing."""
    if change.seq <= seq or change.op not in ("replace", "upsert", "ratify"):
        return seq, live, done
    rows: dict = {}
    for r in [] if change.rows is None else change.rows:
        key = tuple(None if pd.isna(r[k]) else r[k] for k in _KEY)
        dst = None if pd.isna(r["dst"]) else int(r["dst"])
        rows[key] = dst if rows.get(key) is None or dst is not None and dst > rows[key] else rows[key]
    if change.op == "ratify":
        return change.seq, {}, {k: (d, live.get(k) == d) for k, d in rows.items() if d is not None}
    return change.seq, rows if change.op == "replace" else live | rows, done


def overlay_stream(changes: DataFrame) -> DataFrame:
    """overlay_files over a stream, with state by file: on each change all that the file holds then, with its seq (one row of state 'empty' if nothing). See overlay_current.

    A file's changes come in their order; what comes again, or after a later one, changes nothing. The state of a file grows with its references only.
    """
    import json

    def update(key, parts, state):
        seq, live, done = -1, {}, {}
        if state.exists:
            seq, kept = state.get
            live, done = ({tuple(k): (tuple(v) if isinstance(v, list) else v) for k, v in part} for part in json.loads(kept))
        was = seq
        for change in sorted((c for part in parts for c in part.itertuples(index=False)), key=lambda c: c.seq):
            seq, live, done = _fold(seq, live, done, change)
        if seq == was:
            return
        state.update((int(seq), json.dumps([[[[None if x is None else x if isinstance(x, str) else int(x) for x in k], v] for k, v in part.items()] for part in (live, done)])))
        rows = [(key[0], seq, *k, d, "pending" if d is None else "resolved", False) for k, d in live.items()]
        rows += [(key[0], seq, *k, d, "committed", again) for k, (d, again) in done.items()]
        names = [f.split()[0] for f in _VIEW.split(", ")]
        out = pd.DataFrame(rows or [(key[0], seq, None, None, None, None, None, "empty", False)], columns=names)
        yield out.astype({"seq": "int64", "src": "Int64", "line": "Int32", "col": "Int32", "dst": "Int64", "relabelled": "bool"})

    c = changes.where("path IS NOT NULL AND seq IS NOT NULL").select("path", "seq", "op", F.col("rows").cast(REFERENCES).alias("rows"))
    return c.groupBy("path").applyInPandasWithState(update, _VIEW, "seq long, kept string", "update", "NoTimeout")


def overlay_current(feed: DataFrame) -> DataFrame:
    """The overlay that a table of overlay_stream's rows tells: each file's rows of its last change. Rows written twice count once."""
    last = feed.groupBy("path").agg(F.max("seq").alias("seq"))
    return feed.join(last, ["path", "seq"], "left_semi").where("state <> 'empty'").drop("seq").distinct()


def ring(events: DataFrame, group: str, entries: int, seconds: int, size: int, cost: str) -> DataFrame:
    """What a replay buffer still holds: of each group the newest entries within a count, an age and a size; entries over the size alone never enter."""
    w = W.partitionBy(group).orderBy(F.desc("ts"), F.desc("event_id"))
    r = events.where(F.col(cost) <= size).withColumns({"position": F.row_number().over(w), "held": F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0)), "newest": F.max("ts").over(W.partitionBy(group))})
    fresh = _micros("newest") - _micros("ts") <= seconds * 1_000_000
    return r.where((F.col("position") <= entries) & (F.col("held") <= size) & fresh).drop("newest")


def sessions(events: DataFrame, group: str, ttl: int) -> DataFrame:
    """(event_id, session): a session ends when its group is silent for ttl seconds."""
    w = W.partitionBy(group).orderBy("ts", "event_id")
    new = F.when(_micros("ts") - _micros(F.lag("ts").over(w)) <= ttl * 1_000_000, 0).otherwise(1)
    return events.withColumn("_new", new).select("event_id", group, F.sum("_new").over(w).alias("session"))


def breaker(calls: DataFrame, group: str, failed: str, window: int = 5, trips: int = 3) -> DataFrame:
    """(event_id, open): after each call whether so many of the last calls failed."""
    w = W.partitionBy(group).orderBy("ts", "event_id").rowsBetween(1 - window, 0)
    return calls.select("event_id", group, (F.sum(F.col(failed).cast("int")).over(w) >= trips).alias("open"))


def shed(events: DataFrame, group: str, capacity: int, bucket: str) -> DataFrame:
    """(bucket, kept, dropped): events beyond the capacity of a bucket of time are dropped, the newest ones, and counted."""
    w = W.partitionBy(group, "_b").orderBy("ts", "event_id")
    r = events.withColumn("_b", F.date_trunc(bucket, "ts")).withColumn("_n", F.row_number().over(w))
    return r.groupBy(group, F.col("_b").alias("bucket")).agg(F.sum((F.col("_n") <= capacity).cast("long")).alias("kept"), F.sum((F.col("_n") > capacity).cast("long")).alias("dropped"))


DEBOUNCE, MAX_DEFER, FAILURES, BACKOFF, BACKOFF_CAP = 30, 300, 3, 60, 900


class Scheduler:
    """A debounced single-flight job: marks arm it, quiet or a long wait claims it, failures back off and at last stop it."""

    def __init__(self, state: tuple | None = None):
        self.deadline, self.first, self.failures, self.backoff, self.running = state or (-1.0, -1.0, 0, -1.0, False)

    def state(self) -> tuple:
        return self.deadline, self.first, self.failures, self.backoff, self.running

    def mark(self, now: float) -> None:
        self.deadline = now + DEBOUNCE
        if self.first < 0:
            self.first = now

    def claim(self, now: float) -> bool:
        ready = self.first >= 0 and (now >= self.deadline or now - self.first >= MAX_DEFER)
        if self.failures >= FAILURES or now < self.backoff or self.running or not ready:
            return False
        self.deadline = self.first = -1.0
        self.running = True
        return True

    def done(self, now: float, ok: bool) -> None:
        self.running = False
        if ok:
            self.failures, self.backoff = 0, -1.0
        else:
            self.failures += 1
            self.backoff = now + min(BACKOFF_CAP, BACKOFF * 2 ** (self.failures - 1))


_STATE = "deadline double, first double, failures long, backoff double, running boolean"


def _advance(s: Scheduler, rows: pd.DataFrame) -> list[tuple[float, str]]:
    out = []
    for at, what in zip(rows["at"], rows["what"]):
        if what == "mark":
            s.mark(at)
        elif what in ("ok", "failed"):
            s.done(at, what == "ok")
        if s.claim(at):
            out.append((at, "claimed"))
    return out


def schedule(events: DataFrame) -> DataFrame:
    """(job, at, action) from a batch of (job, at seconds, what: mark, tick, ok or failed)."""

    def run(pdf):
        s = Scheduler()
        return pd.DataFrame([(pdf["job"].iloc[0], *x) for x in _advance(s, pdf.sort_values("at", kind="stable"))], columns=["job", "at", "action"]).astype({"at": float})

    return events.groupBy("job").applyInPandas(run, "job string, at double, action string")


def schedule_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: a job's state is kept between batches, and only that."""

    def run(key, frames: Iterator[pd.DataFrame], state):
        s = Scheduler(tuple(state.get) if state.exists else None)
        for pdf in frames:
            out = _advance(s, pdf.sort_values("at", kind="stable"))
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["job", "at", "action"]).astype({"at": float, "job": object, "action": object})
        state.update(s.state())

    return events.groupBy("job").applyInPandasWithState(run, "job string, at double, action string", _STATE, "append", "NoTimeout")
