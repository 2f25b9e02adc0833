"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.catalog import Graph, query
from skein.streaming import operators as S


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", arg_max(event_type, ts) AS kind, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def debounce(spark, d):
    return S.debounce(Graph(spark, d).table("events"), "user_id", "event_type", "30 minutes")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def late_drop(spark, d):
    return S.since(Graph(spark, d).table("events"), "2024-01-15 00:00:00").select("event_id", "user_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def tombstone_apply(spark, d):
    g = Graph(spark, d)
    gone = g.table("events").where("event_type = 'error'").select(F.col("user_id").alias("vec_id"))
    return S.apply_tombstones(g.table("embeddings").select("vec_id", "label"), gone, "vec_id")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type")
def overlay_latest(spark, d):
    return S.overlay(Graph(spark, d).table("events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts")


@query(
    """WITH c AS (SELECT 'f' || (user_id % 40) AS path, event_id AS seq, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'replace' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'ratify' ELSE 'upsert' END AS op, user_id AS src, event_id FROM events),
    r AS (SELECT path, seq, op, src, CAST(event_id % 3 AS INT) AS line, 0 AS col, 'a' AS name, CASE WHEN event_id % 7 <> 0 THEN src + event_id % 2 END AS dst FROM c UNION ALL SELECT path, seq, op, src, CAST(event_id % 5 AS INT), 1, 'b', src + 1 FROM c),
    t AS (SELECT DISTINCT r.path, r.seq, r.op, src, line, col, name, dst FROM r),
    b AS (SELECT path, max(seq) AS base, max(seq) FILTER (op = 'ratify') AS done FROM c WHERE op <> 'upsert' GROUP BY path),
    p AS (SELECT c.path, max(seq) AS before FROM c JOIN b USING (path) WHERE op <> 'upsert' AND seq < done GROUP BY c.path),
    k AS (SELECT t.*, base, done, coalesce(before, -1) AS before FROM t LEFT JOIN b USING (path) LEFT JOIN p USING (path)),
    live AS (SELECT path, src, line, col, name, last(dst ORDER BY seq) AS dst FROM k WHERE op <> 'ratify' AND seq >= coalesce(base, -1) GROUP BY ALL),
    claim AS (SELECT path, src, line, col, name, last(dst ORDER BY seq) AS dst FROM k WHERE op <> 'ratify' AND seq >= before AND seq < done GROUP BY ALL)
    SELECT path, src, line, col, name, dst, CASE WHEN dst IS NULL THEN 'pending' ELSE 'resolved' END AS state, false AS relabelled FROM live
    UNION ALL SELECT k.path, k.src, k.line, k.col, k.name, k.dst, 'committed', coalesce(claim.dst = k.dst, false) FROM k LEFT JOIN claim ON k.path = claim.path AND k.src = claim.src AND k.line = claim.line AND k.col = claim.col AND k.name = claim.name WHERE op = 'ratify' AND seq = done AND k.dst IS NOT NULL"""
)
def overlay_by_file(spark, d):
    op = "CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'replace' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'ratify' ELSE 'upsert' END"
    rows = """array(named_struct('src', user_id, 'line', CAST(event_id % 3 AS INT), 'col', 0, 'name', 'a', 'dst', CASE WHEN event_id % 7 <> 0 THEN user_id + event_id % 2 END),
                    named_struct('src', user_id, 'line', CAST(event_id % 5 AS INT), 'col', 1, 'name', 'b', 'dst', user_id + 1))"""
    e = Graph(spark, d).table("events")
    return S.overlay_files(e.select(F.expr("'f' || (user_id % 40)").alias("path"), F.col("event_id").alias("seq"), F.expr(op).alias("op"), F.expr(rows).alias("rows")))


@query(
    """WITH r AS (SELECT event_id, user_id, ts, length(props) AS bytes, row_number() OVER w AS position, sum(length(props)) OVER (w ROWS UNBOUNDED PRECEDING) AS held, max(ts) OVER (PARTITION BY user_id) AS newest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
    SELECT event_id, user_id, CAST(position AS INT) AS position, CAST(held AS BIGINT) AS held FROM r WHERE position <= 10 AND held <= 70 AND ts >= newest - INTERVAL 86400 SECOND"""
)
def ring_replay(spark, d):
    e = Graph(spark, d).table("events").withColumn("bytes", F.length("props"))
    return S.ring(e, "user_id", 10, 86_400, 70, "bytes").select("event_id", "user_id", "position", "held")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 86400 SECOND THEN 0 ELSE 1 END AS fresh FROM events)
    SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g"""
)
def session_expiry(spark, d):
    return S.sessions(Graph(spark, d).table("events"), "user_id", 86_400)


@query("SELECT event_id, user_id, sum(CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) >= 3 AS open FROM events")
def breaker_state(spark, d):
    return S.breaker(Graph(spark, d).table("events").withColumn("failed", F.col("event_type").isin("error", "view")), "user_id", "failed")


@query(
    """WITH r AS (SELECT event_type, date_trunc('day', ts) AS bucket, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events)
    SELECT event_type, CAST(bucket AS TIMESTAMP) AS bucket, count(*) FILTER (n <= 40) AS kept, count(*) FILTER (n > 40) AS dropped FROM r GROUP BY ALL"""
)
def load_shedding(spark, d):
    return S.shed(Graph(spark, d).table("events"), "event_type", 40, "day")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'body' ELSE 'interface' END AS edit FROM events")
def edit_class(spark, d):
    return Graph(spark, d).table("events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "body").otherwise("interface").alias("edit"))


@query(
    """WITH o AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL), n AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) SELECT n.* FROM n LEFT JOIN o USING (user_id, event_type)"""
)
def incremental_equals_full(spark, d):
    """The even events' state with the odd events' merged in: what the whole table gives."""
    e = Graph(spark, d).table("events").select("user_id", "event_type", "event_id")
    old = S.overlay(e.where("event_id % 2 = 0"), ["user_id", "event_type"], "event_id")
    return S.overlay(old.unionByName(e.where("event_id % 2 = 1")), ["user_id", "event_type"], "event_id")


@query()
def scheduler_claims(spark, d):
    e = Graph(spark, d).table("events")
    what = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "view", "tick").otherwise("mark")
    return S.schedule(e.select(F.col("user_id").cast("string").alias("job"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), what.alias("what")))
