"""Streams give what their batch twins give."""

from datetime import datetime, timedelta

from skein.streaming import operators as S

T0 = datetime(2024, 1, 1)


def test_debounce_as_a_stream(spark, tmp_path):
    rows = [(1, "upsert", T0), (1, "remove", T0 + timedelta(seconds=5)), (1, "upsert", T0 + timedelta(minutes=2)), (2, "upsert", T0), (9, "upsert", T0 + timedelta(hours=2))]
    df = spark.createDataFrame(rows, "path long, kind string, ts timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.debounce(stream, "path", "kind", "30 seconds", late="1 minute").writeStream.format("memory").queryName("debounced").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("debounced").select("path", "start", "kind", "n").collect()}
    want = {tuple(r) for r in S.debounce(df, "path", "kind", "30 seconds").where("path <> 9").select("path", "start", "kind", "n").collect()}
    assert got == want and (1, T0, "remove", 2) in got


def test_tombstones_twice_are_once(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "id long")
    gone = spark.createDataFrame([(3,), (3,), (5,)], "id long")
    once = S.apply_tombstones(rows, gone, "id")
    assert sorted(r[0] for r in S.apply_tombstones(once, gone, "id").collect()) == [0, 1, 2, 4, 6, 7, 8, 9]


def test_consume_tombstones(spark, tmp_path):
    state = {"rows": spark.createDataFrame([(i,) for i in range(5)], "id long")}
    spark.createDataFrame([(2,), (4,)], "id long").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "t"))

    def write(df, batch_id):
        left = [tuple(r) for r in df.collect()]
        state["rows"] = spark.createDataFrame(left, "id long")

    S.consume_tombstones(stream, lambda: state["rows"], write, "id", str(tmp_path / "c")).awaitTermination()
    assert sorted(r[0] for r in state["rows"].collect()) == [0, 1, 3]


EVENTS = [("a", 0.0, "mark"), ("a", 10.0, "tick"), ("a", 31.0, "tick"), ("a", 32.0, "failed"), ("a", 33.0, "mark"), ("a", 70.0, "tick"), ("a", 95.0, "tick"), ("b", 0.0, "mark"), ("b", 29.0, "mark"), ("b", 58.0, "mark"), ("b", 90.0, "tick")]


def test_scheduler(spark):
    got = sorted((r["job"], r["at"]) for r in S.schedule(spark.createDataFrame(EVENTS, "job string, at double, what string")).collect())
    # a: quiet after 30 s; the failure at 32 holds it back until 92. b: marks put it off.
    assert got == [("a", 31.0), ("a", 95.0), ("b", 90.0)]


def test_scheduler_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "job string, at double, what string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    q = S.schedule_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("claims").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["job"], r["at"]) for r in spark.table("claims").collect()) == [("a", 31.0), ("a", 95.0), ("b", 90.0)]


def test_max_defer():
    s = S.Scheduler()
    now = 0.0
    while now < S.MAX_DEFER:
        s.mark(now)
        assert not s.claim(now)
        now += 20
    s.mark(now)
    assert s.claim(now)


def test_three_failures_stop():
    s = S.Scheduler()
    for k in range(3):
        s.mark(10_000.0 * k)
        assert s.claim(10_000.0 * k + 30)
        s.done(10_000.0 * k + 31, False)
    s.mark(99_999.0)
    assert not s.claim(999_999.0)
