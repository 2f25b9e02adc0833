"""Steps whose rows or memory grew faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import joins


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edit_overlap_meets_copies_once(spark):
    draw = random.Random(3)
    spans = [(i, draw.choice("pq"), a := draw.randrange(1, 150), a + draw.randrange(12)) for i in range(60)]
    spans += [(100 + i, p, a, b) for i, (_, p, a, b) in enumerate(spans[:30])]  # copies
    hunks = [(i, draw.choice("pq"), a := draw.randrange(1, 150), a + 6) for i in range(40)]
    hunks += [(100 + i, p, a, b) for i, (_, p, a, b) in enumerate(hunks)] + [(999, None, 1, 2)]
    got = joins.edit_overlap(spark.createDataFrame(hunks, "hunk_id long, path string, hunk_start long, hunk_end long"), spark.createDataFrame(spans + [(998, "p", None, None)], "id long, path string, line int, end_line int"))
    want = []
    for h, p, a, b in hunks:
        hit = [(i, x, y) for i, q, x, y in spans if p == q and x <= b and y >= a]
        want += [(h, i) for i, x, y in hit if not any(j != i and u >= x and v <= y and v - u < y - x for j, u, v in hit)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert not [line for line in plan(got).split("\n") if "Join" in line and "hunk_id" in line]  # spans are not paired hunk by hunk


def test_a_task_reads_a_bounded_share_of_a_shuffle(spark, tmp_path):
    from skein.catalog import Graph

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(key)
    try:
        for given, want in (("64MB", 4 << 20), ("67108864b", 4 << 20), ("1m", 1 << 20)):
            spark.conf.set(key, given)
            Graph(spark, str(tmp_path))
            assert spark._jsparkSession.sessionState().conf().getConfString(key) in (f"{want}b", given) and (given == "1m" or spark.conf.get(key) == f"{want}b")
    finally:
        spark.conf.set(key, was)


def test_a_task_reads_a_bounded_share_of_a_file(spark, tmp_path):
    from skein.catalog import Graph

    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        for given, want in (("128MB", 8 << 20), ("134217728b", 8 << 20), ("2m", 2 << 20)):
            spark.conf.set(key, given)
            Graph(spark, str(tmp_path))
            assert spark.conf.get(key) == (given if given == "2m" else f"{want}b")
    finally:
        spark.conf.set(key, was)


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import math

    from skein.plans import retrieval

    monkeypatch.setattr(retrieval, "VECTORS", 50)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    draw = random.Random(5)
    own = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(100)]
    rows = [(i, own[i % 100] if i % 3 else own[7]) for i in range(240)] + [(300, [0.0] * 8), (301, [1.0, 2.0]), (302, None), (303, [2 * x for x in own[7]])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 20 = 0 OR vec_id > 299")
    plain = v.crossJoin(q.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))).where("vec_id <> q").select("q", "vec_id", retrieval.I.cosine(F.col("embedding"), F.col("v")).alias("sim")).collect()
    want = set()
    for name in {r["q"] for r in plain}:
        best = sorted((r for r in plain if r["q"] == name), key=lambda r: (-math.inf if r["sim"] is None else r["sim"], -r["vec_id"]), reverse=True)[:10]
        want |= {(name, r["vec_id"], i) for i, r in enumerate(best, 1)}
    got = retrieval.nearest_vectors(v, q, 10)
    assert {(r["q"], r["vec_id"], r["rank"]) for r in got.collect()} == want
    assert "FlatMapCoGroupsInPandas" in plan(got)  # queries and vectors don't meet pair by pair


def test_seeds_beside_hubs_make_no_second_hop(spark, monkeypatch):
    from skein.operators import cascade

    sizes = []
    monkeypatch.setattr(cascade, "written", lambda df, keep=cascade.written: sizes.append((df.columns, (out := keep(df)).count())) or out)
    nodes = spark.createDataFrame([(i, "c", f"p/{i}.go", "fn:alpha" if i == 0 else f"fn:beta{i}", "function", 1, 2, 0) for i in range(40)], "id long, corpus string, path string, signature string, kind string, line int, end_line int, test_role int")
    edges = spark.createDataFrame([(0, 1)] + [(1, 100 + i) for i in range(3000)], "src long, dst long")
    asked = spark.createDataFrame([(1, "alpha")], "q long, query string")
    cascade.Cascade(asked, nodes).seeds(edges).collect()
    assert max(n for columns, n in sizes) < 1000


def test_ffi_edges_deal_a_common_name_over_tasks(spark):
    calls = spark.range(400).select(F.col("id").alias("src"), F.lit("x").alias("corpus"), F.lit("rust").alias("target_language"), F.lit("Native_Order").alias("name"), F.expr("CASE WHEN id % 4 > 0 THEN id % 3 END").alias("arity"))
    targets = spark.range(1000, 1030).select("id", F.lit("x").alias("corpus"), F.lit("rust").alias("language"), F.lit("nativeorder").alias("name"), (F.col("id") % 3).alias("arity"))
    out = joins.ffi_edges(calls, targets)
    want = []
    for c in range(400):
        for t in range(1000, 1030):
            score = 50 if c % 4 == 0 else 90 if c % 3 == t % 3 else 30
            want += [(c, t, "ffi/call", score)] + ([(t, c, "ref/call", score)] if score == 90 else [])
    assert sorted(map(tuple, out.collect())) == sorted(want)
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 4 and max(shares) < len(want) / 2


def test_lsif_lines_are_taken_apart_once(spark):
    from skein.operators import ingest

    lines = [
        '{"id":1,"type":"vertex","label":"document","path":"a.ts"}', '{"id":2,"type":"vertex","label":"range","line":7}', '{"id":3,"type":"vertex","label":"resultSet","symbol":"f"}',
        '{"type":"edge","label":"contains","outV":1,"inV":2}', '{"type":"edge","label":"item","outV":3,"inV":2}', '{"id":9,"label":"hoverResult"}', "not json",
    ]
    out = ingest.lsif_occurrences(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert list(map(tuple, out.collect())) == [("a.ts", 7, "f")]
    assert "json" not in plan(out)  # the five kinds of lines read a table of parsed ones


def test_inherited_is_nearest_methods_of_all(spark):
    from skein.operators import traverse

    draw = random.Random(9)
    bases = spark.createDataFrame([(draw.randrange(40), draw.randrange(40)) for _ in range(50)] + [(None, 1), (2, None)], "class long, base long")
    methods = spark.createDataFrame([(draw.randrange(40), draw.choice("fgh"), draw.randrange(9)) for _ in range(30)] + [(None, "f", 1), (3, None, 1)], "class long, name string, id long")
    wanted = spark.range(40).select(F.col("id").alias("class")).crossJoin(methods.select("name").distinct())
    want = sorted(map(tuple, traverse.nearest_methods(wanted, bases, methods).collect()))
    assert sorted(map(tuple, traverse.inherited(bases, methods).collect())) == want and want


def test_held_edges_are_sorted_once(spark):
    from skein.operators import traverse

    edges = spark.range(1000).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst"))
    with traverse.by_source(edges) as held:
        held.count()
        step = spark.range(40).select(F.col("id").alias("src")).hint("merge").join(held, "src")
        text = step._jdf.queryExecution().executedPlan().toString()
        own = text[: text.index("InMemoryRelation")]
        assert own.count("Sort [") == 1  # the frontier's


def peeled(pairs):
    """Core numbers by taking away the node of the least degree."""
    near = {}
    for a, b in pairs:
        if None not in (a, b) and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        out[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return out


def test_core_numbers_send_only_what_fell(spark, monkeypatch):
    from skein.operators import traverse

    draw = random.Random(11)
    pairs = [(a, b) for a in range(30) for b in range(a)] + [(i, i + 1) for i in range(29, 39)]  # a clique with a tail, whose bounds fall one by one
    pairs += [(100 + draw.randrange(40), 100 + int(40 * draw.random() ** 2)) for _ in range(150)] + [(5, 5), (7, None), (None, 7), (3, 2), (3, 2)]
    sizes = []
    monkeypatch.setattr(traverse, "written", lambda df, keep=traverse.written: sizes.append((out := keep(df)).count()) or out)
    monkeypatch.setattr(traverse, "CUT", 3, raising=False)
    got = traverse.core_numbers(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r["id"]: r["shell"] for r in got.collect()} == (want := peeled(pairs)) and len(want) == got.count()
    assert got.schema.simpleString() == "struct<id:bigint,shell:bigint>"
    assert max(sizes) <= len(want) and sum(sizes) < 2 * len(pairs)  # neither edges nor all bounds are written in each round


def test_core_numbers_of_no_edges(spark):
    from skein.operators import traverse

    for pairs in ([], [(1, 1), (2, None)]):
        assert traverse.core_numbers(spark.createDataFrame(pairs, "src long, dst long")).collect() == []


@pytest.mark.parametrize("name", ["provenance_upsert", "call_spine", "graph_tree"])
def test_edges_are_read_in_bounded_shares(spark, tmp_path, name):
    import shutil

    import __spark_entry__
    from skein.sources import projection

    for table in set(projection.TABLES) - {"lineitem"}:
        shutil.copy(f"/root/testdata/sf0.001/{table}.parquet", tmp_path)
    lines = spark.range(0, 1_500_000, 1, 1).selectExpr("id % 1500 AS l_orderkey", "CAST(rand(1) * 1e15 AS BIGINT) AS l_partkey", "CAST(rand(2) * 1e15 AS BIGINT) AS l_suppkey", "3 AS l_linenumber")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    given = {"spark.sql.files.maxPartitionBytes": "128MB", "spark.sql.files.minPartitionNum": "1"}
    was = {key: spark.conf.get(key, None) for key in given}
    try:
        for key, value in given.items():
            spark.conf.set(key, value)
        leaves = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size()) if "l_orderkey" in leaves.apply(i).toString()]
        assert size > 2 * (8 << 20) and scans
        assert min(s.inputRDD().getNumPartitions() for s in scans) >= size // (8 << 20)
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
