"""Operators on graphs whose answers are known, and properties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import identifiers as I
from skein.operators import filters, ingest, merge, ranking, traverse
from skein.plans import retrieval


def edges(spark, pairs, kind="ref/call"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src long, dst long, kind string")


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


@pytest.mark.parametrize(
    "word, want",
    [
        ("dispatch_tool_call", ["dispatch", "tool", "call"]),
        ("getCallersGlobal", ["get", "callers", "global"]),
        ("SqliteStore", ["sqlite", "store"]),
        ("utf8Decode", ["utf", "8", "decode"]),
        ("parse2Url", ["parse", "2", "url"]),
        ("fn:SqliteStore.exec_ddl", ["fn", "sqlite", "store", "exec", "ddl"]),
        ("HTTPServer", ["httpserver"]),
        ("naïve", ["na", "ve"]),
    ],
)
def test_segments(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(I.segments(F.col("w"))).first()[0] == want


def test_contains_token(spark):
    df = spark.createDataFrame([("SqliteStore",), ("sqlitestores",), ("path_to_path_map",)], "w string")
    assert [r[0] for r in df.select(I.contains_token("sqlitestore", F.col("w"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(I.contains_token("pathmap", F.col("w"))).collect()] == [False, False, True]


@pytest.mark.parametrize("pairs, want", [([(1, 2), (2, 3)], {1: 1, 2: 1, 3: 1}), ([(1, 2), (2, 3), (3, 1)], {1: 2, 2: 2, 3: 2}), ([(0, i) for i in range(1, 6)], {i: 1 for i in range(6)}), (list(itertools.combinations(range(4), 2)) + [(1, 0), (2, 2)], {i: 3 for i in range(4)})])
def test_core_numbers(spark, pairs, want):
    assert {r["id"]: r["shell"] for r in traverse.core_numbers(edges(spark, pairs)).collect()} == want


def test_bfs_and_denied_middle(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (1, 5)])
    assert {r["id"]: r["depth"] for r in traverse.bfs(e, ids(spark, [1]), 2).collect()} == {1: 0, 2: 1, 5: 1, 3: 2}
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "a")], "id long, corpus string")
    seen = filters.visible_edges(e, nodes, ["a"])
    assert {r["id"] for r in traverse.bfs(seen, ids(spark, [1]), 5).collect()} == {1, 5}


def test_pagerank_of_a_fan(spark):
    e = edges(spark, [(0, i) for i in range(1, 100)]).withColumn("weight", F.lit(0.7))
    r = traverse.personalised_pagerank(e, ids(spark, [0]).withColumn("weight", F.lit(1.0))).orderBy(F.desc("score"), "id").collect()
    assert r[0]["id"] == 0 and len(r) == 100
    assert abs(r[0]["score"] - 0.15) < 1e-9 and abs(r[1]["score"] - 0.15 * 0.85 / 99) < 1e-9


def test_execution_path(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.5), (3, 4, 1.5), (1, 9, 2.9), (5, 6, 1.0)], "src long, dst long, cost double")
    got = {r["id"]: r["on_route"] for r in traverse.execution_path(e, ids(spark, [1]), ids(spark, [4])).collect()}
    assert got == {1: True, 2: True, 4: True, 3: False, 9: False}
    assert traverse.execution_path(e, ids(spark, [1]), ids(spark, [6])).count() == 0


def test_knapsack_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        n, budget = rng.randint(0, 9), rng.randint(0, 30)
        costs, scores = [rng.randint(1, 12) for _ in range(n)], [rng.random() for _ in range(n)]
        got = ranking.choose(costs, scores, budget)
        value = lambda at: sum(max(1, round(scores[i] * 1e6)) for i in at)
        best = max((value(c) for k in range(n + 1) for c in itertools.combinations(range(n), k) if sum(costs[i] for i in c) <= budget), default=0)
        assert sum(costs[i] for i in got) <= budget and value(got) == best
    assert ranking.choose([1], [1.0], 40_000) == []


def test_provenance_order_does_not_matter(spark):
    rows = [(1, 2, "ref/call", p, i) for i, p in enumerate(["tree-sitter", "live", "scip", "live"])]
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(order, "src long, dst long, kind string, provenance string, n long")
        assert [r["provenance"] for r in merge.provenance_upsert(df).collect()] == ["scip"]
        break_after = order == tuple(rows)
        if not break_after:
            break


def test_guard_stops_a_mass_delete(spark):
    indexed = spark.createDataFrame([(f"f{i}",) for i in range(300)], "path string")
    assert merge.guarded_delete(indexed, indexed.limit(0)).count() == 0
    assert merge.guarded_delete(indexed, indexed.where("path <> 'f7'")).collect()[0]["path"] == "f7"


def test_python_symbols(spark):
    src = "import os\nclass A(B):\n    def f(self):\n        return 1\n\nasync def g():\n    pass\n"
    df = spark.createDataFrame([("a.py", src), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    got = {(r["path"], r["signature"], r["kind"]) for r in ingest.extract_python(df).collect()}
    assert got == {("a.py", "file:a.py", "file"), ("a.py", "import:os", "import"), ("a.py", "class:A", "class"), ("a.py", "method:A.f", "method"), ("a.py", "fn:g", "function"), ("b.py", "file:b.py", "file"), ("c.py", "file:c.py", "file")}


def test_context_abstains(spark):
    nodes = spark.createDataFrame([(1, "x", "a.ts", "ts", "fn:charge", "function", "p", 1, 2, 0)], "id long, corpus string, path string, language string, signature string, kind string, package string, line int, end_line int, test_role int")
    e = edges(spark, [(1, 1)])
    assert retrieval.context(nodes, e, "what is the zebra", 500).count() == 0
    assert [r["id"] for r in retrieval.context(nodes, e, "how does charge work", 500).collect()] == [1]


def test_unknown_provenance_is_refused(spark):
    with pytest.raises(ValueError):
        filters.by_provenance(edges(spark, []), "guess")


def test_plans_prune_and_push_down(spark, capsys):
    from skein.catalog import Graph

    li = Graph(spark, "/root/testdata/sf0.001").table("lineitem").where("l_orderkey = 5").select("l_partkey")
    li.explain("formatted")
    out = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,5)]" in out and "l_quantity" not in out.split("ReadSchema")[1].split("\n")[0]
