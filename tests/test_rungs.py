"""Unification by rungs, maps within a budget and overlays by file, against plain versions and known answers."""

import heapq
import random
from collections import Counter, defaultdict

import pytest

from skein.operators import joins, merge, overview
from skein.streaming import operators as S

NODES = "id long, path string, language string, signature string, kind string, line int, end_line int"
FOREIGN = "sym_id long, symbol string, container string, name string, kind string, language string, path string, line int"


def rungs(spark, foreign, nodes):
    out = joins.unify_rungs(spark.createDataFrame(foreign, FOREIGN), spark.createDataFrame(nodes, NODES))
    return out, {r.sym_id: (r.node_id, r.rung) for r in out.collect()}


def test_each_rung(spark):
    nodes = [
        (1, "a.h", "c", "method:W.draw", "method", 10, 12),
        (2, "a.cs", "csharp", "method:C.n", "method", 5, 6),
        (3, "a.cs", "csharp", "method:C.n", "method", 30, 31),
        (4, "b.rs", "rust", "fn:go", "function", 1, 9),
        (5, "b.rs", "rust", "fn:go", "function", 3, 4),
        (6, "x.rb", "ruby", "fn:help", "function", 2, 3),
        (7, "m.go", "go", "fn:main", "function", 1, 2),
        (8, "n.go", "go", "fn:main", "function", 1, 2),
        (9, "v.c", "c", "var:count", "variable", 1, 1),
        (10, "v.cpp", "cpp", "file", "file", None, None),
    ]
    foreign = [
        (1, "W#draw", "W", "draw", "function", "cpp", "v.cpp", 99),  # declared in a header of the family
        (2, "C#n(+1)", "C", "n", "function", "csharp", "a.cs", 80),  # two overloads are one candidate
        (3, "go", None, "go", "function", "rust", "b.rs", 3),  # the narrower span
        (4, "go2", None, "go", "function", "rust", "b.rs", 14),  # beyond the window, but the one group of its language
        (5, "blk", None, "<it works>", "function", "ruby", "x.rb", 2),
        (6, "help", "<describe 'x'>", "help", "function", "ruby", "x.rb", 2),
        (7, "help2", "<describe 'x'>", "other", "function", "ruby", "x.rb", 2),
        (8, "main", None, "main", "function", "go", "v.cpp", 50),  # two groups remain
        (9, "count", None, "count", "variable", "c", "a.h", 50),  # variables never meet across files
        (10, "go", None, "renamed", "function", "rust", "a.h", 50),  # twin of 3
        (11, "gem", None, "gem", "function", "ruby", "vendor/g.rb", 1),
        (12, "late", None, "go", "function", "rust", "b.rs", None),
        (13, "<=>", None, "<=>", "function", "ruby", "x.rb", 9),  # an operator is no block
        (14, "C#n(+1)", "C", "n", "function", "csharp", "a.h", 80),  # twin of an overload
    ]
    out, got = rungs(spark, foreign, nodes)
    assert got == {
        1: (1, "family"), 2: (2, "overload"), 3: (5, "span"), 4: (4, "family"), 5: (None, "dropped"), 6: (6, "span"), 7: (None, "dropped"), 8: (None, "ambiguous"),
        9: (None, "missed"), 10: (5, "twin"), 11: (None, "unindexed"), 12: (None, "unplaced"), 13: (None, "missed"), 14: (2, "twin"),
    }
    assert {tuple(r) for r in joins.unify_misses(out).collect()} == {("go", "main", "v.cpp", 50, "function", 2), ("ruby", "<=>", "x.rb", 9, "function", 0)}


def test_rungs_of_nothing_and_of_nulls(spark):
    assert rungs(spark, [], [])[1] == {}
    nulls = [(1, None, None, None, None, None, None, None), (2, "s", None, None, "function", "go", "m.go", 1)]
    assert rungs(spark, nulls, [(7, "m.go", "go", None, "function", 1, 2), (8, None, None, "fn:x", None, None, None)])[1] == {1: (None, "unindexed"), 2: (None, "missed")}


def greedy(paths, budget):
    """Splits the heaviest folder while rows fit: {(tile, whole): (files, symbols)}, path -> tile."""
    parts = {p: p.split("/") for p in paths}
    inside = lambda d: [p for p in paths if parts[p][:-1][: len(d)] == list(d)]
    weight = lambda d: sum(paths[p] for p in inside(d))
    tiles, heap = {(): True}, []

    def push(d):
        if any(len(parts[p]) > len(d) + 1 for p in inside(d)):
            heapq.heappush(heap, (-weight(d), len(d), "/".join(d), d))

    push(())
    while heap:
        d = heapq.heappop(heap)[3]
        below = {tuple(parts[p][: len(d) + 1]) for p in inside(d) if len(parts[p]) > len(d) + 1}
        own = any(len(parts[p]) == len(d) + 1 for p in inside(d))
        if len(tiles) - 1 + len(below) + own > budget:
            break
        del tiles[d]
        tiles |= {b: True for b in below} | ({(*d, "*"): False} if own else {})
        for b in below:
            push(b)
    at = {}
    for p in paths:
        for t, whole in tiles.items():
            if parts[p][:-1][: len(t)] == list(t) if whole else (*parts[p][:-1], "*") == t:
                at[p] = ("/".join(t), whole)
    return at


@pytest.mark.parametrize("budget", [1, 3, 6, 12, 500])
def test_repo_map_is_the_greedy_split(spark, budget):
    r = random.Random(budget)
    nodes = [(i, "/".join([*(r.choice("abc") for _ in range(r.randrange(4))), f"f{r.randrange(9)}"]) if i else None) for i in range(150)]
    edges = [(r.randrange(150), r.randrange(155)) for _ in range(300)]
    got = overview.repo_map(spark.createDataFrame(nodes, "id long, path string"), spark.createDataFrame(edges, "src long, dst long"), budget).collect()
    path = {i: p or "" for i, p in nodes}
    at = greedy(Counter(path.values()), budget)
    assert len(got) <= budget and sum(x.symbols for x in got) == 150 and sum(x.files for x in got) == len(set(path.values()))
    users = defaultdict(set)
    for s, t in edges:
        if t in path and at[path[s]] != at[path[t]]:
            users[at[path[t]]].add(path[s])
    want = {(*t, sum(at[p] == t for p in set(path.values())), sum(at[p] == t for p in path.values()), len(users[t])) for t in at.values()}
    assert {(x.tile, x.whole, x.files, x.symbols, x.dependents) for x in got} == want
    assert [x.dependents for x in sorted(got, key=lambda x: x.rank)] == sorted((x.dependents for x in got), reverse=True)


def test_repo_map_of_nothing(spark):
    none = overview.repo_map(spark.createDataFrame([], "id long, path string"), spark.createDataFrame([], "src long, dst long"), 5)
    assert none.collect() == []
    with pytest.raises(ValueError):
        overview.repo_map(none, none, 0)


def test_dirty_files(spark):
    ids = lambda rows: spark.createDataFrame(rows, "id long, path string")
    nodes = ids([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)])
    edges = spark.createDataFrame([(3, 1), (3, 2), (4, 2), (2, 1), (4, 1), (4, 1), (5, 1)], "src long, dst long")
    got = merge.dirty_files(ids([(1, "a"), (2, "a")]), ids([(2, "a")]), nodes, edges).collect()
    assert {tuple(r) for r in got} == {("b", 1, 1), ("c", 1, 2), (None, 1, 1)}


CHANGES = f"path string, seq long, op string, rows {S.REFERENCES}"
VIEW = ["path", "src", "line", "col", "name", "dst", "state", "relabelled"]


def made(seed, n):
    r = random.Random(seed)
    ref = lambda: (r.randrange(3), r.choice([1, 2, None]), 0, r.choice("xy"), r.choice([None, 7, 8]))
    ops = ["replace", "upsert", "upsert", "ratify", "other"]
    return [(r.choice("pq"), i, r.choice(ops), r.choice([None, [], [ref()], [ref() for _ in range(4)], [ref() for _ in range(6)]])) for i in range(n)]


def plain(changes):
    """The overlay by one change after another."""
    state = {}
    for path, _, op, rows in sorted(changes, key=lambda c: c[1]):
        live, done = state.get(path, ({}, {}))
        new = {}
        for *k, dst in rows or []:
            new[tuple(k)] = max((d for d in (new.get(tuple(k)), dst) if d is not None), default=None)
        if op == "replace":
            live = new
        elif op == "upsert":
            live = live | new
        elif op == "ratify":
            live, done = {}, {k: (d, live.get(k) == d) for k, d in new.items() if d is not None}
        state[path] = live, done
    out = [(p, *k, d, "pending" if d is None else "resolved", False) for p, (live, _) in state.items() for k, d in live.items()]
    return Counter(out + [(p, *k, d, "committed", again) for p, (_, done) in state.items() for k, (d, again) in done.items()])


def test_overlay_by_file(spark):
    for seed in range(6):
        changes = made(seed, 3 + 4 * seed)
        got = S.overlay_files(spark.createDataFrame(changes, CHANGES)).select(*VIEW).collect()
        assert Counter(map(tuple, got)) == plain(changes), seed
    assert S.overlay_files(spark.createDataFrame([], CHANGES)).collect() == []


def test_overlay_as_a_stream_with_replays(spark, tmp_path):
    changes = made(11, 24)
    batches = [changes[:9], changes[4:9] + changes[9:15], changes[:3], changes[15:], changes[20:]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, b in enumerate(batches):
        spark.createDataFrame(b, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            q = S.overlay_stream(stream).writeStream.format("memory").queryName("overlaid").outputMode("update").start()
        q.processAllAvailable()
    q.stop()
    told = spark.table("overlaid").collect()
    feed = spark.createDataFrame(told + told, spark.table("overlaid").schema)
    got = Counter(map(tuple, S.overlay_current(feed).select(*VIEW).collect()))
    assert got == plain(changes) == Counter(map(tuple, S.overlay_files(spark.createDataFrame(changes, CHANGES)).select(*VIEW).collect()))
