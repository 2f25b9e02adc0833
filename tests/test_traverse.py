"""Traversals against plain versions, on random graphs with loops, repeated edges, lost ends, nulls and several parts."""

import random
from collections import defaultdict, deque

import pytest

from skein.operators import traverse

NONE = None


def rows():
    rng = random.Random(4)
    out = [(rng.randrange(60), rng.randrange(70), float(rng.randint(1, 9))) for _ in range(150)]
    return out + [(3, 3, 1.0), (5, 6, 2.0), (5, 6, 2.0), (900, 901, 1.0), (1, NONE, 2.0), (NONE, 2, 2.0), (1, 60, NONE), (2, 61, 0.0), (7, 62, float("nan")), (40, 63, -1.0)]


def sound(x):
    return x is not NONE and x == x and x > 0


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(rows(), "src long, dst long, weight double").repartition(3)


def seeds(spark, *ids):
    return spark.createDataFrame([(i, 1.0 + i % 3) for i in ids], "id long, weight double")


def hops(edges, start, depth):
    seen, front = {i: 0 for i in start}, set(start)
    for k in range(1, depth + 1):
        front = {b for a, b in edges if a in front} - seen.keys()
        seen |= {i: k for i in front}
    return seen


@pytest.mark.parametrize("ids", [(1,), (1, 2, 7), (500,), ()])
def test_bfs(spark, graph, ids):
    plain = [(a, b) for a, b, _ in rows() if a is not NONE and b is not NONE]
    for both in (False, True):
        want = hops(plain + [(b, a) for a, b in plain] * both, ids, 3)
        got = traverse.bfs(graph, seeds(spark, *ids).union(spark.createDataFrame([(NONE, 1.0)], "id long, weight double")), 3, both).collect()
        assert {r["id"]: r["depth"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("budget, depth", [(0, 3), (1, 3), (9, 3), (40, 3), (10**6, 3), (10**6, 0), (60, 9)])
def test_walk_within_a_budget(spark, graph, budget, depth):
    costs = {i: 1 + i * 7 % 5 for i in range(70) if i % 6 != 4}
    nodes = spark.createDataFrame(list(costs.items()), "id long, cost long")
    out = defaultdict(set)
    for a, b, _ in rows():
        if a is not NONE and b is not NONE:
            out[a].add(b)
    queue, seen, spent, want = deque([(1, 0)]), {1}, 0, []
    while queue:
        i, d = queue.popleft()
        if i in costs:
            if spent + costs[i] > budget:
                break
            spent += costs[i]
            want.append((i, d, spent))
        if d < depth:
            for j in sorted(out[i] - seen):
                seen.add(j)
                queue.append((j, d + 1))
    got = sorted(traverse.bfs_within(graph, nodes, seeds(spark, 1), depth, budget).collect(), key=lambda r: r["position"])
    assert [(r["id"], r["depth"], r["running"]) for r in got] == want


def ranks(ids, weights, alpha=0.85, rounds=7, depth=6):
    edges = [(a, b, w) for a, b, w in rows() if a is not NONE and b is not NONE and sound(w)]
    held = hops([e[:2] for e in edges], ids, depth - 1)
    out, into = defaultdict(float), defaultdict(float)
    for a, _, w in edges:
        out[a] += w
    total = sum(weights)
    for i, w in zip(ids, weights):
        into[i] += w / total if total else 1 / len(ids)
    rank = dict(into)
    for _ in range(rounds):
        now = defaultdict(float, {i: (1 - alpha) * p for i, p in into.items()})
        for a, b, w in edges:
            if a in held and a in rank:
                now[b] += alpha * rank[a] * w / out[a]
        rank = now
    return rank


@pytest.mark.parametrize("ids", [(1,), (1, 2, 7), (500,), ()])
def test_pagerank(spark, graph, ids):
    got = {r["id"]: r["score"] for r in traverse.personalised_pagerank(graph, seeds(spark, *ids), rounds=7).collect()}
    want = ranks(ids, [1.0 + i % 3 for i in ids])
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_pagerank_of_seeds_without_weight(spark, graph):
    made = lambda *w: spark.createDataFrame([*zip((1, 2, 7), w), (NONE, 3.0)], "id long, weight double")
    for given, counted in (((NONE, 2.0, float("nan")), (0, 2, 0)), ((NONE, 0.0, -1.0), (0, 0, 0))):
        got = {r["id"]: r["score"] for r in traverse.personalised_pagerank(graph, made(*given), rounds=4).collect()}
        want = ranks((1, 2, 7), counted, rounds=4)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def far(edges, start):
    best = {start: 0.0}
    for _ in range(200):
        for a, b, c in edges:
            if a in best and best[a] + c < best.get(b, 1e18):
                best[b] = best[a] + c
    return best


@pytest.mark.parametrize("source, sink", [(7, 40), (1, 500), (3, 3)])
def test_paths(spark, graph, source, sink):
    edges = [(a, b, c) for a, b, c in rows() if a is not NONE and b is not NONE and sound(c)]
    ahead, behind = hops([e[:2] for e in edges], [source], 5), hops([(b, a) for a, b, _ in edges], [sink], 5)
    inner = [(a, b, c) for a, b, c in edges if (a in ahead and b in ahead) or (a in behind and b in behind) or (a in ahead and b in behind)]
    inner = [(a, b, c) for a, b, c in inner if a in ahead or b in behind]
    there, back = far(inner, source), far([(b, a, c) for a, b, c in inner], sink)
    if sink in there:
        best = there[sink]
        route = {i for i in there if i in back and abs(there[i] + back[i] - best) < 1e-9}
        want = {(i, c, i in route) for i, c in there.items() if i in route or c <= 1.5 * best}
    else:
        want = {(i, NONE, False) for i in hops([e[:2] for e in edges], [source], 3)}
    e = graph.withColumnRenamed("weight", "cost")
    got = traverse.connecting_path(e, seeds(spark, source), seeds(spark, sink))
    assert {tuple(r) for r in got.collect()} == want
    few = traverse.connecting_path(e, seeds(spark, source), seeds(spark, sink), most=3).collect()
    assert [tuple(r) for r in few] == sorted(want, key=lambda r: (not r[2], r[1] or 0, r[0]))[:3]


def test_strong_components_and_layers(spark):
    rng = random.Random(9)
    for n, m in ((12, 14), (40, 55)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 100), (101, 102), (102, 103), (103, 101), (103, 104)]
        df = spark.createDataFrame([*edges, (NONE, 1), (2, NONE)], "src long, dst long")
        reach = {i: set(hops(edges, [i], 999)) for e in edges for i in e}
        homes = {i: min(j for j in reach[i] if i in reach[j]) for i in reach}
        many = {i for i in homes if sum(h == homes[i] for h in homes.values()) > 1}
        got = {r["id"]: r["home"] for r in traverse.strong_components(df).collect()}
        assert {i: got.get(i, i) for i in homes} == homes and many <= got.keys()
        assert {r["id"] for r in traverse.cycles(df).collect()} == many | {a for a, b in edges if a == b}
        up = defaultdict(set)
        for a, b in edges:
            if homes[a] != homes[b]:
                up[homes[a]].add(homes[b])
        deep = lambda h: max((1 + deep(x) for x in up[h]), default=0)
        assert {r["id"]: r["layer"] for r in traverse.layers(df).collect()} == {i: deep(h) for i, h in homes.items()}


def test_blast_radius_over_edges_imports_and_packages(spark):
    nodes = spark.createDataFrame([(1, "a.go", "go", "p"), (2, "b.go", "go", "p"), (3, "c.ts", "ts", "p"), (4, "d.ts", "ts", "q"), (5, "e.go", "go", "q"), (6, "f.go", "go", "q"), (7, "c.ts", "ts", "p"), (8, "z.go", "go", NONE)], "id long, path string, language string, package string")
    edges = spark.createDataFrame([(7, 2), (NONE, 1), (8, NONE)], "src long, dst long")
    matches = spark.createDataFrame([("d.ts", "c.ts"), ("e.go", "d.ts"), ("c.ts", "d.ts")], "path string, target string")
    run = lambda **k: {tuple(r) for r in traverse.blast_radius(edges, nodes, seeds(spark, 1), 9, **k).collect()}
    assert run() == {("a.go", 0, 0)}
    assert run(together=("go",)) == {("a.go", 0, 0), ("b.go", 1, 3), ("c.ts", 2, 1)}
    assert run(together=("go",), matches=matches) == {("a.go", 0, 0), ("b.go", 1, 3), ("c.ts", 2, 1), ("d.ts", 3, 2), ("e.go", 4, 2), ("f.go", 5, 3)}
    assert {r["path"] for r in traverse.blast_radius(edges, nodes, seeds(spark, 1), 9, limit=2, matches=matches, together=("go",)).collect()} == {"a.go", "b.go"}


def test_nearest_methods(spark):
    bases = [(1, 2), (2, 3), (3, 4), (4, 2), (5, 6), (5, 7), (6, 8), (7, 8), (9, 9), *((i, i + 1) for i in range(20, 32)), (NONE, 1), (1, NONE)]
    methods = [(3, "go", 30), (3, "go", 29), (4, "stop", 40), (7, "run", 70), (6, "run", 61), (8, "run", 80), (1, "own", 10), (32, "deep", 320), (NONE, "x", 1), (1, NONE, 2)]
    wanted = [(c, n) for c in (1, 2, 5, 9, 20, NONE) for n in ("go", "stop", "run", "own", "deep", "none", NONE)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = traverse.nearest_methods(made(wanted, "class long, name string"), made(bases, "class long, base long"), made(methods, "class long, name string, id long"))
    assert {tuple(r) for r in got.collect()} == {(1, "own", 1, 10, 0), (1, "go", 3, 29, 2), (1, "stop", 4, 40, 3), (2, "go", 3, 29, 1), (2, "stop", 4, 40, 2), (5, "run", 6, 61, 1), (20, "deep", 32, 320, 12)}
