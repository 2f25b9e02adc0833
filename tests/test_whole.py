"""Whole-table queries against brute force: no row of an input is left out."""

from collections import Counter, defaultdict

import pytest

from skein.catalog import QUERIES, Graph
from skein.functions import identifiers as I
from skein.functions.text import sanitize
from skein.plans import graph, relational, text  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark, DATA)


@pytest.fixture(scope="module")
def nodes(g):
    return g.nodes.collect()


def rows(spark, name):
    return Counter(tuple(r) for r in QUERIES[name](spark, DATA).collect())


def test_in_edges(spark, g, nodes):
    methods = {n["id"] for n in nodes if n["kind"] == "method"}
    assert rows(spark, "in_edges") == Counter((e["src"], e["dst"], e["kind"]) for e in g.edges.collect() if e["dst"] in methods)


def test_node_scan(spark, nodes):
    assert rows(spark, "node_scan") == Counter((n["id"], n["signature"]) for n in nodes) and len(nodes) > 500


def test_sanitize_text(spark, g):
    clean = lambda s: "".join(c for c in s if c in "\t\n\r" or not (ord(c) < 32 or 127 <= ord(c) < 160 or c in "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069")).replace("<", "&lt;").replace(">", "&gt;")
    assert rows(spark, "sanitize_text") == Counter((p["page_id"], clean(p["html"])) for p in g.table("pages").collect())
    odd = "".join(map(chr, (*range(1, 0x110), *range(0x2020, 0x2070), 0x1F600)))
    assert spark.createDataFrame([(odd,)], "c string").select(sanitize(relational.F.col("c"))).first()[0] == clean(odd)


def test_lsif_occurrences(spark, g):
    want = Counter((f"order_{r['l_orderkey']}.ts", r["l_linenumber"], f"part_{r['l_partkey']}") for r in g.table("lineitem").collect())
    assert rows(spark, "lsif_occurrences") == want


def test_python_symbols_of_all_parts(spark, g):
    found = QUERIES["python_symbols"](spark, DATA).where("kind = 'file'").collect()
    assert sorted(r["path"] for r in found) == sorted(f"p{r['p_partkey']}.py" for r in g.table("part").collect())


def test_kind_diversity(spark, nodes):
    bands, want = defaultdict(lambda: defaultdict(list)), []
    for n in nodes:
        bands[n["id"] % 100 // 10][n["kind"]].append((-(n["id"] % 100), n["id"]))
    for band, kinds in bands.items():
        order = sorted((k, score, id_, kind) for kind, own in kinds.items() for k, (score, id_) in enumerate(sorted(own)))
        want += [(id_, kind, band, i) for i, (_, _, id_, kind) in enumerate(order, 1)]
    assert rows(spark, "kind_diversity") == Counter(want)


def test_edit_overlap(spark, g, nodes):
    spans, path_of, want = defaultdict(list), {n["id"]: n["path"] for n in nodes}, []
    for n in nodes:
        if n["line"] is not None:
            spans[n["path"]].append((n["id"], n["line"], n["end_line"]))
    for o in g.table("orders").collect():
        key = o["o_orderkey"]
        a, b = key % 1900 + 2, key % 1900 + 8
        hit = [s for s in spans[path_of[60000000000 + key]] if s[1] <= b and s[2] >= a]
        want += [(key, i) for i, x, y in hit if not any(j != i and u >= x and v <= y and v - u < y - x for j, u, v in hit)]
    assert rows(spark, "edit_overlap") == Counter(want)


def test_unify_ladder(spark, nodes):
    leaf = lambda s: s.split(":", 1)[-1].split(".")[-1]
    here, there, want = defaultdict(list), defaultdict(list), []
    for n in nodes:
        if n["kind"] not in ("file", "doc-chunk", "package"):
            here[leaf(n["signature"]), n["path"]].append(n["id"])
            there[leaf(n["signature"]), n["language"]].append(n["id"])
    for n in nodes:
        if n["kind"] in ("class", "method", "function"):
            name = leaf("sym:gone" if n["id"] % 7 == 0 else n["signature"])
            one = here.get((name, n["path"] if n["id"] % 3 == 0 else "moved/" + n["path"]))
            two = there.get((name, n["language"]), [])
            want.append((n["id"], min(one), "same-file") if one else (n["id"], two[0], "unique") if len(two) == 1 else (n["id"], None, "missed"))
    assert rows(spark, "unify_ladder") == Counter(want)


def near(g, word, least):
    """(-sim, token) of the words of all nodes, the best first."""
    grams = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    vocab = {t for r in g.nodes.select(I.segments(relational.F.concat("signature", "path"))).collect() for t in r[0] if len(t) >= 4}
    sims = ((len(grams(word) & grams(t)) / len(grams(word) | grams(t)), t) for t in vocab)
    return sorted((-s, t) for s, t in sims if s >= least)


def test_typo_correct(spark, g):
    want = []
    for q in text._TYPOS:
        if best := near(g, q, 0.7):
            alone = len(best) == 1 or best[1][0] - best[0][0] >= 0.05
            want.append((q, best[0][1] if alone else None, round(-best[0][0], 6)))
    assert rows(spark, "typo_correct") == Counter(want)


def test_vocab_expand(spark, g):
    want = [(q, t) for q in ("widget", "brand", "building") for _, t in near(g, q, 0.4)[:16]]
    assert rows(spark, "vocab_expand") == Counter(want)


def test_context_ranks_at_full_depth(spark, monkeypatch):
    from skein.operators import traverse
    from skein.plans import retrieval

    seen, real = [], traverse.personalised_pagerank
    monkeypatch.setattr(traverse, "personalised_pagerank", lambda *a, **k: (seen.append(k), real(*a, **k))[1])
    nodes = spark.createDataFrame([(i, "x", "a.ts", "ts", "fn:charge" if i == 1 else f"fn:f{i}", "function", "p", 1, 2, 0) for i in range(1, 9)], "id long, corpus string, path string, language string, signature string, kind string, package string, line int, end_line int, test_role int")
    chain = spark.createDataFrame([(i, i + 1, "ref/call") for i in range(1, 8)], "src long, dst long, kind string")
    assert {r["id"] for r in retrieval.context(nodes, chain, "charge", 500).collect()} == set(range(1, 8)) and seen == [{}]


def test_ppr_rbac(spark, g, nodes):
    corpus = {n["id"]: n["corpus"] for n in nodes}
    out, p = defaultdict(list), {n["id"] for n in nodes if n["kind"] == "file" and n["corpus"] == "asia"}
    for e in graph.weighted(g.edges).collect():
        if corpus.get(e["dst"]) in ("asia", "parts"):
            out[e["src"]].append((e["dst"], e["weight"]))
    held, front = set(p), set(p)
    for _ in range(5):
        front = {v for u in front for v, _ in out[u]} - held
        held |= front
    p = {i: 1 / len(p) for i in p}
    rank = p
    for _ in range(50):
        now = defaultdict(float, {i: 0.15 * x for i, x in p.items()})
        for u, x in rank.items():
            if u in held and out[u]:
                total = sum(w for _, w in out[u])
                for v, w in out[u]:
                    now[v] += 0.85 * x * w / total
        change = sum(abs(now[i] - rank.get(i, 0.0)) for i in now)
        rank = now
        if change < 1e-6:
            break
    found = {r["id"]: r["score"] for r in QUERIES["ppr_rbac"](spark, DATA).collect()}
    assert set(found) == set(rank) and all(abs(found[i] - x) < 1e-9 for i, x in rank.items())


def test_connecting_path(spark):
    from skein.operators import traverse

    ids = lambda x: spark.createDataFrame([(x,)], "id long")
    # A chain of eight edges, dearer branches off it, and a loop.
    e = spark.createDataFrame([*((i, i + 1, 1.0) for i in range(8)), (2, 1, 1.0), (0, 20, 11.5), (0, 21, 12.5), (20, 22, 0.5), (30, 8, 1.0)], "src long, dst long, cost double")
    found = {r["id"]: (r["cost"], r["on_route"]) for r in traverse.connecting_path(e, ids(0), ids(8)).collect()}
    assert found == {**{i: (float(i), True) for i in range(9)}, 20: (11.5, False), 22: (12.0, False)}
    # Twelve edges lie beyond five hops from each end.
    far = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], "src long, dst long, cost double")
    assert {(r["id"], r["cost"], r["on_route"]) for r in traverse.connecting_path(far, ids(0), ids(12)).collect()} == {(i, None, False) for i in range(4)}


def test_symbols_beyond_a_thousand(spark):
    from skein.plans import retrieval

    n = spark.range(1200).selectExpr("id", "'fn:f' || id || '_' AS signature", "'a.py' AS path")
    found = retrieval.resolve_symbols(spark.range(1200).selectExpr("'f' || id || '_' AS q"), n)
    assert {(r["q"], r["id"]) for r in found.collect()} == {(f"f{i}_", i) for i in range(1200)}


def test_budget_prefix_beyond_ten_thousand(spark):
    from skein.operators import ranking

    r = ranking.budget_prefix(spark.range(13_000).selectExpr("id", "1L AS cost"), 12_000, ["id"])
    assert r.count() == 12_000


def test_scope_gate_takes_all_package_roots(spark, monkeypatch):
    n = spark.range(12_000).selectExpr("id * 1000 + 7 AS id", "'r' || id || '/p/f.py' AS path")
    monkeypatch.setattr(relational, "Graph", lambda spark, d: type("G", (), {"nodes": n}))
    assert relational.scope_gate(spark, "").count() == 12_000
