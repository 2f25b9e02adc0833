"""The seed cascade against a plain version, on made-up nodes: lanes, gates, ranks, and ranks without a lane."""

import math
import re
from collections import defaultdict

import pytest

from skein.operators import cascade as C

NODES = [
    (1, "app", "src/core/daemon.rs", "struct:Daemon", "class", 1, 9),
    (2, "app", "src/core/daemon.rs", "method:Daemon.start", "method", 10, 30),
    (3, "app", "src/core/daemon.rs", "fn:daemonize", "function", 31, 33),
    (4, "app", "src/core/daemon.rs", "method:Daemon.stop", "method", 40, 50),
    (5, "app", "src/net/http_response.ts", "class:HttpResponse", "class", 1, 90),
    (6, "app", "src/net/http_response.ts", "method:HttpResponse.body", "method", 5, 8),
    (7, "lib", "src/net/group.ts", "fn:groupBy", "function", 1, 8),
    (8, "lib", "src/util/cache.ts", "fn:cache", "function", 1, 4),
    (9, "app", "tests/daemon.rs", "fn:daemon_test", "function", 1, 2),
    (10, "app", "other/place/start.rs", "fn:start_all", "function", 1, 99),
    (11, "app", "daemon.rs", "fn:lonely", "function", 1, 2),
    *[(100 + i, "app", f"src/many/f{i % 4}.rs", f"fn:handle_item_{'abcdefgh'[i % 8]}{i}", "function", i, i + i % 5) for i in range(40)],
]
QUERIES = [(1, "how does the daemon start?"), (2, "HttpResponsee body"), (3, "grouped items"), (4, "cached"), (5, "the of a"), (6, None), (7, "zzzz nothing"), (8, "handle item daemon"), (9, "groupBy")]
VECTORS = [(1, 10, 0.7), (1, 2, 0.66), (1, 8, 0.2), (1, 105, 0.5), (2, 5, 0.3), (3, 7, 0.9), (3, 110, 0.86), (3, 111, 0.4), (7, 8, 0.6), (9, 8, 0.9), (9, 110, 0.95)]
EDGES = [(2, 1), (2, 10), (10, 100), (100, 101), (7, 120), (6, 5), (8, 7)]
STOP = set(C.I.QUERY_STOP_WORDS)


def segs(s):
    s = re.sub("[^A-Za-z0-9]+", " ", s)
    s = re.sub("([a-z0-9])([A-Z])", r"\1 \2", s)
    s = re.sub("([0-9])([A-Za-z])", r"\1 \2", re.sub("([A-Za-z])([0-9])", r"\1 \2", s))
    return s.lower().split()


def has(t, s):
    g = segs(s)
    return any("".join(g[i:j]) == t for i in range(len(g)) for j in range(i + 1, len(g) + 1))


def terms_of(s):
    own = [x for x in segs(s) if len(x) >= 3]
    return own + ([s.lower()] if s.lower() not in segs(s) and not re.search(r"\s", s) else [])


def tri(w):
    return {w[i : i + 3] for i in range(len(w) - 2)}


STEMS = {"items": "item", "grouped": "group", "cached": "cach", "nothing": "noth"}


def ranked(rows):
    return {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def run(text, lanes, vectors, edges):
    """(terms, seeds) of one query: seeds as [(id, score, weight, source)]."""
    by = {n[0]: n for n in NODES}
    leaf = lambda s: re.sub("[^a-z0-9]", "", re.sub("^[^:]*:", "", s).split(".")[-1].lower())
    body = lambda s: re.sub("[^a-z0-9]", "", re.sub("^[^:]*:", "", s).lower())
    noise = lambda n: n[2].startswith("tests/")
    boost = lambda n: C.BOOSTS.get(n[4], 1.0)
    strip = "!\"#$%&'()*+,-/:;<=>?@[\\]^`{|}~"
    tokens = [w for w in (x.strip(strip) for x in (text or "").split()) if len(w) >= 2 and w.lower() not in STOP]
    total, vocabulary = max(1000, len(NODES)), {x for n in NODES for x in [leaf(n[3]), *segs(n[3])]}
    terms, anchors, paths = [], [], defaultdict(int)
    logic = lambda n: {"method": 0, "function": 0}.get(n[4], 1)
    for token in tokens:
        low = token.lower()
        tried = [low, STEMS.get(low), STEMS[low] + "e" if low in ("cached", "grouped", "nothing") else None]
        form, rung = next(((f, k) for k, f in enumerate(tried) if f and any(has(f, n[3]) or has(f, n[2]) for n in NODES)), (low, None))
        if rung is None and len(low) >= 4:
            sims = sorted(((len(tri(low) & tri(v)) / len(tri(low) | tri(v)), v) for v in vocabulary if len(v) >= 4), key=lambda x: (-x[0], x[1]))
            if sims[0][0] >= 0.7 and (len(sims) == 1 or sims[1][0] < 0.7 or sims[0][0] - sims[1][0] >= 0.05):
                form, rung = sims[0][1], 3
        freq = sum(form in terms_of(n[3]) for n in NODES) or total
        idf = max(0.05, min(1.0, math.log((total + 1) / (freq + 1)) / math.log(total + 1)))
        rank = lambda n: 0 if form in (body(n[3]), leaf(n[3])) else 1 if body(n[3]).startswith(form) or leaf(n[3]).startswith(form) else 2  # noqa: B023, E731
        hits = sorted((n for n in NODES if rung is not None and (has(form, n[3]) or has(form, n[2]))), key=lambda n: (rank(n), n[0]))
        head = sorted([n for n in hits if has(form, n[3]) and not noise(n)][:6], key=lambda n: (logic(n), -(n[6] - n[5]), rank(n), n[0]))
        own = []
        if rung == 3:
            own = head[:1]
            for n in own:
                paths[n[2]] += 1
        elif rung is not None and idf >= 0.15:
            for n in head[:3]:
                if paths[n[2]] < 2 or not own:
                    paths[n[2]] += 1
                    own.append(n)
        anchors += [(n[0], idf * boost(n), idf >= 0.55 or rung == 3, rung == 3) for n in own]
        top = (own[0][0] if own else None) if rung == 3 else hits[0][0] if hits else None
        terms.append((token, form, rung, freq, idf, top, len(own)))
    ids = {a[0] for a in anchors}
    fixed = {a[0] for a in anchors if a[3]}
    rare = [t for t in terms if t[2] is not None and t[5] in ids and (t[3] <= 3 or t[5] in fixed)]
    bypass = bool(rare) and sum(t[4] for t in rare) >= 0.55 * sum(t[4] for t in terms)
    found = defaultdict(dict)
    if lanes & 1:
        best = defaultdict(float)
        for i, w, *_ in anchors:
            best[i] = max(best[i], w)
        for i, w in best.items():
            found["specific" if any(a[0] == i and a[2] for a in anchors) else "generic"][i] = w
    if lanes & 2:
        docs = {n[0]: terms_of(n[3]) for n in NODES}
        average, n = sum(map(len, docs.values())) / len(docs), len(docs)
        scores = defaultdict(float)
        for form in {t[1] for t in terms}:
            df = sum(form in d for d in docs.values())
            for i, d in docs.items():
                if form in d:
                    scores[i] += math.log((n - df + 0.5) / (df + 0.5) + 1) * d.count(form) * 2.2 / (d.count(form) + 1.2 * (0.25 + 0.75 * len(d) / average))
        scores = dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:50])
        scores = {i: s for i, s in scores.items() if not noise(by[i])}
        root = lambda p: "/".join(p.split("/")[:2]) if p.count("/") >= 2 else None
        roots, held = {root(by[i][2]) for i in ids} - {None} if lanes & 1 else set(), defaultdict(int)
        for i, s in scores.items():
            norm, r = max(0.05, s / max(scores.values())), root(by[i][2])
            if roots and r is not None and r not in roots and norm < 0.3:
                continue
            held[by[i][2]] += 1
            if held[by[i][2]] <= 2:
                found["lexical"][i] = norm * boost(by[i])
    cos = {i: c for i, c in vectors} if lanes & 4 else {}
    for i, c in cos.items():
        if not noise(by[i]):
            found["vector"][i] = c * boost(by[i])
    score, weight = defaultdict(float), defaultdict(float)
    for lane, own in found.items():
        for i, k in ranked(own.items()).items():
            score[i] += C.LANE_WEIGHTS[lane] / (60 + k)
            weight[i] = max(weight[i], own[i])
    source = {i: "exact" if lanes & 1 and i in ids else "vector" if i in found["vector"] else "lexical" for i in score}
    weight = {i: max(weight[i], 0.5 * score[i]) for i in score}
    kept, top = set(score), max(cos.values(), default=None)
    if top is not None and top >= 0.58 and not bypass:
        near = sorted(score, key=lambda i: (-cos.get(i, 0.0), -score[i], i))[:5]
        kept = {i for i in score if source[i] == "exact" or cos.get(i, 0.0) >= max(top - 0.13, 0.55) or i in near}
    if edges and (named := {i for i in kept if source[i] == "exact"}):
        for _ in range(2):
            named = named | {b for a, b in edges if a in named} | {a for a, b in edges if b in named}
        kept = {i for i in kept if source[i] == "exact" or i in named or i not in cos or cos[i] >= 0.85}
    trusted = top is not None and top >= 0.58
    for i in kept:
        if trusted and source[i] != "exact" and i in cos:
            weight[i] *= min(1.0, max(0.0, cos[i]))
    other = max((weight[i] for i in kept if source[i] != "exact"), default=0.0)
    special = {t[5] for t in terms if t[2] is not None and t[4] >= 0.55}
    for i in kept:
        if source[i] == "exact" and (bypass or i in special) and (not trusted or cos.get(i, 0.0) >= max(top - 0.13, 0.55)):
            weight[i] = max(weight[i], 1.5 * other)
    return terms, [(i, round(score[i], 9), round(weight[i], 9), source[i]) for i in sorted(kept, key=lambda i: (-score[i], i))]


@pytest.fixture(scope="module")
def tables(spark):
    schema = "id long, corpus string, path string, signature string, kind string, line int, end_line int, test_role int, language string"
    nodes = spark.createDataFrame([(*n, 0, "x") for n in NODES], schema)
    return nodes, spark.createDataFrame(EDGES, "src long, dst long"), spark.createDataFrame(VECTORS, "q long, id long, cosine double"), spark.createDataFrame(QUERIES, "q long, query string")


@pytest.mark.parametrize("meant", [True, False])
def test_terms_and_seeds(spark, tables, meant):
    nodes, edges, vectors, queries = tables
    c = C.Cascade(queries, nodes, vectors if meant else None)
    got, terms = defaultdict(list), defaultdict(list)
    for r in sorted(c.seeds(edges).collect(), key=lambda r: (r["q"], r["rank"])):
        got[r["q"]].append((r["id"], round(r["score"], 9), round(r["weight"], 9), r["source"]))
    for r in sorted(c.terms.collect(), key=lambda r: (r["q"], r["position"])):
        terms[r["q"]].append((r["token"], r["form"], r["rung"], r["frequency"], round(r["idf"], 9), r["top_node"], r["anchors"]))
    seen = set()
    for q, text in QUERIES:
        want_terms, want = run(text, C.ALL, [(i, c_) for k, i, c_ in VECTORS if k == q] if meant else [], EDGES)
        assert terms[q] == [(*t[:4], round(t[4], 9), *t[5:]) for t in want_terms], text
        assert got[q] == want, text
        seen |= {t[2] for t in want_terms}
    assert seen == {0, 1, 2, 3, None}


def test_explain_is_a_run_without_the_lane(spark, tables):
    nodes, edges, vectors, queries = tables
    got = {(r["q"], r["id"]): r for r in C.explain(queries, nodes, edges, vectors).collect()}
    want = defaultdict(dict)
    for q, text in QUERIES:
        for name, mask in [("rank", C.ALL), *((f"without_{n}", C.ALL & ~b) for n, b in C.LANES.items())]:
            for k, s in enumerate(run(text, mask, [(i, c) for j, i, c in VECTORS if j == q], EDGES)[1], 1):
                want[q, s[0]][name] = k
    assert got.keys() == want.keys()
    for key, ranks in want.items():
        assert {n: got[key][n] for n in ("rank", "without_anchors", "without_lexical", "without_vectors") if got[key][n] is not None} == ranks
    assert any(len(set(r.values())) > 1 for r in want.values())


def test_hidden_corpora_seed_nothing(spark, tables):
    nodes, edges, vectors, queries = tables
    hidden = {n[0] for n in NODES if n[1] == "lib"}
    got = {r["id"] for r in C.Cascade(queries, nodes, None, ["app"]).seeds(edges).collect()}
    assert got and not got & hidden


def test_no_queries_and_no_nodes(spark, tables):
    nodes, edges, vectors, queries = tables
    assert C.Cascade(queries.limit(0), nodes, vectors).seeds(edges).collect() == [] and C.Cascade(queries, nodes.limit(0)).seeds().collect() == []
