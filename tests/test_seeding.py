"""Seeds, rules, positions, corpora, requests and versions against plain versions of what they define."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import identifiers as I
from skein.functions import positions
from skein.operators import filters, overview, ranking, seeding, traverse
from skein.sources import requests, rules, versions


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(9)
    return [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]


@pytest.fixture(scope="module")
def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_apart_is_the_greedy_walk(spark, pairs, edges):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for seed in range(3):
        rng = random.Random(seed)
        scores = {i: float(rng.randrange(6)) for i in rng.sample(range(45), 30)}
        kept = set()
        for i in sorted(scores, key=lambda i: (-scores[i], i)):
            if not (near.get(i, set()) - {i}) & kept:
                kept.add(i)
        assert rows(seeding.apart(spark.createDataFrame(list(scores.items()), "id long, score double"), edges)) == {(i, scores[i]) for i in kept}
    assert rows(seeding.apart(spark.createDataFrame([], "id long, score double"), edges)) == set()


def test_callers(spark):
    e = spark.createDataFrame([(10 + i, 1) for i in range(20)] + [(12, 2), (50, 11), (51, 12), (1, 2), (60, 2)], "src long, dst long")
    got = dict(rows(seeding.with_callers(spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 0.5), (None, 9.0)], "id long, weight double"), e, (3, 1))))
    # The second hop starts from all seeds: 11 calls seed 1, which weighs more than what 51 calls.
    assert got == {1: 1.0, 2: 2.0, 12: 0.7, 60: 0.7, 10: 0.35, 11: 0.35}


def test_gate(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (7, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(1, True, 0.1), (3, False, 0.2), (4, False, 0.84), (5, False, 0.85), (6, False, None), (7, None, 0.5)], "id long, exact boolean, cosine double")
    assert {r.id for r in seeding.contamination_gate(seeds, e).collect()} == {1, 3, 5, 6}
    assert seeding.contamination_gate(seeds.where("id > 1"), e).count() == 5


def test_slots(spark):
    rng = random.Random(2)
    data = [(t, f"t{t}", i, f"p{rng.randrange(3)}", rng.randrange(5)) for t in range(12) for i in range(t * 100, t * 100 + rng.randrange(1, 8))]
    want, held = set(), {}
    for t in range(12):
        taken = 0
        for r in sorted((r for r in data if r[0] == t), key=lambda r: (-r[4], r[2]))[:4]:
            if held.get(r[3], 0) >= 2 and taken:
                continue
            held[r[3]] = held.get(r[3], 0) + 1
            taken += 1
            want.add(r[2])
    got = seeding.anchor_slots(spark.createDataFrame(data, "position int, token string, id long, path string, score int"))
    assert {r.id for r in got.collect()} == want


def test_cycles_and_layers(spark):
    long = [(f"n{i:02}", f"n{(i + 1) % 11:02}") for i in range(11)] + [("a", "n00"), ("n03", "z"), ("z", "y"), ("b", "a"), ("s", "s"), (None, "q")]
    e = spark.createDataFrame(long, "src string, dst string")
    assert {r.id for r in traverse.cycles(e).collect()} == {f"n{i:02}" for i in range(11)} | {"s"}
    got = dict(rows(traverse.layers(e)))
    assert got == {f"n{i:02}": 2 for i in range(11)} | {"a": 3, "b": 4, "z": 1, "y": 0, "s": 0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(13)], "src long, dst long")
    assert dict(rows(traverse.layers(chain))) == {i: 13 - i for i in range(14)}
    assert rows(traverse.cycles(chain)) == set() and rows(traverse.layers(chain.limit(0))) == set()


def test_rules(spark, tmp_path):
    f = tmp_path / "rules.json"
    said = [
        {"name": "pure", "components": ["a"], "mayDependOn": ["b"]},
        {"name": "base", "components": ["b", "c"], "mayDependOn": []},
        {"name": "door", "components": ["c"], "mayBeUsedBy": ["a"]},
        {"name": "gone", "components": ["x"], "mayDependOn": ["a"], "because": "it was here"},
        {"name": "ring", "acyclic": True},
    ]
    f.write_text(json.dumps({"$comment": "", "invariants": said}, indent=1))
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "c"), ("d", "b"), ("c", "c")], "component string, target string")
    known = spark.createDataFrame([(c,) for c in "abcd"], "component string")
    assert rows(overview.rule_violations(p, known, rules.read_rules(spark, f"file://{f}"))) == {
        ("pure", "dependency", "a", "c"), ("base", "dependency", "b", "d"), ("door", "user", "d", "c"), ("gone", "unknown", "x", None), ("ring", "cycle", "b", "d"), ("ring", "cycle", "d", "b"),
    }
    f.write_text(json.dumps({"invariants": [{"name": "nothing", "components": ["a"]}]}))
    with pytest.raises(Exception, match="says nothing"):
        rules.read_rules(spark, f"file://{f}").collect()


def test_spine(spark):
    homes = spark.createDataFrame([(i, "a") for i in range(1, 20)] + [(i, "b") for i in range(20, 40)], "id long, component string")
    e = [(1, i) for i in range(2, 12)] + [(1, i) for i in range(20, 30)] + [(2, 12), (3, 12), (2, 1), (20, 30), (30, 1), (5, 1), (1, 1)]
    got = rows(traverse.call_spine(spark.createDataFrame(e, "src long, dst long"), homes, spark.createDataFrame([(1,)], "id long"), 4, 6))
    want = {(0, 2, 1, "in"), (0, 30, 1, "in"), (0, 5, 1, "in"), (2, 2, 12, "call"), (2, 3, 12, "call")}
    assert got == want | {(1, 1, i, "call") for i in range(2, 8)} | {(1, 1, i, "boundary") for i in range(20, 30)}


def test_positions(spark):
    line = "x = \U0001f600é.naïve::<Vec<u8>>(1) + vec![2] != r#type (3) Type::new"
    units = line.encode("utf-16-le")
    got = spark.range(len(units) // 2 + 4).select("id", F.lit(line).alias("l"), F.col("id").cast("int").alias("c")).select(
        "id", positions.byte_of(F.col("l"), F.col("c")), positions.identifier_at(F.col("l"), F.col("c")), positions.is_call(F.col("l"), F.col("c"))
    )
    at = {r[0]: tuple(r)[1:] for r in got.collect()}
    for c, (offset, _, _) in at.items():
        n, k = 0, 0
        while k < len(line) and n < c:
            n += 1 + (ord(line[k]) > 0xFFFF)
            k += 1
        assert offset == len(line[:k].encode()), c
    where = lambda s: len(line[: line.index(s)].encode("utf-16-le")) // 2
    assert at[where("naïve")][1:] == ("naïve", True) and at[where("vec!")][1:] == ("vec", True)
    assert at[where("r#type")][1] == "type" and at[where("type")][2] and not at[where("Type")][2] and at[where("= ")][1] is None
    odd = spark.createDataFrame([(None, 1), ("", 3), ("ab", None), ("ab", -2)], "l string, c int")
    assert [tuple(r) for r in odd.select(positions.byte_of(F.col("l"), F.col("c")), positions.identifier_at(F.col("l"), F.col("c"))).collect()] == [(None, None), (0, None), (0, "ab"), (0, "ab")]


def test_corpora_and_stems(spark):
    names = {
        "https://github.com/Acme/Foo.git": "github.com/acme/foo", "git@GitHub.com:acme/foo.git": "github.com/acme/foo", "ssh://git@github.com:22/acme/foo/": "github.com/acme/foo",
        " git://github.com/acme/foo.GIT ": "github.com/acme/foo", "my repo!": "local/my-repo-", "https://user:pw@h.org:8443/a/b": "h.org/a/b", "": "local/",
    }
    got = spark.createDataFrame([(k,) for k in names] + [(None,)], "u string").select("u", I.canonical_corpus(F.col("u")))
    assert dict(rows(got)) == names | {None: None}
    words = {"cached": "cache", "responses": "response", "parsing": "parse", "callers": None, "queries": None, "Merged": "merge", "fixed": None}
    assert dict(rows(spark.createDataFrame([(w,) for w in words], "w string").select("w", I.stem_with_e(F.col("w"))))) == words


def test_anchor_noise(spark):
    n = spark.createDataFrame(
        [(1, "src/a.go", "fn:a", "function", 0), (2, ".github/workflows/ci.yml", "pkg:ci", "package", 0), (3, "src/a.go", "fn:t", "function", 1), (4, "tests/a.go", "fn:b", "function", 0), (5, "src/a", "pkg:a", "package", None)],
        "id int, path string, signature string, kind string, test_role int",
    )
    assert {r.id for r in n.where(~filters.is_anchor_noise(F.col("path"), F.col("signature"), F.col("kind"), F.col("test_role"))).collect()} == {1, 5}


def test_abstaining(spark):
    q = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "query_id int, answerable boolean")
    r = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "query_id int, rank int")
    assert ranking.abstain_accuracy(q, r).collect() == [(4, 2, 0.5)]


def test_requests():
    schema = {"properties": {"name": {"type": "string"}, "n": {"type": "integer"}, "deep": {"type": "boolean"}, "mode": {"type": "string", "enum": ["a", "b"]}}, "required": ["name"], "additionalProperties": False}
    assert requests.checked(schema, {"name": "x", "n": " 7", "deep": "true", "mode": None}) == {"name": "x", "n": 7, "deep": True, "mode": None}
    for bad in ({}, {"name": " "}, {"name": 3}, {"name": "x", "n": "y"}, {"name": "x", "n": -1}, {"name": "x", "n": True}, {"name": "x", "deep": 1}, {"name": "x", "mode": "c"}, {"name": "x", "more": 1}, [1]):
        with pytest.raises(ValueError):
            requests.checked(schema, bad)
    requests.check_text("src/a..b.py")
    requests.check_text("100%.md", decoded=False)
    requests.check_text("x" * 4096, requests.MAX_LIST)
    for bad in ("../a", "a/..", "..", "/etc", "C:\\a", "a%2e", "a\0b", "c:", "a../b", "x" * 513):
        with pytest.raises(ValueError):
            requests.check_text(bad)


def test_cache():
    c, made = requests.ResultCache(entries=2, size=10), []

    def make(v):
        return lambda: made.append(v) or v

    assert c.get("t", {"a": 1, "b": 2}, {"nodes": 1}, make(b"one")) == b"one" == c.get("t", {"b": 2, "a": 1}, {"nodes": 1}, make(b"no"))
    assert c.get("t", {"a": 1, "b": 2}, {"nodes": 2}, make(b"two")) == b"two"
    c.get("t", {"a": 1, "b": 2}, {"nodes": 1}, make(b"no"))
    c.get("u", {}, {}, make(b"three"))
    assert len(c) == 2 and c.get("t", {"a": 1, "b": 2}, {"nodes": 1}, make(b"no")) == b"one"
    c.get("v", {}, {}, make(b"eight by 8"))
    assert len(c) == 1 and c.held == 10 and c.get("w", {}, {}, make(b"x" * 11)) == b"x" * 11 and len(c) == 1
    assert made == [b"one", b"two", b"three", b"eight by 8", b"x" * 11]


def test_versions(spark, tmp_path):
    folder, old = f"file://{tmp_path}/nodes", spark.range(3)
    steps = {2: versions.add_column("role", "int", "0"), 1: versions.add_column("path", "string")}
    assert versions.version(spark, folder) == 0 and versions.migrate(spark, folder, steps, old) == 2

    def broken(df):
        return df.select(F.raise_error(F.lit("stopped")).alias("id"))

    with pytest.raises(Exception, match="stopped"):
        versions.migrate(spark, folder, steps | {3: broken})
    assert versions.version(spark, folder) == 2
    assert versions.migrate(spark, folder, steps | {3: versions.add_column("path", "string")}) == 3
    got = spark.read.parquet(f"{folder}/v=3")
    assert got.columns == ["id", "path", "role"] and rows(got) == {(i, None, 0) for i in range(3)}
