"""Mixing: targets against a plain version, whole blocks, permutations, totals and reruns."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

mixing = pytest.importorskip("skein.llm.mixing")
from tests.llm import brute  # noqa: E402

SCHEMA = "doc_id long, text string, source string, key long, part int, rank string, size string, before int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, 2, "r", "z", 3) for d, t, s in rows], SCHEMA).repartition(3)


def rows():
    rng = random.Random(8)
    out = []
    for i in range(300):
        s = rng.choice(["a", "a", "a", "b", "Z", "é", None, "日", "zz"])
        out.append((i * 3 - 50, rng.choice([None, "", " \n"]) if i % 17 == 0 else "w " * rng.randint(1, 900 if s == "a" else 120), s))
    return out + [(1, "big " * 40000, "long"), (7, "same words", "b"), (7, "same words", "b"), (None, "no id " * 30, "a"), (None, "x", "tiny"), (5, "", "nothing")]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        left = sum(w[s] for s in sizes if s not in full)
        t = {s: most * sizes[s] if s in full else rest * w[s] / left for s in sizes}
        more = {s for s in sizes if s not in full and t[s] > most * sizes[s]}
        if not more:
            return t
        full |= more


@pytest.fixture(scope="module")
def mixture(spark):
    return mixing.mix(frame(spark, rows()), shard=500, group=3)


def test_targets_totals_and_bounds(mixture):
    own = rows()
    sizes = defaultdict(int)
    for _, t, s in own:
        sizes[s] += len(brute.words(t))
    want, source = plain_targets(sizes), {}
    got = mixture.taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(brute.words(t))) for d, t, _ in own)
    by = defaultdict(int)
    for d, t, s in own:
        source.setdefault((d, len(brute.words(t))), s)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        by[s] += r["taken"]
    assert all(abs(by[s] - want[s]) <= 2 * mixing.BLOCK for s in sizes) and abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-3


def test_slots_are_whole_and_rounds_take_each_block_once(mixture):
    spans = mixture.spans.collect()
    slots = defaultdict(list)
    for r in spans:
        slots[r["shard"], r["slot"]].append(r)
    last = max(s for s, _ in slots)
    assert {s for s, _ in slots} == set(range(last + 1)) and all(sorted(k for s, k in slots if s == n) == list(range(500)) for n in range(last))
    taken = Counter()
    for own in slots.values():
        assert len({(r["rank"], r["block"]) for r in own}) == 1 and sum(r["words"] for r in own) <= mixing.BLOCK
        taken[own[0]["rank"], own[0]["block"]] += 1
    by = defaultdict(list)
    for (rank, _), n in taken.items():
        by[rank].append(n)
    assert all(max(n) - min(n) <= 1 and max(n) <= 2 for n in by.values()) and any(max(n) == 2 for n in by.values())
    draws = Counter((s, own[0]["rank"]) for (s, _), own in slots.items())
    assert len({n for (_, rank), n in draws.items() if rank == 2}) > 3  # counts vary from shard to shard


def test_reruns_agree(spark, mixture):
    a = mixing.mix(frame(spark, rows()[::-1]).repartition(7), shard=500, group=3)
    key = lambda m: Counter(tuple(r) for r in m.spans.join(m.documents.select("key", "doc_id", "size"), "key").select("shard", "slot", "block", "rank", "first", "words", "doc_id").collect())
    assert key(a) == key(mixture)
    b = mixing.mix(frame(spark, rows()), shard=500, group=3, seed=2)
    assert key(b) != key(mixture)


def test_texts(spark):
    own = [(i, " ".join(f"{i}.{k}" for k in range(50 + i)), "ab"[i % 2]) for i in range(20)]
    df = frame(spark, own)
    got = mixing.mixed_texts(df, mixing.mix(df)).collect()
    words = {d: t.split() for d, t, _ in own}
    assert got and all(r["text"].split() == words[r["doc_id"]][r["first"] : r["first"] + len(r["text"].split())] for r in got)


def test_permutations():
    for n in (1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097):
        for key in (0, 9):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got) == list(range(n)) and (n < 16 or (got != np.arange(n)).any())


def test_tables_without_words(spark):
    assert mixing.mix(frame(spark, [])).taken().collect() == []
    assert {tuple(r) for r in mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).taken().collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
