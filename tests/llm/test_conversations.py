"""Conversation repair against a search of all edits, on conversations made to be awkward."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

conversations = pytest.importorskip("skein.llm.conversations")

SCHEMA = "conv_id long, turn long, role string, text string, conv string, symbol int, audit string, hash string"
ROLE = re.compile("(s?(ua)+)?")


def sp(x):
    return " " if x is None else str(x)


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k, r, x = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20, sp(r), sp(x)
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def scripts(rows, faults):
    """All edits that cost no more than deleting all rows and whose roles can still become right: (cost, labels, repaired)."""
    begun = re.compile("s?(ua)*u?")

    def go(i, cost, labels, made):
        if cost > 4 * len(rows) or not begun.fullmatch("".join(r[:1] or "-" for r, _ in made)):
            return
        if i == len(rows) and ROLE.fullmatch("".join(r[:1] for r, _ in made)):
            yield cost, labels, made
        if not labels.endswith("II"):
            for r in ("user", "assistant"):
                yield from go(i, cost + 3, labels + "I", [*made, (r, "")])
        if i < len(rows):
            role, text = rows[i][2:]
            yield from go(i + 1, cost + 4, labels + "D", made)
            if faults[i] in (None, "truncated"):
                more = 3 if faults[i] else 0
                yield from go(i + 1, cost + more, labels + "K", [*made, (role, text)])
                for r in ("user", "assistant"):
                    yield from go(i + 1, cost + 3 + more, labels + "R", [*made, (r, text)])

    return go(0, 0, "", [])


def expected(rows, ids):
    by = defaultdict(list, {i: [] for i in ids})
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, sp(r[2]), hashlib.sha256(sp(r[3]).encode()).digest()))
        own = [(c, t, sp(r), sp(x)) for c, t, r, x in own]
        faults, seen = [], set()
        for _, _, r, x in own:
            bare = x.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((r, x))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = min(scripts(own, faults), key=lambda s: s[:2]) if own else (0, "", [])
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), repaired
    return out


def rows():
    rng = random.Random(11)
    texts = ["Fine.", "Yes!", "cut off", "", " \t\n", None, "Fine.", "ends. \n", "nb\xa0", "é?", "x" * 70000 + ".", "日本。"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "upper", "sage"]
    out = []
    for c in [*range(70), -7, None]:
        for i in range(rng.randint(1, 4)):
            role = roles[i % 2] if rng.random() < 0.5 else rng.choice(roles)
            out.append((c, rng.choice([i, i, i, i, None, i + 3, 1]), role, rng.choice(texts)))
    return out + out[5:8] + [(1000, None, None, None), (1001, 5, "user", "a."), (1001, 5, "user", "a.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "K", "h") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("harmed", [False, True])
def test_repair(spark, harmed):
    own = rows()
    ids = {r[0] for r in own} if harmed else set()
    df = frame(spark, own)
    want = expected(damaged(own) if harmed else own, ids)
    r = conversations.repair(conversations.damage(df), ids=df) if harmed else conversations.repair(df)
    got = {x["conv_id"]: tuple(x)[1:] for x in r.collect()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c][0], (c, [x for x in own if x[0] == c])
    if not harmed:
        by = defaultdict(dict)
        for x in conversations.repaired_rows(df).collect():
            by[x["conv_id"]][x["position"]] = (x["role"], x["text"])
        assert {c: [by[c][i] for i in range(len(by[c]))] for c in want} == {c: w[1] for c, w in want.items()}


def test_long_conversations(spark):
    """Thousands of rows in one conversation: the path costs what a table of all costs by row and state gives."""
    rng = random.Random(2)
    own = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(3000)}{rng.choice('.x')}") for i in range(6000)]
    r = conversations.repair(frame(spark, own)).first()
    seen, best = set(), {0: 0}
    near = lambda b: {s: min(b.get(p, 1e9) + c for p, c in w) for s, w in {0: [(0, 0)], 1: [(1, 0)], 2: [(2, 0), (0, 3), (1, 3), (3, 3)], 3: [(3, 0), (2, 3), (0, 6), (1, 6)]}.items()}
    for _, _, role, text in own:
        best, now = near(best), defaultdict(lambda: 1e9)
        for s, c in best.items():
            now[s] = min(now[s], c + 4)
            if (role, text) not in seen:
                more = 0 if text[-1] == "." else 3
                for i, k in ((role[0], 0), ("u", 3), ("a", 3)):
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, i))
                    if to is not None:
                        now[to] = min(now[to], c + k + more)
        seen.add((role, text))
        best = dict(now)
    best = near(best)
    assert r["cost"] == min(best[0], best[3]) and len(r["audit"].replace("I", "")) == len(own)


def test_weights_and_machines():
    r = conversations.Repair()
    assert r.path(b"") == (0, "") and r.path(bytes([4])) == (3, "KI") and r.path(bytes([8])) == (3, "IK")
    assert r.path(bytes([0])) == (4, "D") and r.path(bytes([4, 8])) == (0, "KK") and r.path(bytes([7, 6])) == (8, "DD")
    assert len(r.steps) < 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(none, ids=none).collect() == [] and conversations.repaired_rows(none).collect() == [] and conversations.damage(none).collect() == []
    only = conversations.repair(none, ids=spark.createDataFrame([(3,), (3,), (None,)], "conv_id long")).collect()
    assert {tuple(x) for x in only} == {(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in (3, None)} and len(only) == 2
