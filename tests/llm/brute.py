"""Plain versions of the operators' definitions, for small tables."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def exact(rows):
    """{doc_id: (keep, size)} of (doc_id, text)."""
    by = collections.defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    return {d: (max(own), len(own)) for own in by.values() for d in own}


def substring(rows, width=13):
    """{doc_id: (n_words, n_removed, sha)}."""
    first = {}
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = {k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for k in range(i, i + width)}
        out[d] = len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return out


def shingle_set(text, width=5):
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(rows, width=5):
    """{doc_id: (n_shingles, component)}."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def interpolated(rows, order=3, buckets=24, rounds=60, folds=10):
    """{doc_id: log10 probability} by deleted interpolation, from events one by one: fold 0 unseen, fold 1 for the weights."""

    def counts(train):
        c, context = collections.Counter(), collections.Counter()
        for own in train:
            for i in range(len(own)):
                for k in range(1, order + 1):
                    if i - k + 1 >= -1:
                        gram = tuple(own[max(0, i - k + 1) : i + 1]) if i - k + 1 >= 0 else ("<", *own[: i + 1])
                        c[k, gram] += 1
                        context[k, gram[:-1]] += 1
                    else:
                        c[k, ("<", *own[: i + 1])] += 1
                        context[k, ("<", *own[:i])] += 1
        return c, context, sum(map(len, train)), len({w for own in train for w in own})

    def estimates(own, model):
        c, context, n, _ = model
        for i in range(len(own)):
            out = []
            for k in range(1, order + 1):
                gram = tuple(own[i - k + 1 : i + 1]) if i - k + 1 >= 0 else ("<", *own[: i + 1])
                seen = context[k, gram[:-1]] if k > 1 else n
                out.append((c[k, gram] / seen if seen else 0.0, min(buckets - 1, seen.bit_length()) if k > 1 else 0))
            yield out

    def levels(out, weights, uniform):
        p = [uniform]
        for k, (own, b) in enumerate(out):
            p.append(weights[k][b] * own + (1 - weights[k][b]) * p[-1])
        return p

    tokens = [(d, words(lower(t)) + [None]) for d, t in rows]
    learnt = counts([own for d, own in tokens if fold(d, folds) > 1])
    events = [e for d, own in tokens if fold(d, folds) == 1 for e in estimates(own, learnt)]
    weights = [[0.5] * buckets for _ in range(order)]
    for w in weights[1:]:
        w[0] = 0.0
    for _ in range(rounds):
        took = [[[0.0, 0.0] for _ in range(buckets)] for _ in range(order)]
        for e in events:
            p = levels(e, weights, 1 / (learnt[3] + 1))
            reach = 1 / p[-1]
            for k in range(order - 1, -1, -1):
                own, b = e[k]
                took[k][b][0] += reach * weights[k][b] * own
                took[k][b][1] += reach * (1 - weights[k][b]) * p[k]
                reach *= 1 - weights[k][b]
        weights = [[a / (a + z) if a + z else w for w, (a, z) in zip(old, new)] for old, new in zip(weights, took)]
    for k in range(1, order):
        had = {e[k][1] for e in events}
        for b in range(2, buckets):
            if b not in had:
                weights[k][b] = weights[k][b - 1]
        weights[k] = [0.0] + [min(w, 1 - 1e-7) for w in weights[k][1:]]
    weights[0] = [min(w, 1 - 1e-7) for w in weights[0]]
    model = counts([own for d, own in tokens if fold(d, folds)])
    return {d: sum(math.log10(levels(e, weights, 1 / (model[3] + 1))[-1]) for e in estimates(own, model)) for d, own in tokens}
