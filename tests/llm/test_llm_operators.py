"""The training-data operators against brute force, on texts made to be awkward."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("skein.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")

from skein.llm import common as C
from skein.llm import exact_dedup, jaccard_join, lm_scoring, packing, piece_fst, quality_fm, quality_rules, substring_dedup, token_files, toxicity
from skein.llm.tokens import PieceEncoder
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, block long, part int, fp string"


def make(spark, rows, parts=3):
    """Rows (doc_id, text) with the other columns of documents and some whose names operators use inside."""
    return spark.createDataFrame([(d, t, "en", None if d is None or d % 5 == 0 else f"s{d % 3}", None, "x", 1, 2, "y") for d, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "naïve", "über", "日本", "end."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(20)
    out = [text(rng.randint(1, 90)) for _ in range(60)]
    for k in (3, 9, 20):  # near copies and exact copies
        own = out[k] + " " + text(60)
        out.append(own)
        for _ in range(4):
            w = own.split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        out += [own, own]
    out += [f"{text(8)} {passage} {text(9)}" for _ in range(6)]
    out += [None, "", "  \n\t ", "one", "one", "A b c d E", "a B C D e", "a b c d", "a b c d e f", "x " * 3000, passage, "tab\there\x0bvt\x1cfs\x85nel\xa0nb", "a  b   c\n\n d ", "<|endoftext|> kept", "x" * 5000]
    return list(enumerate(out, 1))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows)


def by_id(df, *columns):
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
    return got if len(columns) > 1 else {k: v[0] for k, v in got.items()}


def test_exact_dedup(docs, rows):
    got = by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256")
    want = brute.exact(rows)
    assert got == {d: (*want[d], want[d][0] == d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    crowded = np.uint64(2**64 - 1) - np.arange(70, dtype=np.uint64)  # runs that go beyond the last home
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(3)] + [np.arange(40, dtype=np.uint64).repeat(3), crowded, crowded[:9], np.empty(0, np.uint64)]
    made = [exact_dedup.CountingQuotientFilter.of(p) for p in parts + parts[:1]]
    for f, p in zip(made, parts):
        keys, counts = f.entries()
        assert dict(zip(keys.tolist(), counts.tolist())) == collections.Counter(p.tolist()) and (np.diff(keys.astype(object)) > 0).all()
    assert len({f.q for f in made}) > 2
    merged = exact_dedup.CountingQuotientFilter.merged([exact_dedup.CountingQuotientFilter.from_bytes(*f.to_bytes()) for f in made])
    want = collections.Counter(np.concatenate(parts + parts[:1]).tolist())
    keys, counts = merged.entries()
    assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_exact_dedup_over_several_filter_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_SIZE", 16)
    monkeypatch.setattr(exact_dedup, "FLUSH", 20)
    rows = [(i, f"text {i % 90}" * (1 + 9000 * (i == 91))) for i in range(200)]
    got = by_id(exact_dedup.exact_dedup(make(spark, rows)), "keep_id", "group_size")
    assert got == brute.exact(rows)


def test_substring_dedup(docs, rows):
    got = by_id(substring_dedup.substring_dedup(docs), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(rows)
    assert any(v[1] for v in got.values())


def test_spans_are_maximal():
    assert substring_dedup.intervals(np.array([2, 3, 15, 40]), 13) == [(2, 28), (40, 53)]
    assert substring_dedup.intervals(np.array([], int), 13) == []


def test_jaccard_join(docs, rows):
    got = by_id(jaccard_join.jaccard_join(docs), "n_shingles", "component_id")
    assert got == brute.components(rows)


def test_pigeonhole_misses_no_link():
    """Sets at and around the threshold always have a key in common, whatever their size."""
    rng = np.random.default_rng(3)
    for n in [4, 5, 6, 7, 9, 12, 17, 25, 40, 77, 150, 400, 1500]:
        for _ in range(25):
            base = rng.integers(0, 2**64, n + n // 4 + 2, dtype=np.uint64)
            common = rng.integers(int(0.7 * n), n + 1)
            a = np.unique(base[:n])
            b = np.unique(np.concatenate([base[:common], base[n : n + rng.integers(0, n // 4 + 2)]]))
            both, either = jaccard_join.similar(a, b)
            keys, at = jaccard_join.keys_of([a, b])
            if 100 * both >= 80 * either and both != either:
                assert set(keys[at == 0]) & set(keys[at == 1]), (n, both, either)


def test_allocation_pays_for_what_it_leaves_out():
    for band in range(40):
        m, q, k = jaccard_join.allocate(band)
        h = jaccard_join.most_differing(int(jaccard_join.bands()[band + 1]) - 1)
        assert m + q >= h + 1 + 2 * k and 0 <= k <= m - q


def test_lm_scoring(docs, rows):
    got = by_id(lm_scoring.lm_scoring(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = {d: brute.words(brute.lower(t)) + [None] for d, t in rows}
    c = collections.Counter(w for d, own in tokens.items() if brute.fold(d, 10) for w in own)
    n, v = sum(c.values()), len(c)
    score = brute.interpolated(rows)
    for d, own in tokens.items():
        held, n_tokens, known, train, base, got_score = got[d]
        assert (held, n_tokens, known, train) == (brute.fold(d, 10) == 0, len(own), sum(c[w] > 0 for w in own), n)
        assert base == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert got_score == pytest.approx(score[d], rel=1e-3, abs=0.02)


def test_lm_probabilities_sum_to_one():
    """Over a vocabulary and one unknown word, the mixture after any context, seen or not, is a distribution."""
    cells = {"b2": [1, 2, 2], "b3": [0, 1, 2], "s1": [-20, -25, -20], "s2": [-3, lm_scoring.LOWEST, -10], "s3": [lm_scoring.LOWEST, 0, -1], "n": [5, 7, 2]}
    h = lm_scoring.pd.DataFrame(cells | {"log1": [-25.0, -40.0, -10.0], "log2": [-4.0, 0.0, -5.0], "log3": [0.0, 0.0, -0.4]})
    w = lm_scoring.learn_weights(h, 1 / 11)
    assert ((w >= 0) & (w < 1)).all() and not w[1:, 0].any()
    for bigram, c2 in ((np.full(10, 0.1), 5), (np.zeros(10), 0)):
        for trigram, c3 in ((np.array([1.0] + [0.0] * 9), 1), (np.zeros(10), 0)):
            contexts = [np.full(11, c2), np.full(11, c3)]
            estimates = [np.append(x, 0) for x in (np.full(10, 0.1), bigram, trigram)]
            assert lm_scoring.mixed(w, estimates, contexts, 1 / 11).sum() == pytest.approx(1)


def test_blocks_over_several_ranges_and_long_texts(spark, rows, monkeypatch):
    """Operators that meet by hash range give the same with many ranges and small blocks, and for texts larger than a block."""
    long = [(900 + i, " ".join(f"l{(j * (7 + i % 2)) % 5000}" for j in range(14_000))) for i in range(4)]
    both = rows + long
    assert len(long[0][1]) > 1 << 16
    docs = make(spark, both)
    whole = by_id(lm_scoring.lm_scoring(docs), "n_known", "base_score", "score")
    monkeypatch.setattr(C, "RANGE_ENTRIES", 700)
    monkeypatch.setattr(C, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(C, "BLOCK_ROWS", 5)
    assert by_id(substring_dedup.substring_dedup(docs), "n_words", "n_removed", "kept_sha256") == brute.substring(both)
    assert by_id(jaccard_join.jaccard_join(docs), "n_shingles", "component_id") == brute.components(both)
    got = by_id(lm_scoring.lm_scoring(docs), "n_known", "base_score", "score")
    assert all(got[d] == pytest.approx(whole[d], rel=1e-6) for d in whole)


def test_quality_rules(docs, rows):
    got = by_id(quality_rules.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t in rows:
        w, t = brute.words(t), t or ""
        five = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = len({k for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)})
        lines = [x for x in t.split("\n") if brute.words(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), repeated)
        assert got[d][:5] == want
        assert got[d][5] == (len(w) < 10 or 100 * repeated > 20 * len(w))
        assert not (got[d][5] and got[d][6])


def test_cascade_order_changes_no_verdict(rows):
    texts = [(t or "").encode() for _, t in rows]
    rules = quality_rules.default_rules()
    kept = [v is None for v in quality_rules.run_cascade(quality_rules.measured(texts), rules)]
    assert kept == [v is None for v in quality_rules.run_cascade(quality_rules.measured(texts), rules[::-1])]


def test_cascade_goes_by_what_is_left_and_what_rules_measure():
    """A rule that rejects only what an earlier one has rejected comes after one that rejects others; measuring counts as cost."""
    import time

    def taking(seconds, rejects):
        return lambda d: d.once(f"measure {seconds} {rejects}", lambda d: time.sleep(seconds)) or rejects(d)

    Rule = quality_rules.Rule
    rules = [Rule("slow", taking(0.01, lambda d: d.n_words < 9)), Rule("most", taking(0.001, lambda d: d.n_words < 8)), Rule("inside", taking(0.001, lambda d: d.n_words < 5)), Rule("others", taking(0.001, lambda d: d.n_words > 27))]
    texts = [b"w " * n for n in range(30)]
    assert quality_rules.order_of(texts, rules)[:2] == [1, 3] and quality_rules.order_of([], rules)


def test_cascade_without_counts_gives_the_same_verdicts(docs):
    a, b = (by_id(quality_rules.quality_rules(docs, counts=c), "n_words", "kept") for c in (True, False))
    assert a == b


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("name, keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piece_encoder(rows, name, keep_space, special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = not special
    assert t.get_added_tokens_decoder()
    rng = random.Random(1)
    own = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = [f"{a}{x}{b}" for x in [*own, *map(str.upper, own)] for a in ("", "hello ", "hello", "\n", "x  ") for b in ("", " world", "world", x, "\x1c")] + [t or "" for _, t in rows] + ["".join(rng.choice("ab'sS1 !?é\n\n  \t\r É.T$\x1cΣ") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    e = PieceEncoder(public_tokenizers.path(name), keep_space, special)
    assert not e.whole
    got = e.encode(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_piece_encoder_falls_back_to_whole_texts(tmp_path, rows):
    """A tokenizer of another kind: cased, cut at white space, with an unknown word."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "Hello": 1, "hello": 2, "a": 3}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "words.json"))
    t.normalizer = normalizers.Replace("a", "hello")
    t.save(str(tmp_path / "replaced.json"))
    for name in ("words.json", "replaced.json"):
        texts = ["Hello a hello", "hello.Hello", "", "x"] + [t or "" for _, t in rows]
        own = Tokenizer.from_file(str(tmp_path / name))
        for keep_space in (True, False):
            e = PieceEncoder(str(tmp_path / name), keep_space)
            assert e.whole and e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in own.encode_batch(texts, add_special_tokens=False)]
    assert not PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True).whole and not PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), False).whole


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = C.shared_folder(spark)
    manifest = token_files.write_tokens(docs, folder, path, end_id=2)
    got = by_id(token_files.read_tokens(spark, folder, manifest, with_ids=True), "start", "n_tokens", "ids_crc32", "ids")
    t, at = Tokenizer.from_file(path), 0
    for d, text in sorted(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in rows}
    pieces = packing.pack(docs, path, length=256, keep_ids=True).collect()
    for d, ids in want.items():
        own = sorted((p for p in pieces if p["doc_id"] == d), key=lambda p: p["start"])
        assert [x for p in own for x in p["ids"]] == ids and [p["start"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in own)
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append(p)
    total = sum(map(len, want.values()))
    assert sorted(windows) == list(range(math.ceil(total / 256)))
    shares = collections.Counter()
    for p in pieces:
        shares[p["queue"]] += p["length"]
    for k, own in windows.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 256 or k == max(windows)
        if at == 256:  # the mixture holds in every window
            for q, n in shares.items():
                assert abs(sum(p["length"] for p in own if p["queue"] == q) - 256 * n / total) <= 4


@pytest.mark.parametrize("weights", [None, [1, 1, 1, 1, 1], [5, "0.5", 3, "0.25", 1]])
def test_schedule_is_deficit_round_robin(weights):
    """The closed form equals rounds served one by one, in which each queue keeps the part of a token that it was not served and dry queues leave their share."""
    from fractions import Fraction

    totals, length = [5, 300, 1, 77, 1000], 64
    w = [Fraction(x) for x in (weights or totals)]
    s = packing.Schedule(totals, length, w if weights else None)
    earned, served, windows, at = [Fraction(0)] * 5, [0] * 5, collections.defaultdict(list), 0
    for r in range(math.ceil(sum(totals) / length)):
        left = Fraction(min(length, sum(totals) - r * length))
        while left:
            alive = [i for i in range(5) if earned[i] < totals[i]]
            quantum = left / sum(w[i] for i in alive)
            step = min([quantum] + [(totals[i] - earned[i]) / w[i] for i in alive])
            for i in alive:
                earned[i] += step * w[i]
            left -= step * sum(w[i] for i in alive)
        for i in range(5):
            take = min(totals[i], math.floor(earned[i] + Fraction(1, 2))) - served[i]
            for k in range(take):
                windows[at // length].append((i, served[i] + k))
                at += 1
            served[i] += take
            assert take >= 0 and abs(earned[i] - served[i]) <= 1
    got = collections.defaultdict(dict)
    for i, total in enumerate(totals):
        start = 0
        while start < total:  # documents of 7 tokens
            n = min(7, total - start)
            pieces = list(s.cuts(i, start, n))
            assert sum(size for *_, size in pieces) == n
            for window, offset, position, size in pieces:
                for k in range(size):
                    got[window][offset + k] = (i, start + position + k)
            start += n
    assert {k: [x for _, x in sorted(v.items())] for k, v in got.items()} == windows
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_packing_to_targets(spark, rows):
    """Windows hold the targets until a queue is empty; null and rare sources too; the smallest sources share a queue."""
    path = public_tokenizers.path("word_bpe_49k.json")
    many = [(d, f"{t or ''} words of our own " * 8) for d, t in rows]
    docs = make(spark, many)
    pieces = packing.pack(docs, path, length=64, targets={"s1": 6, None: "1.5", "s2": 2, "absent": 4}).collect()
    source = {d: None if d % 5 == 0 else f"s{d % 3}" for d, _ in many}
    totals, windows = collections.Counter(), collections.defaultdict(collections.Counter)
    for p in pieces:
        totals[source[p["doc_id"]]] += p["length"]
        windows[p["sequence_id"]][source[p["doc_id"]]] += p["length"]
    weights = {"s1": 6, None: 1.5, "s2": 2, "s0": totals["s0"] / sum(totals.values())}
    ends = min(sum(totals.values()) * totals[q] / (weights[q] / sum(weights.values())) / sum(totals.values()) for q in weights)
    full = int(ends // 64) - 1
    assert full > 5
    for k in range(full):
        for q, w in weights.items():
            assert abs(windows[k][q] - 64 * w / sum(weights.values())) <= 4
    assert all(sum(windows[k].values()) == 64 for k in range(max(windows)))


def test_packing_with_more_sources_than_queues(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 3)
    test_packing_covers(spark, rows)


def test_packing_covers(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(make(spark, rows), path, length=128).collect()
    places = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = 0
    for window, offset, n in places:
        assert window * 128 + offset == at and offset + n <= 128
        at += n


def test_transducer_is_sentencepiece(rows):
    spm = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = spm.SentencePieceProcessor(model_file=path), piece_fst.Transducer(path)
    rng = random.Random(2)
    texts = [t or "" for _, t in rows] + ["".join(rng.choice("ab'sStheing1 !?é\n  \tÉ.T▁日本😀") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["<s> hi <0x41>", " " * 40]
    for t in texts:
        ids = np.frombuffer(m.encode(t), "<u4")
        assert ids.tolist() == sp.encode(t)
        assert m.decode(ids) == sp.decode(ids.tolist())


def test_encode_and_decode(spark, docs, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = piece_fst.encode(docs, path, keep_ids=True)
    assert all(by_id(out, "round_trip").values())
    assert by_id(piece_fst.decode(out, path), "text") == {d: t or "" for d, t in rows}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(800):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(15, 60))]
        toxic, bad = d % 6 == 0, d % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zork", "blarg", "idiot"]))
        if bad:
            w = [x + rng.choice(["***", "&&&"]) for x in w]
        rows.append((d, " ".join(w)))
        labels.append((d, 0 if bad else 1, int(toxic), "extra"))
    labels += [(None, 1, 1, ""), (3, None, None, ""), (10**9, 1, 1, "")]
    return make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity(labelled):
    docs, labels = labelled
    got = by_id(toxicity.toxicity(docs, toxicity.fit(docs, labels)), "held_out", "score", "predicted")
    unseen = [(d % 6 == 0, p) for d, (held, _, p) in got.items() if held]
    assert sum(bool(p) == t for t, p in unseen) / len(unseen) > 0.97
    assert all(0 <= s <= 1 and p == (s >= 0.3) and h == (brute.fold(d, 4) == 2) for d, (h, s, p) in got.items())


def test_quality_fm(labelled):
    docs, labels = labelled
    got = by_id(quality_fm.quality(docs, quality_fm.fit(docs, labels)), "held_out", "score", "predicted")
    unseen = [(d % 5 != 0, p) for d, (held, _, p) in got.items() if held]
    assert sum(bool(p) == t for t, p in unseen) / len(unseen) > 0.97
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got.values())


def test_machine_equals_its_definition():
    rng = np.random.default_rng(4)
    m = quality_fm.Machine([], 0.3, rng.normal(size=6), rng.normal(size=(6, 3)), np.empty(0), np.empty(0))
    x = np.array([0.5, 0, 2.0, -1.0, 0, 1.5])
    on = np.flatnonzero(x)
    want = 0.3 + m.weights @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(6) for j in range(i + 1, 6))
    assert m.raw(on, x[on], np.array([0]))[0] == pytest.approx(want)


def test_isotonic_is_monotone():
    at, value = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(value) >= 0).all() and np.interp(0.9, at, value) == 1 and np.interp(0.1, at, value) == 0


OPERATORS = {
    "exact_dedup": lambda df: exact_dedup.exact_dedup(df),
    "substring_dedup": lambda df: substring_dedup.substring_dedup(df),
    "jaccard_join": lambda df: jaccard_join.jaccard_join(df),
    "lm_scoring": lambda df: lm_scoring.lm_scoring(df),
    "quality_rules": lambda df: quality_rules.quality_rules(df),
    "packing": lambda df: packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct(),
    "piece_fst": lambda df: piece_fst.encode(df, public_tokenizers.path("piece_bpe_32k.model")),
    "token_files": lambda df: token_files.read_tokens(df.sparkSession, *(lambda f: (f, token_files.write_tokens(df, f, public_tokenizers.path("byte_bpe_50k.json"), 2)))(C.shared_folder(df.sparkSession))),
    "toxicity": lambda df: toxicity.toxicity(df, toxicity.fit(df, df.sparkSession.createDataFrame([], "doc_id long, toxic int"))),
    "quality_fm": lambda df: quality_fm.quality(df, quality_fm.fit(df, df.sparkSession.createDataFrame([], "doc_id long, quality int"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_and_repeated_rows(spark, name):
    rows = [(None, "a text without an id"), (None, None), (7, "same text here"), (7, "same text here"), (2**60 + 1, ""), (8, None)]
    got = collections.Counter(r["doc_id"] for r in OPERATORS[name](make(spark, rows)).collect())
    assert set(got) == {None, 7, 8, 2**60 + 1}
    if name != "packing":
        assert got == {None: 2, 7: 2, 8: 1, 2**60 + 1: 1}


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n in (0, 1, 30, 500, 2047, 2049, 3000, 9000, 20_000):
        for change in (0, 1, n // 9, n):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**64, change, dtype=np.uint64)]))
            both, either = jaccard_join.similar(a, b)
            far = jaccard_join.distances([jaccard_join.sketch(a)], [jaccard_join.sketch(b)])[0]
            assert far <= either - both
            if change == n and n >= 500:  # sets of unrelated texts don't pass
                assert 180 * far > 20 * (len(a) + len(b))


def test_jaccard_join_of_large_sets_in_tiles_and_ranges(spark, monkeypatch):
    """Families of copies of copies with 1500 to 5000 shingles, many components, keys in several ranges and tiles; texts of more bytes than a block."""
    monkeypatch.setattr(C, "RANGE_ENTRIES", 3000)
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    monkeypatch.setattr(jaccard_join, "SLICE", 3)
    monkeypatch.setattr(C, "BLOCK_BYTES", 30_000)
    rng = random.Random(12)
    out = []
    for n in (1500, 2050, 5000):
        base = [f"v{rng.randrange(4000)}" for _ in range(n)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.choice([1, 12, 25, 60]) * n // 1500):
                w[rng.randrange(n)] = f"z{rng.randrange(9000)}"
            out.append(" ".join(w))
            if rng.random() < 0.4:
                base = w
        out += [out[-1], " ".join(f"v{rng.randrange(4000)}" for _ in range(n))]
    rows = list(enumerate(out, 100))
    got = by_id(jaccard_join.jaccard_join(make(spark, rows, 4)), "n_shingles", "component_id")
    want = brute.components(rows)
    assert got == want and 6 < len({c for _, c in want.values()}) < len(rows) - 3


def test_gathered_blocks_are_bounded_by_bytes_and_rows(monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 10)
    monkeypatch.setattr(C, "BLOCK_ROWS", 3)
    import pandas as pd

    pdf = pd.DataFrame({"doc_id": range(9), "text": [b"1234567", b"123", b"1", b"x" * 50, b"", b"", b"", b"", b"z"], "apart": [False] * 8 + [True]})
    assert [ids for ids, _ in C.gathered([pdf[:5], pdf[5:]], apart="apart")] == [[0, 1], [2], [3], [4, 5, 6], [7], [8]]


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_weights_of_pairs_are_those_of_the_definition():
    m = piece_fst.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    names = m._names
    short = [i for i, p in enumerate(names) if len(p) <= 3]
    for _ in range(20_000):
        a, b = rng.choice([rng.randrange(len(names)), rng.choice(short)]), rng.choice([rng.randrange(len(names)), rng.choice(short)])
        assert m.side_by_side(a, b) == (m.merged(names[a] + names[b]) == [names[a], names[b]]), (names[a], names[b])


def test_transducer_on_a_very_long_word():
    spm = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = spm.SentencePieceProcessor(model_file=path), piece_fst.Transducer(path)
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "aab", "0123456789abcdefé日"):
        word = "".join(rng.choice(letters) for _ in range(100_000))
        assert np.frombuffer(m.encode(word), "<u4").tolist() == sp.encode(word)


def test_transducer_with_a_character_map(tmp_path):
    """The public model's pieces behind a normaliser that composes, folds and squeezes."""
    spm = pytest.importorskip("sentencepiece")
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    fields, kept, i = list(piece_fst._fields(model)), b"", 0
    for number, value in fields:
        if number != 3:
            kept += _varint(number << 3 | 2) + _varint(len(value)) + value
    for rule in ("nmt_nfkc", "nmt_nfkc_cf"):
        spec = spm.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        own = b"".join(_varint(n << 3 | 2) + _varint(len(v)) + v for n, v in piece_fst._fields(spec) if n in (1, 2)) + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1])
        path = tmp_path / f"{rule}.model"
        path.write_bytes(kept + _varint(3 << 3 | 2) + _varint(len(own)) + own)
        sp, m = spm.SentencePieceProcessor(model_file=str(path)), piece_fst.Transducer(str(path))
        rng = random.Random(5)
        texts = ["  Ａｂｃ  ﬁne x ", "été ½ ① ｶﾞ ​", "", " ", "ẞß Straße"]
        texts += ["".join(rng.choice("aAé́ 　ﬁ①½Ａ­ß\tßķｶﾞ‍日") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
        for t in texts:
            assert np.frombuffer(m.encode(t), "<u4").tolist() == sp.encode(t), (rule, t)


def test_user_defined_pieces_are_refused(tmp_path):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    piece = b"\x0a\x05<sep>\x15\x00\x00\x00\x00\x18"  # its text, a score of 0 and its kind
    for kind, fine in ((3, True), (4, False)):
        own = piece + bytes([kind])
        path = tmp_path / f"{kind}.model"
        path.write_bytes(model + b"\x0a" + bytes([len(own)]) + own)
        if fine:
            piece_fst.Transducer(str(path))
        else:
            with pytest.raises(ValueError):
                piece_fst.Transducer(str(path))


@pytest.mark.parametrize("ranges", [1, 3, 1000])
def test_range_starts(ranges):
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 500, dtype=np.uint64))
    at = C.range_starts(keys, ranges)
    assert len(at) == ranges + 1 and all(int(k) * ranges >> 64 == i for i in range(ranges) for k in keys[at[i] : at[i + 1]])
