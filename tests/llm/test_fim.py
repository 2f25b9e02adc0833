"""Fill-in-the-middle against a plain version, on texts made to be awkward."""

import hashlib
import random
import re

import pytest

fim = pytest.importorskip("skein.llm.fim")
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id long, text string, units string, h string, form int, p string, n string"


def plain(doc, text, seed=1, arranged=90, spm=20):
    """(n, form, prefix, middle, output) of a document."""
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= arranged:
        return n, "plain", None, None, t
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def rows():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "\n", "<P>", "x <S> y", "tail <M>", "<", "<P", "P>", "<<>>", "<p>", "<P >", "A<", ">B", "a\r\nb\x00c d", "Ünï çödé 日本 😀👍🏽 é", "w" * 70000, "ab 😀 " * 20000]
    texts += ["".join(rng.choice(["ab", "Z", " ", "\n", "<", ">", "P", "S", "M", "<S", "é", "😀", "9", "$1", "\\"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    ids = [None, 0, -5, (1 << 63) - 1, *range(7, 7 + len(texts) - 4)]
    return [*zip(ids, texts), (9, "again and again"), (9, "again and again"), (None, "no id here")]


@pytest.mark.parametrize("settings", [{}, {"seed": 7, "arranged": 100, "spm": 50}])
def test_forms_cuts_and_texts(spark, settings):
    own = rows()
    df = spark.createDataFrame([(d, t, "x", "y", 1, "z", "n") for d, t in own], SCHEMA).repartition(3)
    got = fim.restore(fim.fill_in_middle(df, **settings)).collect()
    want = sorted((str((d, t or "", *plain(d, t, **settings))) for d, t in own))
    seen = []
    for r in got:
        n, form, p, m, out = plain(r["doc_id"], r["text"], **settings)
        assert (r["n"], r["form"], r["output"], r["restored"]) == (n, form, out, r["text"])
        assert (r["prefix_chars"], r["middle_chars"]) == (p if p is None else len(p), m if m is None else len(m))
        seen.append(str((r["doc_id"], r["text"], n, form, p, m, out)))
    assert sorted(seen) == want and len({plain(d, t, **settings)[1] for d, t in own}) == 3


def test_outputs_of_another_form_are_not_read(spark):
    df = spark.createDataFrame([("<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("<S>b<P>a<M>c", "spm"), ("abc", "psm"), ("<P>a<S>b<M>c", "plain"), ("<P><S><M>", "psm"), (None, "psm")], "o string, f string")
    assert [r[0] for r in df.select(fim.restored(F.col("o"), F.col("f"))).collect()] == ["acb", None, "acb", None, "<P>a<S>b<M>c", "", None]


def test_no_shuffle_and_no_python(spark):
    plan = fim.restore(fim.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string").repartition(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1


def test_empty_table(spark):
    assert fim.restore(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
