"""Findings of round 4: names are taken apart once and only where they may hold a word, gates and neighbours read few edges, pairs of lines move as lists."""

import random

from pyspark.sql import functions as F

from skein.functions import identifiers as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NODE = "id long, corpus string, path string, signature string, kind string, line int, end_line int, test_role int"


def test_names_are_taken_apart_as_before(spark):
    from skein.operators import cascade

    draw = random.Random(4)
    names = ["".join(draw.choice("abAB01_.:# é\n") for _ in range(draw.randrange(14))) for _ in range(600)] + [None, "", ":", "a:b.c.", "x"]
    n = spark.createDataFrame([(i, "c", "p", s, "function", 1, 2, 0) for i, s in enumerate(names)], NODE)
    c = F.col("signature")
    t = cascade.taken_apart(n).withColumns({"s": I.raw_segments(c), "b": cascade.plain(F.regexp_replace(c, "^[^:]*:", "")), "l": cascade.plain(I.leaf_of(c))})
    own = F.col("segments").eqNullSafe(F.col("s")) & F.col("body").eqNullSafe(F.col("b")) & F.col("leaf").eqNullSafe(F.col("l"))
    for a, b in ((I.index_tokens(c), I.index_tokens(c, raw=F.col("segments"))), (I.index_terms(c), I.index_terms(c, F.col("segments")))):
        own &= a.eqNullSafe(b)
    assert t.count() == len(names) and t.where(~own).count() == 0


def test_vocabulary_of_a_misspelling_is_what_may_be_meant(spark, monkeypatch):
    """All tokens that are as similar are there, and names that hold none of its last trigrams are not."""
    from skein.operators import cascade
    from skein.plans.retrieval import similar_tokens

    draw = random.Random(6)
    made = ["".join(draw.choice("abc") for _ in range(draw.randrange(3, 9))) for _ in range(400)]
    nodes = cascade.taken_apart(spark.createDataFrame([(i, "c", "p", f"fn:{w}_{made[-i]}", "function", 1, 2, 0) for i, w in enumerate(made)] + [(-i, "c", "p", f"fn:order_{i}", "function", 1, 2, 0) for i in range(500)], NODE))
    words = spark.createDataFrame([(w,) for w in {*made[:30], "ordrs", "aaaa"}], "q string")
    every = nodes.select(F.col("leaf").alias("token")).union(nodes.select(F.explode("segments"))).distinct()
    want = {tuple(r) for r in similar_tokens(words, every, 0.7).collect()}
    for few in (cascade.FEW, 2):
        monkeypatch.setattr(cascade, "FEW", few)
        kept = cascade._like(nodes, words, 0.7)
        assert {tuple(r) for r in similar_tokens(words, kept, 0.7).collect()} == want and want
        assert (kept.where("token LIKE 'order%'").count() == 0) == (few > 2)
    assert cascade._like(nodes, words.limit(0), 0.7).count() == 0


def test_carriers_move_no_node(spark):
    from skein.operators import cascade

    nodes = cascade.taken_apart(spark.createDataFrame([(1, "c", "red/a.ts", "fn:redRing", "function", 1, 2, 0), (2, "c", "red/a.ts", "fn:bigRing.x", "function", 1, 2, 0), (3, None, None, None, None, None, None, None)], NODE))
    got = cascade._carriers(nodes, spark.createDataFrame([("red",), ("bigring",), ("ring",), ("none",)], "form string"))
    assert sorted((r["form"], r["id"], r["word"], r["rank"], r["at"] is not None) for r in got.collect()) == [("bigring", 2, False, 1, True), ("red", 1, True, 1, True), ("red", 2, False, 2, False), ("ring", 1, True, 2, True), ("ring", 2, True, 2, True)]
    assert "hashpartitioning" not in plan(got)


def test_gates_filter_edges_before_repeated_ones_are_told(spark, monkeypatch):
    """Repeated edges are told apart among those at seeds alone."""
    from skein.operators import cascade, seeding

    plans = []
    for m in (cascade, seeding):
        monkeypatch.setattr(m, "written", lambda df, keep=m.written: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df))
    nodes = spark.createDataFrame([(i, "c", f"p/{i}.go", "fn:alpha" if i == 0 else f"fn:beta{i}", "function", 1, 2, 0) for i in range(9)], NODE)
    edges = spark.range(99).select((F.col("id") % 9).alias("src"), (F.col("id") % 7).alias("dst")).distinct()
    cascade.Cascade(spark.createDataFrame([(1, "alpha")], "q long, query string"), nodes).seeds(edges).collect()
    own = next(p for c, p in plans if c == ["id", "beside"])
    assert own.index("Aggregate [src") < own.index("LeftSemi")  # below the distinct of the edges
    assert {r["id"] for r in seeding.apart(spark.createDataFrame([(0, 2.0), (1, 1.0), (8, 0.5)], "id long, score double"), spark.createDataFrame([(0, 1), (0, 1), (1, 8), (5, 6)], "src long, dst long")).collect()} == {0, 8}
    beats = next(p for c, p in plans if c == ["src", "dst"])
    assert beats.index("Aggregate") < beats.index("LeftSemi")


def test_edit_overlap_moves_lists(spark, monkeypatch):
    """A row for each place, span and list, and none for each node of a span, goes to where hunks are."""
    from skein.operators import joins

    monkeypatch.setattr(joins, "LISTED", 7, raising=False)
    hunks = spark.range(40).select(F.col("id").alias("hunk_id"), F.lit("p").alias("path"), (F.col("id") % 2).cast("int").alias("hunk_start"), F.lit(9).alias("hunk_end"))
    nodes = spark.range(100, 140).select("id", F.lit("p").alias("path"), F.lit(3).alias("line"), F.when(F.col("id") % 4 == 0, 8).otherwise(5).alias("end_line"))
    got = joins.edit_overlap(hunks, nodes)
    assert sorted(map(tuple, got.collect())) == [(h, i) for h in range(40) for i in range(100, 140) if i % 4]
    assert plan(got).count("Generate explode") >= 3 and "hunk_id: bigint, id: bigint" in str(got)
