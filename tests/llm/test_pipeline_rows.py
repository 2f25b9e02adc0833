"""The pipeline on rows whose ids are null or repeated."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LONG = " ".join(f"w{i}" for i in range(40))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_stage(spark):
    docs = frame(spark, [(5, "A"), (5, "B"), (9, "A"), (7, "C"), (7, "C"), (None, "D"), (None, "D"), (None, "A"), (None, "E")])
    assert kept(corpus_pipeline.exact_dedup_stage(spark, docs, "")) == sorted([(5, "B"), (9, "A"), (7, "C"), (None, "D"), (None, "E")], key=str)


def test_near_stage(spark):
    docs = frame(spark, [(3, LONG), (3, LONG + " x"), (None, LONG + " y"), (4, "quite another text " * 9), (3, "one more of the id three " * 9)])
    assert kept(corpus_pipeline.near_dedup_stage(spark, docs, "")) == sorted([(None, LONG + " y"), (4, "quite another text " * 9), (3, "one more of the id three " * 9)], key=str)


def test_substring_stage(spark):
    docs = frame(spark, [(1, LONG), (2, LONG + " a"), (2, LONG + " a"), (None, LONG + " b"), (2, LONG + " c")])
    got = corpus_pipeline.substring_dedup_stage(spark, docs, "").collect()
    assert len(got) <= 5 and sum(r["text"].count("w0 ") for r in got) == 1
    assert sorted((r["text"] for r in got if r["doc_id"] is None)) == [LONG + " b"]


def test_toxicity_stage(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(corpus_pipeline, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline, "toxicity", lambda docs, model, id_col="doc_id": docs.select(F.col(id_col).alias("doc_id"), F.col("text").contains("bad").cast("int").alias("predicted")))
    docs = frame(spark, [(None, "bad"), (None, "good"), (1, "bad"), (1, "good")])
    assert kept(corpus_pipeline.toxicity_stage(spark, docs, "/root/testdata/sf0.001")) == sorted([(None, "good"), (1, "good")], key=str)
