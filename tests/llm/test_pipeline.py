"""The pipeline: each stage on all that its predecessor kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    out = [("documents", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.C.written(f(spark, docs, "/root/testdata/sf0.001"))
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for name in ("toxicity", "exact_dedup", "near_dedup", "substring_dedup"):
        assert tuple(stages[name].columns) == corpus_pipeline.COLUMNS


def test_toxic_documents_go(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    left = texts(stages["toxicity"])
    toxic = [d for d, t in labels.items() if t]
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in left for d in toxic) <= 0.3 * len(toxic) and sum(d in left for d in clean) >= 0.9 * len(clean)


def test_exact_stage(stages):
    before = texts(stages["toxicity"])
    groups = brute.exact(before.items())
    assert set(texts(stages["exact_dedup"])) == {d for d in before if groups[d][0] == d}


def test_near_stage(stages):
    before = texts(stages["exact_dedup"])
    component = brute.components(before.items())
    assert set(texts(stages["near_dedup"])) == {d for d in before if component[d][1] == d}


def test_substring_stage(stages):
    before, after = texts(stages["near_dedup"]), texts(stages["substring_dedup"])
    want = brute.substring(before.items())
    for d, (n, removed, sha) in want.items():
        if removed == n and n:
            assert d not in after
        elif removed:
            assert brute.hashlib.sha256(after[d].encode()).hexdigest() == sha
        else:
            assert after[d] == before[d]


def test_packing_stage(stages):
    packed = {r["doc_id"] for r in stages["packing"].select("doc_id").distinct().collect()}
    assert packed == set(texts(stages["substring_dedup"]))
