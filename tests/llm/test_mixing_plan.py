"""The exploded sides of a mix are not judged by the small tables that they come from."""

from skein.llm.mixing import mix


def test_blocks_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "w " * (40 + i), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    plan = mix(docs, shard=64).spans._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line and ("block" in line or "number" in line)]
    assert len(joins) >= 2 and all("SortMergeJoin" in line for line in joins)
