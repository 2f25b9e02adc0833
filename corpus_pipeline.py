"""A corpus pipeline over documents: toxicity, exact dedup, near-duplicate dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs. All stages but the last return the columns of documents; n_chars
follows a text that was cut. Stages decide by row: rows without an id or with the same id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common as C
from skein.llm.exact_dedup import exact_dedup
from skein.llm.jaccard_join import jaccard_join
from skein.llm.packing import pack
from skein.llm.substring_dedup import find_spans
from skein.llm.toxicity import fit, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, which tells rows apart and is ordered as doc_id: doc_id itself where it does, else the row's place by doc_id (nulls first), written once."""
    docs = docs.select(*COLUMNS)
    n, ids = docs.select(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.withColumn("row_key", F.col("doc_id").cast("long"))
    return C.written(docs.orderBy("doc_id").withColumn("row_key", F.monotonically_increasing_id()))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Keyed docs without the rows of dropped (doc_id: a row key); few such keys are broadcast, by count, many are joined by shuffle."""
    dropped = C.written(dropped.select(F.col("doc_id").alias("row_key")).distinct())
    return docs.join(C.checked(dropped), "row_key", "left_anti").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = _keyed(docs)
    return _without(docs, toxicity(docs, fit(docs, labels), id_col="row_key").where("predicted = 1"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    return _without(docs, exact_dedup(docs, id_col="row_key").where("NOT kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    return _without(docs, jaccard_join(docs, id_col="row_key").where("component_id <> doc_id"))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose words get their kept words, joined by one space; one that loses all goes. The others' texts are left as they are."""
    found = find_spans(_keyed(docs), id_col="row_key", carry=("doc_id", "lang", "source", "n_chars"), originals=True)
    text = F.decode("kept_text", "UTF-8")
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("carried.n_chars").cast("long"))
    whole = found.where("n_removed = 0 OR octet_length(kept_text) > 0")
    return whole.select("carried.doc_id", text.alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: Boosted trees and byte-pair tokens aren't SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir))
    return docs
