"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing and sharding of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratiospark.llm.common import table, written
from ratiospark.llm.decontamination import drop_contaminated
from ratiospark.llm.mixing import mix_documents, quality_weight
from ratiospark.llm.sharding import shard_documents
from ratiospark.llm.simhash import drop_near_duplicates
from ratiospark.llm.toxicity import drop_toxic


# Every stage takes all rows of the one before, whole texts, and gives the same columns; rows may have null or repeated ids, and extra
# columns pass through. An empty table stays empty.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model, fitted on labels, finds toxic. A row is judged by its text alone, so repeated rows and equal texts go or
    stay together; null counts as empty, which goes only if the model finds an empty text toxic; without labels nothing goes."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, by SimHash or by 5-word similarity of 0.8 or more: the one with the smallest id, of
    equal ids one. Null and empty texts are copies of each other, so that one of them stays; null ids come last."""
    return drop_near_duplicates(docs, similar=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item. Null and empty texts stay; repeated rows go or stay together; an empty benchmark
    drops nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target shares; good documents sooner than others. Null sources are one source,
    the last; texts without words count nothing and go with the cell they fall in; ties are broken by id and text, so that reruns agree."""
    return mix_documents(docs, weight=quality_weight(docs, table(spark, sf_dir, "labels")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's shard, in place of a column of that name. Equal texts go to one shard unless they exceed half of it; null counts as
    empty."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL expresses neither the model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table through all stages, each written down and read again, so that lost executors cost no more than a stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
