"""Exact deduplication by content sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, partitions, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int | None = None, prefix_chars: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. Sampled splitters range-partition the normalised texts
    (by their first prefix_chars characters, then their 64-bit hash, so that splitters stay small and a common beginning
    doesn't fill one partition); Spark's external sort puts equal texts next to each other, and the window's group
    boundaries compare whole neighbouring texts. Whole texts are shuffled once.

    A text with more than hot_rows copies (a share of the rows, so that only a few per partition exist) is sorted as several
    salted runs; their heads, few and compared in full, are then merged.

    Null texts count as empty. A null id is a value that sorts last. Of rows that agree in length and id one is kept. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("doc_id", F.length("t").cast("long").alias("n"), F.regexp_replace("t", SPACE + "+", "").alias("norm"))
    base = base.withColumn("h", F.xxhash64("norm"))
    n_parts = partitions(spark)
    limit = hot_rows or max(64, math.ceil(docs.count() / (4 * n_parts)))
    # at most rows / limit keys, that is four per partition
    hot = base.groupBy("h").count().filter(F.col("count") > limit).select("h", F.ceil(F.col("count") / limit).cast("int").alias("runs"))
    keyed = base.join(F.broadcast(hot), "h", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("runs")).cast("int")).withColumn("prefix", F.substring("norm", 1, prefix_chars))
    ranged = keyed.repartitionByRange(n_parts, "prefix", "h", "salt")
    run = Window.partitionBy("prefix", "h", "salt", "norm").orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "doc_id", "salt", "norm",
        F.row_number().over(run).alias("at"), F.first("doc_id").over(whole).alias("head"), F.first("n").over(whole).alias("head_n"), F.count(F.lit(1)).over(whole).alias("size"),
    )
    runs = runs.select("doc_id", "salt", F.sha2("norm", 256).alias("sha"), (F.col("at") == 1).alias("first"), "head", "head_n", "size", F.when((F.col("at") == 1) & F.col("salt").isNotNull(), F.col("norm")).alias("head_text"))
    runs = written(runs, "exact-dedup")
    group = Window.partitionBy("head_text").orderBy(F.desc("head_n"), F.asc_nulls_last("head"), "salt")
    all_runs = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # two rows per hot_rows rows at most
    merged = runs.filter(F.col("head_text").isNotNull()).select(
        "sha", "salt", F.first("head").over(all_runs).alias("hot_keep"), F.first("salt").over(all_runs).alias("hot_salt"), F.sum("size").over(all_runs).alias("hot_size")
    )
    out = runs.drop("head_text").join(F.broadcast(merged), ["sha", "salt"], "left")
    is_hot = F.col("salt").isNotNull()
    return out.select(
        "doc_id",
        F.when(is_hot, F.col("hot_keep")).otherwise(F.col("head")).alias("keep_id"),
        F.when(is_hot, F.col("hot_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("first") & (~is_hot | (F.col("salt") == F.col("hot_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
