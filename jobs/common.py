"""What the jobs share: configs, the command line, folders."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object from a file that Spark can reach."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def make_table(spark: SparkSession, path: str, schema: str, by: str) -> None:
    """Makes an empty partitioned table where none is yet."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(by).parquet(path)


def command_line(job: Callable[..., dict], folders: list[str], description: str) -> None:
    """Runs job(spark, config, *folders) in a session of its own."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", required=True, help="a JSON file")
    for name in folders:
        parser.add_argument(f"--{name}", required=True, help="a path or glob that Spark reads")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        from ratiospark.deploy import ship

        ship(spark)
        job(spark, read_config(spark, given.config), *[getattr(given, name) for name in folders])
    finally:
        spark.stop()
