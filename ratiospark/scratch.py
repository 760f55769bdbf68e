"""Folders for intermediate tables, which the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses in the folder of spark.checkpoint.dir; in local mode without that setting, in a temporary one of this process."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="ratiospark-")
        atexit.register(shutil.rmtree, given, ignore_errors=True)
        given = f"file://{given}"
    return f"{given.rstrip('/')}/ratiospark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, which ends its lineage."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
