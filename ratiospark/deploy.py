"""Brings this package to the executors' Python, wherever they were started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: Spark hands a zip of the package to every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="ratiospark-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "ratiospark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shipped(query):
    """A query (spark, sf_dir) that ships the package first."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
