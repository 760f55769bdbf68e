"""Batch job: solves one exact linear system for each key of a table and reports which have one solution, many or none.

    python -m jobs.solve_systems --config jobs/solve_systems.json --input TABLES --output OUT

Each row of the table adds its value to a coefficient and its constant to the right side. Coefficients without rows are zero, so that many
systems are singular; these are told apart exactly, which floating point can't. Every unique solution is put into its equations again
before anything counts as written. Output: solutions by status, and a summary."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiospark.operators.matrix import MatrixFrame
from ratiospark.operators.systems import residuals, solve
from ratiospark.sources.builders import from_sparse

from .common import command_line

log = logging.getLogger("solve_systems")

SOLUTIONS = "matrix_id long, rank int, j int, num string, den string, value double, status string"
SUMMARY = "status string, systems long"


def systems(rows: DataFrame, config: dict) -> MatrixFrame:
    """Augmented matrices of config's size from rows of the table. Rows with a null in any of the expressions don't count."""
    size = config["size"]
    given = rows.select(*[F.expr(config[c]).cast("long").alias(c) for c in ("matrix_id", "row", "column", "value", "constant")]).dropna()
    parts = F.array(F.struct(F.col("column").alias("j"), F.col("value").alias("v")), F.struct(F.lit(size).cast("long").alias("j"), F.col("constant").alias("v")))
    cells = given.select("matrix_id", "row", F.inline(parts))
    return from_sparse(cells, F.col("matrix_id"), F.col("row"), F.col("j"), F.col("v"), size, size + 1, size)


def run(spark: SparkSession, config: dict, input: str, output: str) -> dict:
    """Reads input/table, writes output/solutions (by status) and output/summary, whole and anew each time. Returns what was read and
    written. A solution that misses an equation raises an error. An empty table gives empty outputs."""
    rows = spark.read.parquet(f"{input}/{config['table']}")
    frame = systems(rows, config)
    solutions = solve(frame)
    path = f"{output}/solutions"
    dealt = solutions.select(*[c.split()[0] for c in SOLUTIONS.split(", ")]).repartition(int(config.get("files", 8)), "matrix_id")
    dealt.write.mode("overwrite").partitionBy("status").parquet(path)
    written = spark.read.schema(SOLUTIONS).parquet(path)
    wrong = residuals(frame, written).agg(F.sum("wrong")).first()[0] or 0
    if wrong:
        raise ValueError(f"{wrong} equations are missed by their solutions in {path}")
    written.groupBy("status").agg(F.countDistinct("matrix_id").alias("systems")).coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")
    counts = {r["status"]: r["systems"] for r in spark.read.schema(SUMMARY).parquet(f"{output}/summary").collect()}  # three rows at most
    found = {"rows": rows.count(), "systems": sum(counts.values()), **counts}
    log.info("read %d rows of %s; wrote %s to %s", found["rows"], config["table"], counts, output)
    return found


def result(spark: SparkSession, output: str) -> DataFrame:
    """The solutions as they stand."""
    return spark.read.schema(SOLUTIONS).parquet(f"{output}/solutions")


if __name__ == "__main__":
    command_line(run, ["input", "output"], "exact solutions of many linear systems")
