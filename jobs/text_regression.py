"""Incremental job: exact least squares over a growing folder of documents, one model for each group.

    python -m jobs.text_regression --config jobs/text_regression.json --input DOCS --output OUT --checkpoint CHECKPOINT

What a user plans a corpus with (bytes by words and lines of each source, say) is fitted exactly: the normal equations are sums of whole
numbers, so they can be kept over a stream without a rounding error, and are solved in rationals.

A run takes the files that are new since the checkpoint, in batches. Each batch adds its sums to the totals before it and writes them as
the partition of its number; a batch that runs again, after a failure, writes the same partition anew. Then the models are solved from the
newest totals and written by group. A run without new files writes the same models again."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratiospark.operators.matrix import ID, MatrixFrame
from ratiospark.operators.systems import solve
from ratiospark.streaming.gram import gram_sums, mirrored

from .common import command_line, make_table, write_partitions

log = logging.getLogger("text_regression")

TOTALS = "grp string, n long, gram array<struct<i:int,j:int,val:decimal(38,0)>>, version long"
MODELS = "feature string, num string, den string, value double, rank int, status string, n long, grp string"


def _columns(config: dict) -> list[Column]:
    """Features, then the target, as whole numbers of up to 18 digits; one that isn't a number (null) raises an error when summed up."""
    whole = lambda e: F.coalesce(F.expr(e).cast("decimal(18,0)"), F.raise_error(F.lit(f"{e} is null")).cast("decimal(18,0)"))
    return [whole(e) for e in [*config["features"].values(), config["target"]]]


def _newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The totals of the newest batch, or of the newest before one."""
    totals = spark.read.schema(TOTALS).parquet(path)
    if before is not None:
        totals = totals.filter(F.col("version") < before)
    version = totals.agg(F.max("version")).first()[0]
    return totals.filter(F.col("version") == F.lit(-1 if version is None else version))


def _added(batch: DataFrame, old: DataFrame, config: dict) -> DataFrame:
    """Totals with the sums of a batch; one row a group."""
    columns = _columns(config)
    rows = batch.select(F.expr(config["group"]).cast("string").alias("grp"), *[c.alias(f"x{k}") for k, c in enumerate(columns)], F.lit(1).cast("decimal(18,0)").alias("one"))
    new = gram_sums([F.col("grp")], rows, [F.col(f"x{k}") for k in range(len(columns))] + [F.col("one")])
    last = len(columns)  # the sum of one * one counts the rows
    counted = F.get(F.filter("gram", lambda c: (c["i"] == last) & (c["j"] == last)), F.lit(0))["val"].cast("long")
    kept = F.transform(F.filter("gram", lambda c: c["j"] < last), lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), c["val"].cast("decimal(38,0)").alias("val")))
    parts = new.select("grp", counted.alias("n"), kept.alias("gram")).unionByName(old.select("grp", "n", "gram"))
    pairs = [(i, j) for i in range(last) for j in range(i, last)]
    cell = lambda i, j: F.get(F.filter("gram", lambda c: (c["i"] == i) & (c["j"] == j)), F.lit(0))["val"]
    sums = parts.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(cell(i, j)).cast("decimal(38,0)").alias(f"s{k}") for k, (i, j) in enumerate(pairs)])
    return sums.select("grp", "n", F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{k}").alias("val")) for k, (i, j) in enumerate(pairs)]).alias("gram"))


def models(totals: DataFrame, features: list[str]) -> DataFrame:
    """totals (grp, n, gram) -> MODELS: the coefficients of each group, or one row without any where the equations leave them open."""
    size = len(features)
    keyed = totals.withColumn(ID, F.xxhash64("grp"))
    cells = keyed.select(ID, F.inline(mirrored(F.col("gram")))).filter(F.col("i") < size)
    head = keyed.select(ID, F.lit(size).alias("n_rows"), F.lit(size + 1).alias("n_cols"), F.lit(size).alias("augment"))
    solved = solve(MatrixFrame(cells, head))
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("j"))
    return solved.join(keyed.select(ID, "grp", "n"), ID).select(name.alias("feature"), "num", "den", "value", "rank", "status", "n", "grp")


def run(spark: SparkSession, config: dict, input: str, output: str, checkpoint: str) -> dict:
    """Takes what is new in input (a folder or glob of Parquet files) and brings output/models up to date. Returns what was read and written.

    A null group is a group; null and empty texts count as empty by the config's expressions; repeated rows count as often as they stand;
    extra columns don't matter. An empty input gives no models."""
    totals, out = f"{output}/totals", f"{output}/models"
    make_table(spark, totals, TOTALS, "version")
    make_table(spark, out, MODELS, "grp")
    schema = spark.read.parquet(input).schema
    read = {"batches": 0, "rows": 0}

    def take(batch: DataFrame, number: int) -> None:
        before = _newest(spark, totals, number)
        write_partitions(_added(batch, before, config).withColumn("version", F.lit(number).cast("long")), totals, "version")
        read["batches"] += 1
        log.info("batch %d of %s added to %s", number, input, totals)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(config.get("max_files_per_batch", 1000))).parquet(input)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read["rows"] = sum(p["numInputRows"] for p in query.recentProgress)
    newest = _newest(spark, totals)
    write_partitions(models(newest, list(config["features"])), out, "grp")
    written = spark.read.schema(MODELS).parquet(out)
    read |= {"groups": written.select("grp").distinct().count(), "documents": newest.agg(F.sum("n")).first()[0] or 0}
    log.info("read %(rows)d rows in %(batches)d batches; models of %(groups)d groups over %(documents)d documents", read)
    return read


def result(spark: SparkSession, output: str) -> DataFrame:
    """The models as they stand. Partition values are read as text."""
    return spark.read.schema(T._parse_datatype_string(MODELS)).parquet(f"{output}/models")


if __name__ == "__main__":
    command_line(run, ["input", "output", "checkpoint"], "exact least squares over growing documents")
