"""A Gram matrix kept over a stream of rows: the aggregate is distributive, so Spark's state holds one row of sums for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram_sums(keys: list[Column], rows: DataFrame, columns: list[Column]) -> DataFrame:
    """The keys, and gram: an array of (i, j, val) with i <= j, for each key's sum over rows of columns[i] * columns[j]. One aggregation of
    n (n + 1) / 2 sums; no row is multiplied before it. Sums of whole numbers are decimals of 38 digits, since those of 64-bit products outgrow 64 bits."""
    types = [f.dataType for f in rows.select(*columns).schema]
    columns = [c.cast("decimal(19,0)") if isinstance(t, T.IntegralType) else c for c, t in zip(columns, types, strict=True)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.groupBy(*keys).agg(*[F.sum(columns[i] * columns[j]).alias(f"_sum{k}") for k, (i, j) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_sum{k}").alias("val")) for k, (i, j) in enumerate(pairs)])
    return sums.withColumn("gram", cells).drop(*[f"_sum{k}" for k in range(len(pairs))])


def mirrored(gram: Column) -> Column:
    """Both halves of an array of (i, j, val) with i <= j."""
    below = F.transform(F.filter(gram, lambda c: c["i"] < c["j"]), lambda c: F.struct(c["j"].alias("i"), c["i"].alias("j"), c["val"].alias("val")))
    return F.concat(gram, below)


def gram_cells(rows: DataFrame, key: Column, columns: list[Column]) -> DataFrame:
    """(matrix_id, i, j, val): for each key the sum over rows of columns[i] * columns[j]. For batches and streams (update or complete mode)."""
    return gram_sums([key.cast("long").alias("matrix_id")], rows, columns).select("matrix_id", F.inline(mirrored(F.col("gram"))))
