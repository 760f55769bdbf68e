"""Matrices and vectors from literals, tables and dense rows."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import frac
from ..operators.matrix import ID, MatrixFrame


#: Places of a sparse matrix that are summed up side by side, in one row.
FEW_CELLS = 36


def kind_of(cells) -> str:
    """The kind of number that holds all of them."""
    if any(isinstance(x, float) for x in cells):
        return "double"
    return "frac" if any(isinstance(x, Fraction) for x in cells) else "int"


def from_literals(spark: SparkSession, matrices: dict[int, Sequence[Sequence]], augment: dict[int, int] | None = None) -> MatrixFrame:
    """matrix_id -> rows of ints, Fractions or floats. Ragged and empty matrices raise an error."""
    cells, heads = [], []
    kind = kind_of([x for m in matrices.values() for r in m for x in r])
    for key, rows in matrices.items():
        if not rows or not rows[0] or any(len(r) != len(rows[0]) for r in rows):
            raise ValueError(f"matrix {key} is ragged or empty")
        line = (augment or {}).get(key)
        heads.append((key, len(rows), len(rows[0]), len(rows[0]) if line is None else line))
        for i, r in enumerate(rows):
            for j, x in enumerate(r):
                cells.append((key, i, j, float(x), None) if kind == "double" else (key, i, j, str(Fraction(x).numerator), str(Fraction(x).denominator)))
    df = spark.createDataFrame(cells, f"matrix_id long, i int, j int, p {'double' if kind == 'double' else 'string'}, q string")
    pair = F.struct(F.col("p").cast(frac.DECIMAL).alias("num"), F.col("q").cast(frac.DECIMAL).alias("den"))
    val = F.col("p") if kind == "double" else pair if kind == "frac" else F.col("p").cast(frac.DECIMAL)
    return MatrixFrame(df.select(ID, "i", "j", val.alias("val")), spark.createDataFrame(heads, "matrix_id long, n_rows int, n_cols int, augment int"), kind)


def from_table(df: DataFrame, matrix_id: Column, i: Column, j: Column, value: Column, kind: str = "int") -> MatrixFrame:
    """Cells are sums of value over the rows of one place; sizes are the largest positions plus one."""
    cells = df.groupBy(matrix_id.cast("long").alias(ID), i.cast("int").alias("i"), j.cast("int").alias("j")).agg(F.sum(value).alias("val"))
    cells = cells.withColumn("val", frac.exact(F.col("val")) if kind == "int" else F.col("val").cast("double"))
    head = cells.groupBy(ID).agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_cols")).withColumn("augment", F.col("n_cols"))
    return MatrixFrame(cells, head, kind)


def _whole_sum(value: Column, long: bool) -> Column:
    """The sum as a decimal, zero where there is none. 64-bit numbers are summed in halves of 32 bits, which takes half as long as sums of decimals
    and is exact beyond 64 bits too."""
    if not long:
        return F.coalesce(F.sum(value), F.lit(0)).cast(frac.DECIMAL)
    high, low = F.sum(F.shiftright(value, 32)), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.coalesce((high.cast(frac.DECIMAL) * F.lit(1 << 32) + low).cast(frac.DECIMAL), F.lit(0).cast(frac.DECIMAL))


def from_sparse(df: DataFrame, matrix_id: Column, i: Column, j: Column, value: Column, n_rows: int, n_cols: int, augment: int | None = None) -> MatrixFrame:
    """Integer matrices of one size; cells are sums of value over the rows of one place, and zero where there is none. A place outside raises
    an error; rows with a null id, place or value don't count."""
    long = isinstance(df.select(value).schema[0].dataType, IntegralType)
    given = df.select(matrix_id.cast("long").alias(ID), i.cast("int").alias("i"), j.cast("int").alias("j"), (value.cast("long") if long else frac.exact(value)).alias("val")).dropna()
    inside = F.when((F.col("i") >= 0) & (F.col("i") < n_rows) & (F.col("j") >= 0) & (F.col("j") < n_cols), True).otherwise(F.raise_error(F.lit("a cell is out of range")).cast("boolean"))
    given, line = given.filter(inside), n_cols if augment is None else augment
    sized = lambda ids, *more: ids.select(ID, F.lit(n_rows).alias("n_rows"), F.lit(n_cols).alias("n_cols"), F.lit(line).alias("augment"), *more)
    if n_rows * n_cols <= FEW_CELLS:  # one pass: a sum for each place
        places = [(r, c) for r in range(n_rows) for c in range(n_cols)]
        row = given.groupBy(ID).agg(*[_whole_sum(F.when((F.col("i") == r) & (F.col("j") == c), F.col("val")), long).alias(f"_{r}_{c}") for r, c in places])
        cells = F.array(*[F.struct(F.lit(r).alias("i"), F.lit(c).alias("j"), F.col(f"_{r}_{c}").alias("val")) for r, c in places])
        return MatrixFrame(row.select(ID, F.inline(cells)), sized(row), listed=sized(row, F.array(*[F.col(f"_{r}_{c}") for r, c in places]).alias("vals")))
    if long:
        given = given.withColumn("val", F.col("val").cast(frac.DECIMAL))
    ids = given.select(ID).distinct()
    zeros = ids.select(ID, F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("i")).select(ID, "i", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("j")).withColumn("val", F.lit(0).cast(frac.DECIMAL))
    return MatrixFrame(given.unionByName(zeros).groupBy(ID, "i", "j").agg(F.sum("val").cast(frac.DECIMAL).alias("val")), sized(ids))


def from_dense(df: DataFrame, m: str = "m", kind: str = "int", augment: Column | None = None) -> MatrixFrame:
    """Rows (matrix_id, m: array of arrays). Ragged and empty ones raise an error."""
    rect = F.coalesce(F.forall(m, lambda r: F.size(r) == F.size(F.get(m, F.lit(0)))) & (F.size(F.get(m, F.lit(0))) > 0), F.lit(False))
    df = df.filter(F.when(rect, True).otherwise(F.raise_error(F.lit("a matrix is ragged or empty")).cast("boolean")))
    cells = df.select(ID, F.posexplode(m).alias("i", "r")).select(ID, "i", F.posexplode("r").alias("j", "val"))
    if kind == "int":
        cells = cells.withColumn("val", frac.exact(F.col("val")))
    width = F.size(F.get(m, F.lit(0)))
    return MatrixFrame(cells, df.select(ID, F.size(m).alias("n_rows"), width.alias("n_cols"), F.coalesce(augment if augment is not None else F.lit(None).cast("int"), width).alias("augment")), kind)


def scaled_identity(sizes: DataFrame, k: int = 1) -> MatrixFrame:
    """sizes (matrix_id, n) -> k times the identity of n rows. A size under 1 raises an error."""
    fine = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("a matrix has at least one row")).cast("int"))
    side = F.sequence(F.lit(0), fine - 1)
    cells = sizes.select(ID, F.explode(side).alias("i"), "n").select(ID, "i", F.explode(side).alias("j")).withColumn("val", F.when(F.col("i") == F.col("j"), k).otherwise(0).cast(frac.DECIMAL))
    return MatrixFrame(cells, sizes.select(ID, F.col("n").alias("n_rows"), F.col("n").alias("n_cols"), F.col("n").alias("augment")))


def vector(df: DataFrame, key: str, idx: Column, value: Column) -> DataFrame:
    """(key, v): values in the order of idx, of equal idx by value."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx.alias("i"), value.alias("x")))), lambda s: s["x"]).alias("v"))
