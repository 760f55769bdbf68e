"""Solutions of many linear systems at once, exact and of any length.

Systems of whole numbers are eliminated in Arrow batches, all those of one size together, by fraction-free elimination: each step multiplies
crosswise and divides by the pivot before, without a remainder, so that numbers stay minors of the system, and rationals appear at the
end alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batch import WHOLE, numbers
from .matrix import ID, MatrixFrame

UNIQUE, MANY, NONE = "unique", "many", "none"
#: Numbers of systems that are treated together.
CELLS = 1 << 17


def solve(frame: MatrixFrame) -> DataFrame:
    """matrix_id, rank, status, j, num, den, value: for each augmented matrix its unknowns, by the first column of constants.

    status is unique, many or none, as the system has one solution, more, or is contradictory. Without a unique solution there is one row
    with null j, num, den and value. num and den are text, as they may have any length; value is the quotient as a double. A matrix
    without constants raises an error."""
    line = F.when(F.col("augment") < F.col("n_cols"), F.col("augment")).otherwise(F.raise_error(F.format_string("matrix %s has no constants", F.col(ID))).cast("int"))
    found = frame.listed().withColumn("augment", line).mapInArrow(_solved, FOUND) if frame.kind.name == "int" else _by_kernel(frame, line)
    return found.select(ID, "rank", "status", "j", "num", "den", (F.col("num").cast("double") / F.col("den").cast("double")).alias("value"))


def _by_kernel(frame: MatrixFrame, line: Column) -> DataFrame:
    """Rationals and doubles, a system at a time."""
    reduced = frame._eliminated("rref").select(ID, "n_rows", "n_cols", line.alias("augment"), F.size("pivots").alias("rank"), "num", "den")
    # constants of the rows without a pivot
    rest = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda i: (i >= F.col("rank")) & F.exists(F.sequence(F.col("augment"), F.col("n_cols") - 1), lambda c: F.get("num", i * F.col("n_cols") + c) != "0"))
    status = F.when(F.exists(rest, lambda x: x), NONE).when(F.col("rank") == F.col("augment"), UNIQUE).otherwise(MANY)
    places = F.transform(F.sequence(F.lit(0), F.col("augment") - 1), lambda j: F.struct(j.alias("j"), F.get("num", j * F.col("n_cols") + F.col("augment")).alias("num"), F.get("den", j * F.col("n_cols") + F.col("augment")).alias("den")))
    named = reduced.withColumn("status", F.when(F.col("augment") == 0, F.when(F.exists(rest, lambda x: x), NONE).otherwise(MANY)).otherwise(status))
    found = named.select(ID, "rank", "status", F.explode_outer(F.when((F.col("status") == UNIQUE) & (F.col("augment") > 0), places)).alias("x"))
    return found.select(ID, "rank", "status", "x.j", "x.num", "x.den")


def _whole(x: pa.Array) -> pa.Array:
    """Decimals without a fraction, of integers or decimals of any width; a fraction raises an error."""
    if not (pa.types.is_integer(x.type) or pa.types.is_decimal(x.type)):
        raise TypeError(f"{x.type} is no type of whole numbers")
    return x.cast(WHOLE)


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Systems of one size, some at a time: their places in the batch, augment, and their numbers by system, row and column."""
    vals = batch["vals"]
    sizes = np.stack([batch[c].to_numpy() for c in ("n_rows", "n_cols", "augment")], axis=1)
    counts, flat = vals.value_lengths().to_numpy(zero_copy_only=False), _whole(vals.flatten())
    if flat.null_count or not np.array_equal(counts, sizes[:, 0] * sizes[:, 1]):
        raise ValueError("a matrix is ragged or has a cell without a number")
    starts = np.cumsum(counts) - counts
    for shape in np.unique(sizes, axis=0):
        n_rows, n_cols, augment = shape.tolist()
        here = np.flatnonzero((sizes == shape).all(axis=1))
        some = max(1, CELLS // (n_rows * n_cols))
        for at in range(0, len(here), some):
            part = here[at : at + some]
            places = starts[part, None] + np.arange(n_rows * n_cols)
            yield part, augment, numbers(flat.take(pa.array(places.ravel()))).reshape(-1, n_rows, n_cols)


def eliminated(a: np.ndarray, augment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a: whole numbers by system, row and column -> the same with the columns before augment reduced: in a system of rank r the first r rows have
    the last pivot d in their own columns of pivots, and zeros in the others'; r; d."""
    a = a.copy()
    rank, last = np.zeros(len(a), np.int64), np.full(len(a), 1, object)
    for col in range(augment):
        fit = (a[:, :, col] != 0) & (np.arange(a.shape[1]) >= rank[:, None])
        k = np.flatnonzero(fit.any(axis=1))
        if not len(k):
            continue
        low, top = fit[k].argmax(axis=1), rank[k]
        pivot = a[k, low]
        a[k, low] = a[k, top]
        d = pivot[:, col]
        a[k] = (d[:, None, None] * a[k] - a[k][:, :, col, None] * pivot[:, None, :]) // last[k, None, None]
        a[k, top] = pivot
        last[k], rank[k] = d, top + 1
    return a, rank, last


FOUND = "matrix_id long, rank int, status string, j int, num string, den string"
_FOUND = pa.schema([(ID, pa.int64()), ("rank", pa.int32()), ("status", pa.string()), ("j", pa.int32()), ("num", pa.string()), ("den", pa.string())])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch[ID].to_numpy()
        for part, augment, given in _alike(batch):
            a, rank, d = eliminated(given, augment)
            rest = (a[:, :, augment:] != 0).any(axis=2) & (np.arange(a.shape[1]) >= rank[:, None])
            none = rest.any(axis=1)
            one = ~none & (rank == augment) & (augment > 0)
            num = a[one, :augment, augment]
            den = np.repeat(d[one, None], num.shape[1], axis=1)
            shared = np.gcd(num, den) * np.where(den < 0, -1, 1)
            text = [pa.array([str(x) for x in (y // shared).ravel().tolist()], pa.string()) for y in (num, den)]
            many = np.where(none, NONE, MANY)[~one]
            yield _rows(np.repeat(ids[part][one], augment), np.repeat(rank[one], augment), np.full(num.size, UNIQUE), pa.array(np.tile(np.arange(augment), len(num)), pa.int32()), *text)
            yield _rows(ids[part][~one], rank[~one], many, *[pa.nulls(len(many), _FOUND.field(c).type) for c in ("j", "num", "den")])


def _rows(ids: np.ndarray, rank: np.ndarray, status: np.ndarray, *unknowns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rank, pa.int32()), pa.array(status.tolist(), pa.string()), *unknowns], schema=_FOUND)


def residuals(frame: MatrixFrame, solutions: DataFrame) -> DataFrame:
    """matrix_id, wrong: how many equations the solutions (matrix_id, j, num, den) of frame's augmented integer matrices miss, by whole numbers of any
    length: every row of coefficients times x is compared with its constant over the common denominator. A solution that lacks an
    unknown, has one twice or a zero denominator misses all."""
    if frame.kind.name != "int":
        raise TypeError("needs integers")
    unknown = F.struct("j", F.col("num").cast("string").alias("num"), F.col("den").cast("string").alias("den"))
    x = solutions.filter("j IS NOT NULL").groupBy(ID).agg(F.array_sort(F.collect_list(unknown)).alias("x"))
    both = frame.listed().join(x, ID).select(ID, "n_rows", "n_cols", "augment", "vals", "x.j", "x.num", "x.den")
    return both.mapInArrow(_missed, "matrix_id long, wrong long")


def _missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, (j, num, den) = batch[ID], (batch[c].to_pylist() for c in ("j", "num", "den"))
        for part, augment, a in _alike(batch):
            wanted = list(range(augment))
            whole = np.array([j[k] == wanted and None not in num[k] and None not in den[k] for k in part], bool)
            p, q = (np.array([int(x) for k in part[whole] for x in y[k]], object).reshape(whole.sum(), augment) for y in (num, den))
            shared = np.lcm.reduce(q, axis=1, initial=1)
            left = (a[whole, :, :augment] * (p * (shared[:, None] // np.where(q == 0, 1, q)))[:, None, :]).sum(axis=2)
            missed = (left != a[whole, :, augment] * shared[:, None]).sum(axis=1)
            wrong = np.full(len(part), a.shape[1], np.int64)
            wrong[whole] = np.where((q == 0).any(axis=1), a.shape[1], missed)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(part)), pa.array(wrong)], [ID, "wrong"])
