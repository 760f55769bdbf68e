"""Reduced forms kept while rows arrive: the state of a matrix is its reduced basis, at most one row for each column."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

Basis = dict[int, list[int]]  # by pivot column: whole numbers without a common divisor, positive at the pivot, zero at other pivots

OUT = "matrix_id long, rank int, pivots array<int>, num array<string>, den array<string>"


def _without(row: list[int], by: list[int], col: int) -> list[int]:
    """row less a multiple of by, so that it is zero in the column, over the common divisor."""
    g = math.gcd(row[col], by[col])
    a, b = by[col] // g, row[col] // g
    return _primitive([a * x - b * y for x, y in zip(row, by, strict=True)])


def _primitive(row: list[int]) -> list[int]:
    g = math.gcd(*row)
    return [x // g for x in row] if g > 1 else row


def insert(basis: Basis, row: list[int]) -> bool:
    """Adds a row to the span; False if it was within. One step for each row of the basis before, and one for each after."""
    for col, by in basis.items():
        if row[col]:
            row = _without(row, by, col)
    pivot = next((j for j, x in enumerate(row) if x), None)
    if pivot is None:
        return False
    row = _primitive(row if row[pivot] > 0 else [-x for x in row])
    for col in [c for c, by in basis.items() if by[pivot]]:
        by = _without(basis[col], row, pivot)
        basis[col] = by if by[col] > 0 else [-x for x in by]
    basis[pivot] = row
    return True


def reduced(basis: Basis) -> tuple[list[int], list[str], list[str]]:
    """Pivots, and numerators and denominators of the reduced form's rows, one after another."""
    pivots, num, den = sorted(basis), [], []
    for col in pivots:
        for x in basis[col]:
            g = math.gcd(x, basis[col][col])
            num.append(str(x // g))
            den.append(str(basis[col][col] // g))
    return pivots, num, den


class _Rows(StatefulProcessor):
    """Rows of one matrix after another; numbers are kept as text, as they may have any length."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.basis = handle.getListState("basis", "pivot int, row array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        basis: Basis = {pivot: [int(x) for x in row] for pivot, row in self.basis.get()} if self.basis.exists() else {}
        width = len(next(iter(basis.values()))) if basis else None
        for part in rows:
            for row in part["row"]:
                if row is None or any(x is None for x in row):
                    continue
                row = [int(x) for x in row]
                if width is not None and len(row) != width or not row:
                    raise ValueError(f"matrix {key[0]} is ragged or empty")
                width = len(row)
                insert(basis, row)
        if basis:
            self.basis.put([(pivot, [str(x) for x in row]) for pivot, row in sorted(basis.items())])
        pivots, num, den = reduced(basis)
        yield pd.DataFrame({"matrix_id": [key[0]], "rank": [len(pivots)], "pivots": [pivots], "num": [num], "den": [den]})

    def close(self) -> None:
        pass


def echelon(rows: DataFrame) -> DataFrame:
    """A stream of rows (matrix_id long, row: array of whole numbers) -> after each batch, for every matrix that got rows, OUT: rank, pivots and the
    rows of the reduced form that aren't zero, in row order. In update mode; for a batch, the same of all its rows.

    Rows may come in any order and be repeated. A row that is null or holds a null doesn't count; rows of unlike lengths raise an error. Needs
    the state store that keeps lists (spark.sql.streaming.stateStore.providerClass of RocksDB). Work for a row grows with the square of the
    number of columns, state alike, and neither with the number of rows."""
    given = rows.selectExpr("matrix_id", "cast(row as array<string>) as row").filter("matrix_id IS NOT NULL")
    return given.groupBy("matrix_id").transformWithStateInPandas(_Rows(), StructType.fromDDL(OUT), "update", "none")
