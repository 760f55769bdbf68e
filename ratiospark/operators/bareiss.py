"""Reduced echelon form of integer matrices without Python: fraction-free elimination as one fold over the columns.

Each step multiplies crosswise and divides by the pivot before, which leaves no remainder, so that numbers stay minors of
the matrix; one division by the last pivot at the end gives the rationals. For numbers whose minors, times an entry, fit 32 digits;
beyond that the decimals raise an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import frac


def rref(m: Column, augment: Column) -> Column:
    """m: ARRAY<ARRAY<DECIMAL(38,0)>> -> ARRAY<ARRAY<rational>>; pivots are looked for in the columns before augment."""

    def step(s: Column, c: Column) -> Column:
        below = F.filter(F.sequence(F.lit(0), F.size(s["m"]) - 1), lambda p: (p >= s["r"]) & (F.get(F.get(s["m"], p), c) != 0))

        def with_pivot(p: Column) -> Column:
            pivot = F.get(s["m"], p)
            rows = F.transform(s["m"], lambda row, i: F.when(i == s["r"], pivot).when(i == p, F.get(s["m"], s["r"])).otherwise(row))
            cross = lambda row: F.zip_with(row, pivot, lambda x, y: ((F.get(pivot, c) * x - F.get(row, c) * y) / s["d"]).cast(frac.DECIMAL))
            done = F.transform(rows, lambda row, i: F.when(i == s["r"], row).otherwise(cross(row)))
            return F.struct(done.alias("m"), (s["r"] + 1).alias("r"), F.get(pivot, c).alias("d"))

        return frac.let(F.get(below, F.lit(0)), lambda p: F.when(p.isNull(), s).otherwise(with_pivot(p)))

    start = F.struct(m.alias("m"), F.lit(0).alias("r"), F.lit(1).cast(frac.DECIMAL).alias("d"))
    columns = F.when(augment > 0, F.sequence(F.lit(0), augment - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(columns, start, step, lambda s: F.transform(s["m"], lambda row: F.transform(row, lambda x: frac.reduced(x, s["d"]))))
