"""Sums and comparisons of rationals of long numbers, in Arrow batches: the same results as `frac`, in Python's whole numbers. Spark interprets nested lambdas
node by node, which takes decimals of many digits several times as long; on the other hand Python functions can't stand within lambdas, so that
vectors and matrices use `frac`.

Operands are columns of (num, den), in lowest terms or not, of either sign. NULL in an operand gives NULL, a zero denominator an error, as does a result of over 38 digits;
what lies between may have any length."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import frac

WHOLE = pa.decimal128(38, 0)
_HALF = (1 << 64) - 1


def numbers(x: pa.Array) -> np.ndarray:
    """Python's whole numbers of a decimal column without nulls."""
    low, high = np.frombuffer(x.buffers()[1], np.int64)[2 * x.offset : 2 * (x.offset + len(x))].reshape(-1, 2).T
    if np.array_equal(high, low >> 63):  # all fit 64 bits
        return low.astype(object)
    return high.astype(object) * (1 << 64) + low.view(np.uint64).astype(object)


def decimals(x: np.ndarray) -> pa.Array:
    """numbers, the other way round."""
    if len(x) and max(x.max(), -x.min()) >= 10**38:
        raise ArithmeticError("overflow: a number has more than 38 digits")
    halves = np.stack([(x & _HALF).astype(np.uint64).view(np.int64), (x >> 64).astype(np.int64)], axis=1)
    return pa.Array.from_buffers(WHOLE, len(x), [None, pa.py_buffer(np.ascontiguousarray(halves))])


def _operands(*columns: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where all numbers are given; num and den of each operand, den > 0, 0 / 1 elsewhere."""
    parts = [p for c in columns for p in c.flatten()]
    given = np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])
    found = [numbers(p.fill_null(0)) for p in parts]
    for k in range(0, len(found), 2):
        num, den = found[k], found[k + 1]
        if not given.all():
            num, den = np.where(given, num, 0), np.where(given, den, 1)
        if (den == 0).any():
            raise ZeroDivisionError("division by zero")
        if (den < 0).any():
            num, den = np.where(den < 0, -num, num), np.where(den < 0, -den, den)
        found[k : k + 2] = num, den
    return given, found


def _total(sign: int):
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        given, (a, b, c, d) = _operands(x, y)
        num, den = a * d + sign * (c * b), b * d
        shared = np.gcd(num, den)
        parts = [decimals(p // shared) for p in (num, den)]
        return pa.StructArray.from_arrays(parts, ["num", "den"], mask=pa.array(~given))

    return run


def _order(x: pa.Array, y: pa.Array) -> pa.Array:
    given, (a, b, c, d) = _operands(x, y)
    left, right = a * d, c * b
    return pa.array((left > right).astype(np.int32) - (left < right).astype(np.int32), mask=~given)


@lru_cache(maxsize=1)
def _functions() -> dict:
    kinds = {"add": (_total(1), frac.TYPE), "sub": (_total(-1), frac.TYPE), "compare": (_order, "int")}
    return {name: F.arrow_udf(f, kind) for name, (f, kind) in kinds.items()}


def pair(num: Column, den: Column) -> Column:
    """num / den of two decimals as an operand of this module, not in lowest terms yet."""
    return F.struct(num.cast(frac.DECIMAL).alias("num"), den.cast(frac.DECIMAL).alias("den"))


def add(a: Column, b: Column) -> Column:
    return frac.mark(_functions()["add"](a, b))


def sub(a: Column, b: Column) -> Column:
    return frac.mark(_functions()["sub"](a, b))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is less than b, equal to it or more."""
    return _functions()["compare"](a, b)
