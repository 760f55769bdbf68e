"""Vectors: array columns of one kind of number. Unequal lengths raise an error; NULL gives NULL; an empty vector is a vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import frac
from .arith import DOUBLE, Arith


def same_length(a: Column, b: Column, result: Column) -> Column:
    """result, or an error naming both lengths; NULL when either is NULL."""
    wrong = F.raise_error(F.format_string("lengths %d and %d differ", F.size(a), F.size(b)))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), result).otherwise(wrong)


def neg(v: Column, kind: Arith = DOUBLE) -> Column:
    return F.transform(v, lambda x: kind.neg(x))


def _both(a, b, f: Callable) -> Column:
    """Both vectors, or one of them a number that meets every element."""
    return same_length(a, b, F.zip_with(a, b, lambda x, y: f(x, y)))


def add(a: Column, b: Column, kind: Arith = DOUBLE) -> Column:
    return _both(a, b, kind.add)


def sub(a: Column, b: Column, kind: Arith = DOUBLE) -> Column:
    return _both(a, b, kind.sub)


def mul(a: Column, b: Column, kind: Arith = DOUBLE) -> Column:
    return _both(a, b, kind.mul)


def div(a: Column, b: Column, kind: Arith = DOUBLE) -> Column:
    """Integers divide to rationals."""
    return _both(a, b, kind.div)


def add_scalar(v: Column, s: Column, kind: Arith = DOUBLE) -> Column:
    return F.transform(v, lambda x: kind.add(x, s))


def sub_scalar(v: Column, s: Column, kind: Arith = DOUBLE) -> Column:
    return F.transform(v, lambda x: kind.sub(x, s))


def rsub_scalar(s: Column, v: Column, kind: Arith = DOUBLE) -> Column:
    return F.transform(v, lambda x: kind.sub(s, x))


def mul_scalar(v: Column, s: Column, kind: Arith = DOUBLE) -> Column:
    return F.transform(v, lambda x: kind.mul(x, s))


def div_scalar(v: Column, s: Column, kind: Arith = DOUBLE) -> Column:
    return F.transform(v, lambda x: kind.div(x, s))


def rdiv_scalar(s: Column, v: Column, kind: Arith = DOUBLE) -> Column:
    return F.transform(v, lambda x: kind.div(s, x))


def dot(a: Column, b: Column, kind: Arith = DOUBLE) -> Column:
    """Inner product; 0 for empty vectors."""
    return same_length(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: kind.mul(x, y)), kind.lit(0), lambda s, x: kind.add(s, x)))


def outer(a: Column, b: Column, kind: Arith = DOUBLE) -> Column:
    """Rows a[i] * b, of equally long vectors."""
    return same_length(a, b, F.transform(a, lambda x: F.transform(b, lambda y: kind.mul(x, y))))


def sum_(v: Column, kind: Arith = DOUBLE) -> Column:
    return F.aggregate(v, kind.lit(0), lambda s, x: kind.add(s, x))


def nested(f: Callable, a: Column, b: Column, kind: Arith = DOUBLE) -> Column:
    """An element-wise function of this module on vectors of vectors; its inputs stay as they are."""
    return same_length(a, b, F.zip_with(a, b, lambda x, y: f(x, y, kind)))


def sum_2d(m: Column, kind: Arith = DOUBLE) -> Column:
    """Sum of a vector of vectors; 0 if empty."""
    return sum_(F.flatten(m), kind)


def slice_(v: Column, start: int | None = None, stop: int | None = None) -> Column:
    """v[start:stop] with bounds like Python's: negative ones count from the end, those beyond are clamped."""
    n = F.size(v)
    at = lambda p, missing: missing if p is None else F.greatest(F.lit(0), F.lit(p) + n) if p < 0 else F.least(n, F.lit(p))
    a, b = at(start, F.lit(0)), at(stop, n)
    return F.slice(v, a + 1, F.greatest(b - a, F.lit(0)))


def get(v: Column, index: int) -> Column:
    """v[index], negative from the end; an index out of range raises an error."""
    i = F.lit(index) if index >= 0 else F.size(v) + index
    return F.when((i >= 0) & (i < F.size(v)), F.get(v, i)).when(v.isNotNull(), F.raise_error(F.lit(f"index {index} is out of range")))


def to_frac(v: Column) -> Column:
    """Integers to rationals."""
    return F.transform(v, frac.whole)


def centred(s: Column, width: Column) -> Column:
    """s in a cell of width and a space on each side; with an odd rest the wider side is on the left for odd widths."""
    n = F.length(s)
    half = lambda c: F.floor(c / 2).cast("int")
    return F.concat(F.repeat(F.lit(" "), width - half(width) - (n - half(n)) + 1), s, F.repeat(F.lit(" "), half(width) - half(n) + 1))


def text(v: Column, kind: Arith = DOUBLE) -> Column:
    """One line: cells centred to the widest, in brackets."""
    return frac.let(F.transform(v, lambda x: kind.text(x)), lambda t: frac.let(F.coalesce(F.array_max(F.transform(t, F.length)), F.lit(0)), lambda w: F.concat(F.lit("["), F.array_join(F.transform(t, lambda s: centred(s, w)), ""), F.lit("]"))))
