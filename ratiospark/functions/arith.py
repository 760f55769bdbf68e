"""The scalar operations of each kind of cell: 'int' (DECIMAL(38,0)), 'frac' (exact rationals) and 'double'."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import frac


@dataclass(frozen=True)
class Arith:
    name: str
    type: str
    lit: Callable
    add: Callable
    sub: Callable
    mul: Callable
    div: Callable
    neg: Callable
    text: Callable
    repr: Callable


def _as(type_: str, f: Callable) -> Callable:
    return lambda *a: f(*a).cast(type_)


def _fr(f: Callable) -> Callable:
    return lambda *a: f(*[frac.mark(x) if isinstance(x, Column) else x for x in a])


INT = Arith(
    "int", frac.DECIMAL, frac.exact, _as(frac.DECIMAL, lambda a, b: a + b), _as(frac.DECIMAL, lambda a, b: a - b), _as(frac.DECIMAL, lambda a, b: a * b),
    frac.of_wholes, frac.negated, lambda a: a.cast("string"), lambda a: a.cast("string"),
)
FRAC = Arith("frac", frac.TYPE, frac.as_frac, _fr(frac.add), _fr(frac.sub), _fr(frac.mul), _fr(frac.div), _fr(frac.neg), _fr(frac.text), _fr(frac.repr_))
DOUBLE = Arith("double", "double", lambda v: F.lit(float(v)), lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b, lambda a, b: a / b, lambda a: -a, lambda a: a.cast("string"), lambda a: a.cast("string"))
KINDS = {a.name: a for a in (INT, FRAC, DOUBLE)}
