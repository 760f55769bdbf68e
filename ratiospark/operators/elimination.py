"""Exact elimination of many matrices at once: a kernel in Python's unbounded rationals over dense rows.

A matrix is one row, so that elimination needs no shuffle of its own; batches go to Python by Arrow. Elimination of one matrix is
sequential; matrices are independent and spread over tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd

Rows = list[list[Fraction]]


@dataclass
class Step:
    """swap: rows target and source change places; add: factor times row source is added to row target; scale: row target times factor.
    rows: all rows after it, or the changed row alone (none for a swap)."""

    op: str
    label: str
    target: int
    source: int
    factor: Fraction | None
    rows: Rows


@dataclass
class Result:
    """rows: echelon form; perm[k]: which input row stands at k; lower: unit triangular multipliers; pivots: columns with a pivot."""

    rows: Rows
    perm: list[int]
    lower: Rows
    pivots: list[int]
    steps: list[Step]


def _times(k: Fraction, row: int) -> str:
    k = abs(k)
    return f"R{row + 1}" if k == 1 else f"{k}R{row + 1}"


def eliminate(rows: Rows, augment: int, reduce: bool = False, trace: str = "") -> Result:
    """Echelon form of the columns before augment, with the others carried along.

    A pivot stays if it isn't zero; else the lowest row that may still be non-zero and has an entry in the column comes up. A row
    whose coefficients have all become zero changes places with the last one not known to be zero, and the row that comes in is
    treated in its place. With reduce, pivots become 1 and the entries above them 0, from the last pivot up. trace: steps are kept with
    all rows after each ("whole") or with the changed row ("changes")."""
    a = [list(r) for r in rows]
    n, active = len(a), len(a)
    perm, pivots, steps = list(range(n)), [], []
    lower = [[Fraction(int(i == j)) for j in range(n)] for i in range(n)]

    def note(op: str, label: str, target: int, source: int, factor: Fraction | None = None) -> None:
        if trace:
            changed = [] if op == "swap" else [a[target]]  # rows are replaced, never changed in place
            steps.append(Step(op, label, target, source, factor, list(a) if trace == "whole" else changed))

    def swap(i: int, k: int) -> None:
        done = len(pivots)  # multipliers exist in the columns before this one, or up to it for rows below the pivot
        a[i], a[k] = a[k], a[i]
        perm[i], perm[k] = perm[k], perm[i]
        for c in range(min(done + 1, n)):
            if c < min(i, k):
                lower[i][c], lower[k][c] = lower[k][c], lower[i][c]
        note("swap", f"R{i + 1} <-> R{k + 1}", i, k)

    for col in range(augment):
        top = len(pivots)
        if top >= active:
            break
        if a[top][col] == 0:
            other = next((k for k in range(active - 1, top, -1) if a[k][col] != 0), None)
            if other is None:
                continue
            swap(top, other)
        row = top + 1
        while row < active:
            k = a[row][col] / a[top][col]
            if k:
                a[row] = [x - k * y for x, y in zip(a[row], a[top], strict=True)]
                lower[row][top] = k
                note("add", f"R{row + 1} {'-' if k > 0 else '+'} {_times(k, top)}", row, top, -k)
            if not any(a[row][:augment]):
                active -= 1
                if row < active:
                    swap(row, active)
                continue
            row += 1
        pivots.append(col)
    if reduce:
        for top in range(len(pivots) - 1, -1, -1):
            col, k = pivots[top], 1 / a[top][pivots[top]]
            if k != 1:
                a[top] = [x * k for x in a[top]]
                note("scale", f"-R{top + 1}" if k == -1 else f"{k}R{top + 1}", top, top, k)
            for row in range(top - 1, -1, -1):
                if k := a[row][col]:
                    a[row] = [x - k * y for x, y in zip(a[row], a[top], strict=True)]
                    note("add", f"R{row + 1} {'-' if k > 0 else '+'} {_times(k, top)}", row, top, -k)
    return Result(a, perm, lower, pivots, steps)


def inverse(rows: Rows) -> Rows:
    """The right half of the reduced form of [A | I] with pivots allowed in both halves: the inverse, or for a singular A an
    invertible E with E A = rref(A)."""
    n = len(rows)
    if any(len(r) != n for r in rows):
        raise ValueError("only a square matrix has an inverse")
    wide = [list(r) + [Fraction(int(i == j)) for j in range(n)] for i, r in enumerate(rows)]
    return [r[n:] for r in eliminate(wide, 2 * n, reduce=True).rows]


def _matrix(num: list, den: list, cols: int, real: bool) -> Rows:
    if real and not all(math.isfinite(float(p)) for p in num):
        raise ValueError("NaN and infinity have no exact value to eliminate with")
    cells = [Fraction(float(p)) if real else Fraction(int(p), int(q)) for p, q in zip(num, den, strict=True)]
    return [cells[k : k + cols] for k in range(0, len(cells), cols)]


def _flat(rows: Rows, real: bool) -> tuple[list[str], list[str]]:
    if real:
        return [repr(float(x)) for r in rows for x in r], ["1" for r in rows for _ in r]
    return [str(x.numerator) for r in rows for x in r], [str(x.denominator) for r in rows for x in r]


def _moved(by: list[Step], real: bool) -> tuple:
    if not by:
        return None, None, None, None
    k = by[0].factor
    num, den = (None, None) if k is None else (repr(float(k)), "1") if real else (str(k.numerator), str(k.denominator))
    return by[0].target, by[0].source, num, den


#: What the kernel gives for each matrix and part; numbers as text, as they may have any length.
OUT = "matrix_id long, part string, step int, op string, label string, n_rows int, n_cols int, augment int, pivots array<int>, num array<string>, den array<string>, target int, source int, factor_num string, factor_den string"


def kernel(what: str, real: bool = False):
    """mapInPandas function over (matrix_id, n_rows, n_cols, augment, num, den) for what: ref, rref, plu, lower, inverse, or steps: trace (of
    rref) and ref trace with all rows after each, changes and ref changes with the changed row. real: the numbers are doubles, and so are
    the results."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, _, cols, augment, num, den in zip(*[pdf[c] for c in ("matrix_id", "n_rows", "n_cols", "augment", "num", "den")], strict=True):
                rows = _matrix(num, den, int(cols), real)
                parts: list[tuple] = []
                if what == "inverse":
                    parts.append(("inverse", 0, None, None, inverse(rows), len(rows), None))
                else:
                    kept = "whole" if what.endswith("trace") else "changes" if what.endswith("changes") else ""
                    r = eliminate(rows, int(augment), reduce=what in ("rref", "trace", "changes"), trace=kept)
                    if what in ("ref", "rref"):
                        parts.append((what, 0, None, None, r.rows, augment, r.pivots))
                    elif kept:
                        parts += [(kept, k, x.op, x.label, x.rows, augment, None, x) for k, x in enumerate(r.steps, 1)]
                    else:
                        n = len(rows)
                        p = [[Fraction(int(r.perm[i] == j)) for j in range(n)] for i in range(n)]
                        if what == "plu":
                            parts += [("P", 0, None, None, p, n, None), ("L", 0, None, None, r.lower, n, None), ("U", 0, None, None, r.rows, augment, r.pivots)]
                        else:  # the transpose of P, times L
                            back = [None] * n
                            for i, k in enumerate(r.perm):
                                back[k] = r.lower[i]
                            parts += [("lower", 0, None, None, back, n, None), ("U", 0, None, None, r.rows, augment, r.pivots)]
                for part, step, op, label, a, line, pivots, *by in parts:
                    out.append((m, part, step, op, label, len(a), int(cols) if by else len(a[0]), int(line), pivots, *_flat(a, real), *_moved(by, real)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return run
