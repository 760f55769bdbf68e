"""Exact reduced forms by elimination modulo many primes.

Each matrix is reduced modulo primes of 31 bits, one row for each matrix and prime, so that one large matrix occupies many tasks and every
step is one of numpy's on whole numbers of 64 bits. The rationals come back by Chinese remaindering and rational reconstruction, in blocks
of rows. Pivots and changes of rows follow the kernel's rule (see elimination), so that results are the same to the last cell.

A minor of the matrix, its rows brought to whole numbers, is at most H, the product of the rows' lengths, and every result is a quotient of
two minors; so primes whose product exceeds 2 H^2 determine it. A prime that sees a zero where there is none takes other rows; it divides
the number tested, which is at most H, and so does every prime that goes wrong at the same place. Hence no wrong choice of rows can be
shared by primes whose product exceeds H: the choice of those that together exceed 2 H^2 is the right one, without a chance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Primes are below this, so that products of two residues fit 64 bits.
BELOW = 1 << 31
#: Primes beyond those that the bound asks for, in place of ones that go wrong.
SPARE = 2
#: Cells whose rationals are put together at once.
BLOCK_CELLS = 2048


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):  # decide every number under 3,215,031,751
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


@lru_cache(maxsize=1)
def _known_primes() -> list[int]:
    return []


def prime(k: int) -> int:
    """The k-th prime below BELOW, from the largest down."""
    known = _known_primes()
    n = known[-1] - 2 if known else BELOW - 1
    while len(known) <= k:
        if _is_prime(n):
            known.append(n)
        n -= 2
    return known[k]


def reduce_modulo(a: np.ndarray, augment: int, p: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Reduced form modulo p of the columns before augment, the others carried along; where each row came from; pivot columns."""
    a = np.mod(a, p)
    n, active = len(a), len(a)
    origin, pivots = list(range(n)), []

    def swap(i: int, k: int) -> None:
        a[[i, k]] = a[[k, i]]
        origin[i], origin[k] = origin[k], origin[i]

    for col in range(augment):
        top = len(pivots)
        if top >= active:
            break
        if a[top, col] == 0:
            others = np.flatnonzero(a[top + 1 : active, col])
            if not len(others):
                continue
            swap(top, top + 1 + int(others[-1]))
        below = slice(top + 1, active)
        k = a[below, col] * pow(int(a[top, col]), -1, p) % p
        a[below, col:] = (a[below, col:] - k[:, None] * a[top, col:]) % p
        empty = (~a[below, :augment].any(axis=1)).tolist()
        at, row = dict(enumerate(empty, top + 1)), top + 1
        while row < active:  # rows without coefficients go to the end
            if not at[row]:
                row += 1
                continue
            active -= 1
            if row < active:
                swap(row, active)
                at[row] = at[active]
        pivots.append(col)
    for top in range(len(pivots) - 1, -1, -1):
        col = pivots[top]
        a[top, col:] = a[top, col:] * pow(int(a[top, col]), -1, p) % p
        a[:top, col:] = (a[:top, col:] - a[:top, col, None] * a[top, col:]) % p
    return a, origin, pivots


def remaindered(residues: np.ndarray, primes: list[int]) -> tuple[list[int], int]:
    """residues: a row for each prime -> the numbers below the primes' product with these remainders, and the product. Digits of mixed radix are
    found in 64 bits, and put together from the last."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        x, radix = residues[k].astype(np.int64) % p, 1
        known = np.zeros_like(x)
        for j in range(k):
            known = (known + digits[j] % p * radix) % p
            radix = radix * primes[j] % p
        digits.append((x - known) % p * pow(radix, -1, p) % p)
    out = [0] * residues.shape[1]
    for d, p in zip(reversed(digits), reversed(primes), strict=True):
        out = [x * p + y for x, y in zip(out, d.tolist(), strict=True)]
    return out, math.prod(primes)


def reconstructed(x: int, m: int, bound: int) -> tuple[int, int]:
    """num, den with num = x den modulo m, both at most bound, by half of Euclid's method."""
    r0, r1, t0, t1 = m, x % m, 0, 1
    while r1 > bound:
        q = r0 // r1
        r0, r1, t0, t1 = r1, r0 - q * r1, t1, t0 - q * t1
    return (r1, t1) if t1 > 0 else (-r1, -t1)


def rationals(numbers: list[int], m: int, bound: int) -> list[tuple[str, str]]:
    """Each number modulo m as num and den in lowest terms. Denominators are mostly alike, so the last common one is tried first."""
    out, common, half = [], 1, m // 2
    for x in numbers:
        y = x * common % m
        y = y - m if y > half else y
        if abs(y) > bound or common > bound:
            num, den = reconstructed(x, m, bound)
            g = math.gcd(num, den)
            common = common * den // math.gcd(common, den)
            common = common if common <= bound else den // g
        else:
            num, den = y, common
            g = math.gcd(num, den)
        out.append((str(num // g), str(den // g)))
    return out


def _whole(num: list[str], den: list[str], n_cols: int, invert: bool) -> tuple[list[list[int]], list[int], int]:
    """Rows times their common denominators, beside the unit matrix's rows times the same to invert; these denominators; the bits of H."""
    rows, scales, bits = [], [], 0.0
    for i, k in enumerate(range(0, len(num), n_cols)):
        dens = [int(q) for q in den[k : k + n_cols]]
        shared = math.lcm(*dens)
        row = [int(p) * (shared // q) for p, q in zip(num[k : k + n_cols], dens, strict=True)]
        if invert:
            row += [shared if i == j else 0 for j in range(n_cols)]
        bits += max(sum(x * x for x in row), shared * shared).bit_length() / 2
        rows.append(row)
        scales.append(shared)
    return rows, scales, math.ceil(bits)


PARTS = "matrix_id long, n_rows int, n_cols int, augment int, bits int, k int, scales binary, cells binary"


def _parted(invert: bool):
    """Packed matrices -> a row of residues for each prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.binary())
        for batch in batches:
            for r in batch.to_pylist():
                if invert and r["n_rows"] != r["n_cols"]:
                    raise ValueError("only a square matrix has an inverse")
                rows, scales, bits = _whole(r["num"], r["den"], r["n_cols"], invert)
                line = 2 * r["n_cols"] if invert else r["augment"]
                kind = np.int64 if all(abs(x) < 1 << 62 for row in [*rows, scales] for x in row) else object
                cells, by = np.array(rows, kind), np.array(scales, kind)
                for k in range(-(-(2 * bits + 2) // 30) + SPARE):
                    residues = [np.mod(x, prime(k)).astype(np.uint32) for x in (by, cells)]
                    if not residues[0].all():
                        continue  # the prime divides a denominator
                    cols = [r["matrix_id"], len(rows), len(rows[0]), line, bits, k, *[x.tobytes() for x in residues]]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    return run


BLOCKS = "matrix_id long, block int, n_cols int, bits int, k int, origin array<int>, pivots array<int>, cells binary"


def _eliminated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A matrix modulo a prime -> its reduced form in blocks of rows."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = (pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
    for batch in batches:
        for r in batch.to_pylist():
            given = np.frombuffer(r["cells"], np.uint32).astype(np.int64).reshape(r["n_rows"], r["n_cols"])
            p = prime(r["k"])
            a, origin, pivots = reduce_modulo(given, r["augment"], p)
            scales = np.frombuffer(r["scales"], np.uint32).tolist()
            for i in range(len(pivots), len(a)):  # a row without a pivot is still as many times too large
                a[i] = a[i] * pow(scales[origin[i]], -1, p) % p
            high = max(1, BLOCK_CELLS // r["n_cols"])
            rows = [(r["matrix_id"], b, r["n_cols"], r["bits"], r["k"], origin, pivots, a[at : at + high].astype(np.uint32).tobytes()) for b, at in enumerate(range(0, r["n_rows"], high))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


CELLS = "matrix_id long, i int, j int, num string, den string, pivots array<int>"


def _put_together(invert: bool):
    """A block's residues for all primes -> its cells."""

    def run(key: tuple[pa.Scalar, ...], given: pa.Table) -> pa.Table:
        rows = given.sort_by("k").to_pylist()
        bits, n_cols = rows[0]["bits"], rows[0]["n_cols"]
        chosen: dict[tuple, list] = {}
        for r in rows:
            chosen.setdefault((tuple(r["origin"]), tuple(r["pivots"])), []).append(r)
        right = max(chosen.values(), key=len)
        primes = [prime(r["k"]) for r in right]
        bound = 1 << bits
        if math.prod(primes) <= 2 * bound * bound:
            raise ArithmeticError(f"too many of the primes divide numbers of matrix {rows[0]['matrix_id']}")
        numbers, m = remaindered(np.stack([np.frombuffer(r["cells"], np.uint32) for r in right]), primes)
        found = rationals(numbers, m, bound)
        first, high = right[0]["block"] * max(1, BLOCK_CELLS // n_cols), len(numbers) // n_cols
        skip = n_cols // 2 if invert else 0
        places = [(first + i, j) for i in range(high) for j in range(n_cols)]
        kept = [(rows[0]["matrix_id"], i, j - skip, *v, right[0]["pivots"]) for (i, j), v in zip(places, found, strict=True) if j >= skip]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), kinds, strict=True)], [x.split()[0] for x in CELLS.split(", ")])

    return run


def reduced(packed: DataFrame, invert: bool = False) -> DataFrame:
    """packed (matrix_id, n_rows, n_cols, augment, num, den: text in row order) -> CELLS of the reduced forms, or with invert of the inverses (for a
    singular matrix an invertible E with E A = rref(A)). num and den have any length."""
    parts = packed.mapInArrow(_parted(invert), PARTS).repartition("matrix_id", "k")
    return parts.mapInArrow(_eliminated, BLOCKS).groupBy("matrix_id", "block").applyInArrow(_put_together(invert), CELLS)


def cells(found: DataFrame, decimal: str) -> DataFrame:
    """matrix_id, i, j, val of CELLS. Numbers of over 38 digits raise an error here."""
    return found.select("matrix_id", "i", "j", F.struct(F.col("num").cast(decimal).alias("num"), F.col("den").cast(decimal).alias("den")).alias("val"))
