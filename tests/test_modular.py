"""Elimination modulo many primes against the kernel in rationals."""

import math
import random
from decimal import Decimal
from fractions import Fraction as Q

import numpy as np
import pytest

from ratiospark.operators import modular
from ratiospark.operators.elimination import eliminate, inverse
from ratiospark.operators.matrix import ID
from ratiospark.sources.builders import from_literals


def made(seed, n):
    r = random.Random(seed)
    out = {}
    for k in range(n):
        rows, cols = r.randint(1, 6), r.randint(1, 7)
        pick = r.choice([lambda: r.choice([0, 0, 0, 1]), lambda: r.randint(-9, 9), lambda: Q(r.randint(-5, 5), r.randint(1, 7)), lambda: r.choice([0, 1, -1]) * r.randint(1, 10**12)])
        m = [[pick() for _ in range(cols)] for _ in range(rows)]
        if rows > 2 and r.random() < 0.5:
            m[r.randrange(rows)] = [a + b for a, b in zip(m[0], m[1], strict=True)]
        out[k] = m
    return out, {k: r.randint(0, len(m[0])) for k, m in out.items()}


def test_same_cells_as_the_kernel(spark):
    matrices, lines = made(1, 120)
    m = from_literals(spark, matrices, lines)
    done = {k: eliminate([[Q(x) for x in row] for row in v], lines[k], reduce=True) for k, v in matrices.items()}
    assert texts(m.rref_text().collect()) == {(k, i, j): x for k, r in done.items() for i, row in enumerate(r.rows) for j, x in enumerate(row)}
    assert {r[ID]: r["pivots"] for r in m.rref_text().collect()} == {k: r.pivots for k, r in done.items()}
    square = {k: [row[: min(len(v), len(v[0]))] for row in v[: min(len(v), len(v[0]))]] for k, v in matrices.items()}
    s = from_literals(spark, square)
    assert texts(s._exact_modular(True).collect()) == {(k, i, j): x for k, v in square.items() for i, row in enumerate(inverse([[Q(x) for x in r] for r in v])) for j, x in enumerate(row)}
    small = from_literals(spark, {1: [[2, 1], [4, 3]], 2: [[1, 2], [2, 4]]})
    assert sorted(small.rref_modular().cells.collect()) == sorted(small.rref().cells.collect())
    assert sorted(small.inverse_modular().cells.collect()) == sorted(small.inverse().cells.collect())


def texts(cells):
    return {(r[ID], r["i"], r["j"]): Q(int(r["num"]), int(r["den"])) for r in cells}


def test_rows_that_primes_get_wrong(spark):
    """Entries and minors that some of the primes divide: those primes take other rows and are left out."""
    p, q = modular.prime(0), modular.prime(1)
    matrices = {0: [[p, 1, 2], [1, 1, 1], [3, q, 1]], 1: [[p * q, 5], [7, 1]], 2: [[1, 1], [1, 1 + p]], 3: [[p, p], [p, p + q]]}
    m = from_literals(spark, matrices)
    assert sorted(m.rref_modular().cells.collect(), key=str) == sorted(m.rref().cells.collect(), key=str)


def test_hilbert_matrix(spark, monkeypatch):
    """Forty rows; the solution's numbers outgrow 38 digits on the way and partly at the end."""
    n = 40
    h = [[Q(1, i + j + 1) for j in range(n)] + [Q(1)] for i in range(n)]
    monkeypatch.setattr(modular, "BLOCK_CELLS", 100)
    found = from_literals(spark, {7: h}, {7: n}).rref_text().collect()
    got = {(r["i"], r["j"]): Q(int(r["num"]), int(r["den"])) for r in found}
    # the sums of an inverse Hilbert matrix's rows
    want = [(-1) ** (i + n - 1) * (i + 1) * math.comb(n + i, n) * math.comb(n - 1, i) for i in range(n)]
    want = [(-1) ** (n - 1 - i) * (n + i) * math.comb(n + i - 1, i) * math.comb(n - 1, i) for i in range(n)]
    assert [got[i, n] for i in range(n)] == [Q(x) for x in want]
    assert all(got[i, j] == (i == j) for i in range(n) for j in range(n))
    assert len(found) == n * (n + 1)


def test_large_random_system(spark):
    g = np.random.default_rng(2)
    n = 60
    a = g.integers(-99, 100, (n, n))
    b = g.integers(-99, 100, n)
    rows = [[int(x) for x in r] + [int(y)] for r, y in zip(a, b, strict=True)]
    x = {r["i"]: (int(r["num"]), int(r["den"])) for r in from_literals(spark, {1: rows}, {1: n}).rref_text().filter(f"j = {n}").collect()}
    shared = math.lcm(*(d for _, d in x.values()))
    whole = [x[i][0] * (shared // x[i][1]) for i in range(n)]
    assert [sum(int(v) * w for v, w in zip(r, whole, strict=True)) for r in a] == [int(y) * shared for y in b]
    assert shared > 10**60


def test_parts():
    r = random.Random(3)
    primes = [modular.prime(k) for k in range(12)]
    assert all(modular.prime(k) < 1 << 31 and all(modular.prime(k) % d for d in range(2, 2000)) for k in range(12))
    numbers = [r.randrange(math.prod(primes)) for _ in range(50)]
    assert modular.remaindered(np.array([[x % p for x in numbers] for p in primes]), primes) == (numbers, math.prod(primes))
    m, bound = math.prod(primes), 1 << 180
    some = [Q(r.randrange(-bound, bound), r.choice([1, 12, r.randrange(1, bound)])) for _ in range(80)]
    assert modular.rationals([x.numerator * pow(x.denominator, -1, m) % m for x in some], m, bound) == [(str(x.numerator), str(x.denominator)) for x in some]
    for _ in range(200):
        rows, cols = r.randint(1, 6), r.randint(1, 6)
        a = [[r.choice([0, 0, 1, -1, 5]) for _ in range(cols)] for _ in range(rows)]
        line, p = r.randint(0, cols), modular.prime(5)
        want = eliminate([[Q(x) for x in row] for row in a], line, reduce=True)
        got, origin, pivots = modular.reduce_modulo(np.array(a), line, p)
        assert origin == want.perm and pivots == want.pivots
        assert got.tolist() == [[x.numerator * pow(x.denominator, -1, p) % p for x in row] for row in want.rows]


def test_refusals(spark):
    m = from_literals(spark, {1: [[1, 2, 3], [4, 5, 6]]})
    with pytest.raises(Exception, match="only a square matrix"):
        m.inverse_modular().cells.collect()
    with pytest.raises(TypeError):
        m.to_double().rref_modular()


# bands and panels


@pytest.mark.parametrize("band", [3, 64])
def test_bands_give_the_same_cells(spark, band):
    matrices, lines = made(4, 25)
    matrices = {k: [[int(x * 420) for x in row] for row in m] for k, m in matrices.items()}
    m = from_literals(spark, matrices, lines)
    want = {}
    for r in m.rref_text().collect():
        want[r[ID], r["i"], r["j"]] = (r["num"], r["den"], r["pivots"])
    found = m.rref_tiled(band).collect()
    assert len(found) == len(want)
    for r in found:
        num, den, pivots = want[r[ID], r["i"], r["j"]]
        assert r["pivots"] == pivots
        if r["i"] < len(pivots) and (r["j"] < lines[r[ID]] or consistent(matrices[r[ID]], lines[r[ID]])):
            assert (r["num"], r["den"]) == (num, den)
        elif r["j"] < lines[r[ID]]:
            assert r["num"] == "0"


def consistent(rows, line):
    """Whether no row without coefficients is left with a constant; else the constants depend on the order of rows."""
    r = eliminate([[Q(x) for x in row] for row in rows], line, reduce=True)
    return not any(any(row[line:]) for row in r.rows[len(r.pivots) :])


def test_panels_of_a_larger_matrix(spark):
    g = np.random.default_rng(5)
    n = 70
    a = g.integers(-9, 10, (n, n))
    a[11], a[40] = a[3] + a[5], 0
    x = np.arange(n) - 30
    rows = [[*map(int, r), int(y)] for r, y in zip(a, a @ x, strict=True)]
    m = from_literals(spark, {1: rows}, {1: n})
    found = m.rref_tiled(32).collect()
    r = eliminate([[Q(v) for v in row] for row in rows], n, reduce=True)
    assert found[0]["pivots"] == r.pivots and len(r.pivots) == n - 2
    got = {(c["i"], c["j"]): Q(int(c["num"]), int(c["den"])) for c in found}
    assert all(got[i, j] == r.rows[i][j] for i in range(n) for j in range(n + 1))


def test_sparse_and_unsuitable_matrices(spark):
    df = spark.createDataFrame([(1, 0, 0, Decimal(10**30)), (1, 2, 1, Decimal(7))], "matrix_id long, i int, j int, val decimal(38,0)")
    from ratiospark.operators.matrix import MatrixFrame

    head = spark.createDataFrame([(1, 3, 2, 2)], "matrix_id long, n_rows int, n_cols int, augment int")
    got = {(r["i"], r["j"]): (r["num"], r["den"]) for r in MatrixFrame(df, head).rref_tiled(2).collect()}
    assert got == {(0, 0): ("1", "1"), (0, 1): ("0", "1"), (1, 0): ("0", "1"), (1, 1): ("1", "1"), (2, 0): ("0", "1"), (2, 1): ("0", "1")}
    with pytest.raises(TypeError):
        MatrixFrame(df, head).to_fraction().rref_tiled()
    with pytest.raises(ValueError):
        MatrixFrame(df, head).rref_tiled(65)


# products by tiles


@pytest.mark.parametrize("side", [1, 2, 64])
def test_products_by_tiles(spark, side):
    r = random.Random(6)
    a, b = {}, {}
    for k in range(12):
        n, m, p = (r.randint(1, 5) for _ in range(3))
        top = r.choice([3, 10**6, 10**17])
        a[k] = [[r.choice([0, r.randint(-top, top)]) for _ in range(m)] for _ in range(n)]
        b[k] = [[r.choice([0, r.randint(-top, top)]) for _ in range(p)] for _ in range(m)]
    x, y = from_literals(spark, a), from_literals(spark, b)
    want = sorted(x.matmul(y).cells.collect(), key=str)
    assert sorted(x.matmul_tiled(y, side).filled().cells.collect(), key=str) == want
    assert {tuple(c)[:3] for c in x.matmul_tiled(y, side).cells.filter("val <> 0").collect()} == {tuple(c)[:3] for c in want if c["val"]}
    with pytest.raises(Exception, match="columns meet"):
        from_literals(spark, {1: [[1, 2]]}).matmul_tiled(from_literals(spark, {1: [[1, 2]]})).cells.collect()


def test_tiles_move_few_rows(spark):
    """The join of tiles gives a row a pair of tiles, and the rows that are summed are a small part of all products of cells."""
    n = 96
    cells = spark.range(n * n).selectExpr("0L as matrix_id", f"cast(id div {n} as int) as i", f"cast(id % {n} as int) as j", "cast((id * 7919) % 101 - 50 as decimal(38,0)) as val")
    from ratiospark.operators import tiled

    a = [[(k * n + c) * 7919 % 101 - 50 for c in range(n)] for k in range(n)]
    got = {(r["i"], r["j"]): int(r["val"]) for r in tiled.product(cells, cells, 32).collect()}
    want = np.array(a) @ np.array(a)
    assert all(got.get((i, j), 0) == want[i, j] for i in range(n) for j in range(n))
    pairs = 3**3
    assert pairs * 32 * 32 * 10 < n**3
