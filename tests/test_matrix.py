import random
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from ratiospark.functions import frac, vec
from ratiospark.functions.arith import FRAC, INT
from ratiospark.operators.elimination import eliminate, inverse
from ratiospark.operators.matrix import ID, MatrixFrame
from ratiospark.plans.chain import chain_product, order
from ratiospark.sources.builders import from_dense, from_literals, scaled_identity

B = [[6, 2, 7, 4], [3, 8, 5, 6], [7, 2, 4, 1], [6, 9, 9, 3]]
T = [[8, 3, 4, 5], [9, 1, 2, 5], [8, 4, 5, 3], [7, 3, 6, 6]]
A = [[1, 2, 3, 4], [0, 9, 1, 8], [9, 8, 7, 6], [8, 6, 4, 2]]


def q(text):
    return [[Q(x) for x in row.split(",")] for row in text.strip("[]").split("] [")]


L_B = q("[1,0,0,0] [1/2,1,0,0] [7/6,-1/21,1,0] [1,1,-21/172,1]")
U_B = q("[6,2,7,4] [0,7,3/2,4] [0,0,-86/21,-73/21] [0,0,0,-933/172]")
UT = q("[150,60,87,85] [103,25,91/2,127/2] [-1199/21,-563/21,-124/3,-232/7] [-6531/172,-2799/172,-2799/86,-2799/86]")
RREF_A = q("[1,0,0,-15/17] [0,1,0,13/17] [0,0,1,19/17] [0,0,0,0]")
E_A = q("[0,-1/17,-3/17,11/34] [0,2/17,-4/85,9/170] [0,-1/17,36/85,-81/170] [1,0,-1,1]")
INV_B = q("[-23/311,15/311,80/311,-26/311] [-56/311,23/311,19/311,67/933] [59/311,-52/311,-70/311,146/933] [37/311,57/311,-7/311,-172/933]")
AB = [[57, 60, 65, 31], [82, 146, 121, 79], [163, 150, 185, 109], [106, 90, 120, 78]]
EAB = q("[12/17,-101/17,-16/17,23/17] [129/17,253/17,202/17,141/17] [233/17,205/17,239/17,74/17] [0,0,0,0]")


def values(m: MatrixFrame, key=1):
    found = {}
    for r in m.cells.filter(F.col(ID) == key).collect():
        found[r.i, r.j] = r.val if isinstance(r.val, float) else Q(int(r.val)) if not hasattr(r.val, "num") else Q(int(r.val.num), int(r.val.den))
    return [[found[i, j] for j in range(max(c for _, c in found) + 1)] for i in range(max(r for r, _ in found) + 1)]


def times(a, b):
    return [[sum(x * y for x, y in zip(r, c, strict=True)) for c in zip(*b, strict=True)] for r in a]


@pytest.fixture(scope="module")
def abt(spark):
    return {k: from_literals(spark, {1: m}) for k, m in {"A": A, "B": B, "T": T}.items()}


def test_demo_lu(abt):
    p, low, up = abt["B"].plu()
    assert values(p) == [[Q(i == j) for j in range(4)] for i in range(4)]
    assert values(low) == L_B and values(up) == U_B and values(abt["B"].lower()) == L_B
    assert values(low.matmul(up)) == B and values(up.matmul(abt["T"])) == UT


def test_demo_inverse(abt):
    e, r = abt["A"].inverse(), abt["A"].rref()
    assert values(e) == E_A and values(r) == RREF_A
    assert values(e.matmul(abt["A"])) == RREF_A and values(e.inverse().matmul(r)) == A
    assert values(abt["B"].inverse()) == INV_B
    assert values(abt["A"].matmul(abt["B"])) == AB and values(e.matmul(abt["A"].matmul(abt["B"]))) == EAB
    assert abt["A"].pivots().first().asDict() == {ID: 1, "pivots": [0, 1, 2], "rank": 3}


EDGE = {"D8": [[0, 0, 1], [0, 1, 0], [0, 0, 0]], "D9": [[1, 0, 0], [0, 0, 0], [1, 0, 0]], "D10": [[1, 1, 1], [2, 2, 3], [4, 5, 6]], "D11": [[0, 1, 0], [0, 0, 1], [1, 0, 0]], "D12": [[1, 1], [1, 1], [1, 2]], "D13": [[0, 1], [0, 2]]}


def random_matrices():
    rng = random.Random(5)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        yield [[rng.choice([0, 0, 1, -1, 2, 3, Q(1, 2)]) for _ in range(m)] for _ in range(n)]
    yield [[0] * 3] * 3
    yield [[0]]
    yield [[7]]


def textbook(rows):
    a, lead = [[Q(x) for x in r] for r in rows], 0
    for col in range(len(a[0])):
        pick = next((i for i in range(lead, len(a)) if a[i][col]), None)
        if pick is None:
            continue
        a[lead], a[pick] = a[pick], a[lead]
        a[lead] = [x / a[lead][col] for x in a[lead]]
        for i in range(len(a)):
            if i != lead:
                a[i] = [x - a[i][col] * y for x, y in zip(a[i], a[lead], strict=True)]
        lead += 1
        if lead == len(a):
            break
    return a


@pytest.mark.parametrize("m", [*EDGE.values(), *random_matrices()])
def test_kernel(m):
    m = [[Q(x) for x in r] for r in m]
    assert eliminate(m, len(m[0]), reduce=True).rows == textbook(m)
    r = eliminate(m, len(m[0]))
    assert times(r.lower, r.rows) == [m[k] for k in r.perm]
    assert all(r.lower[i][j] == (i == j) for i in range(len(m)) for j in range(i, len(m)))
    if len(m) == len(m[0]):
        e = inverse(m)
        assert times(e, m) == textbook(m) and times(inverse(e), e) == [[Q(i == j) for j in range(len(m))] for i in range(len(m))]


def test_native_reduced_form(spark):
    rng = random.Random(8)
    given = {k: [[rng.choice([0, 0, 1, -1, 2, -7, 30]) for _ in range(m)] for _ in range(n)] for k, (n, m) in enumerate((rng.randint(1, 4), rng.randint(1, 5)) for _ in range(60))}
    given |= {100 + k: m for k, m in enumerate(EDGE.values())} | {200: [[0, 0], [0, 0]]}
    out = from_literals(spark, given).rref_native()
    found = {}
    for r in out.cells.collect():
        found.setdefault(r.matrix_id, {})[r.i, r.j] = Q(int(r.val.num), int(r.val.den))
    for k, m in given.items():
        assert [[found[k][i, j] for j in range(len(m[0]))] for i in range(len(m))] == textbook(m)
    plan = out.cells._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInPandas" not in plan
    solved = from_literals(spark, {1: [[1, 1, 1, 6], [0, 2, 5, -4], [2, 5, -1, 27]]}).augment_line()
    assert values(solved.rref_native()) == values(solved.rref())


def test_edges_on_spark(spark):
    frame = from_literals(spark, {i: m for i, m in enumerate(EDGE.values())})
    low, up = frame.lower_upper()
    back = low.matmul(up)
    for i, m in enumerate(EDGE.values()):
        assert values(back, i) == m
    assert values(frame.block(slice(0, 3), slice(0, 3)).rref(), 0) == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]
    assert values(from_literals(spark, {1: EDGE["D9"]}).inverse()) == [[0, 0, 1], [1, 0, -1], [0, 1, 0]]


def test_augmented(spark):
    rows = [[1, 1, 1, 6], [0, 2, 5, -4], [2, 5, -1, 27]]
    r = values(from_literals(spark, {1: rows}).augment_line().rref())
    assert r == [[1, 0, 0, 5], [0, 1, 0, 3], [0, 0, 1, -2]]
    m = from_literals(spark, {1: [[1, 1, 1, 1], [1, 1, 1, 2], [2, 2, 2, 5]]}, {1: 3})
    assert m.pivots().first().pivots == [0]
    assert [x[:3] for x in values(m.rref())] == [[1, 1, 1], [0, 0, 0], [0, 0, 0]]


def test_trace(spark):
    got = from_literals(spark, {1: [[0, 2], [3, 1]]}).trace().orderBy("step").select("op", "label").collect()
    assert [tuple(r) for r in got] == [("swap", "R1 <-> R2"), ("scale", "1/2R2"), ("add", "R1 - R2"), ("scale", "1/3R1")]


def test_trace_of_the_echelon_form_alone(spark):
    m = from_literals(spark, {1: [[0, 2], [3, 1]], 2: [[2, 1], [1, 1]]})
    got = m.trace(reduced=False).orderBy(ID, "step").select(ID, "op", "label").collect()
    assert [tuple(r) for r in got] == [(1, "swap", "R1 <-> R2"), (2, "add", "R2 - 1/2R1")]


def test_floats(spark):
    whole, part = from_literals(spark, {1: [[1, 2], [3, 4]]}), from_literals(spark, {1: [[Q(1, 2), Q(1, 3)], [0, 2]]})
    assert values(whole.scale(0.5)) == [[0.5, 1.0], [1.5, 2.0]] and values(part.scale(0.5)) == [[0.25, 1 / 3 * 0.5], [0.0, 1.0]]
    assert values(whole.scale(Q(1, 2))) == values(part.scale(Q(1, 2)).scale(0).plus(whole.scale(Q(1, 2)))) == [[Q(1, 2), 1], [Q(3, 2), 2]]
    assert values(whole.scale(frac.real(F.lit(0.5)))) == values(whole.scale(0.5)) and whole.scale(0.5).kind.name == "double"
    for m in (whole, part):
        with pytest.raises(Exception, match="is no whole number"):
            m.scale(F.lit(0.5)).cells.collect()
    real = from_literals(spark, {1: [[0.5, 0.0], [0.0, 2.0]]})
    assert values(whole.matmul(real)) == [[0.5, 4.0], [1.5, 8.0]] and values(real.matmul(part)) == [[0.25, 1 / 3 * 0.5], [0.0, 4.0]]
    assert values(whole.plus(real)) == [[1.5, 2.0], [3.0, 6.0]] and values(real.scale(frac.frac(1, 2))) == [[0.25, 0.0], [0.0, 1.0]]
    with pytest.raises(TypeError):
        real.to_fraction()


def test_elimination_of_doubles(spark):
    m = from_literals(spark, {1: [[0.1, 0.2, 0.3], [0.3, 0.6, 0.5]]})
    u = values(m.ref())
    exact = eliminate([[Q(x) for x in r] for r in [[0.1, 0.2, 0.3], [0.3, 0.6, 0.5]]], 3).rows
    assert u == [[float(x) for x in r] for r in exact] and m.ref().kind.name == "double"
    p, low, up = from_literals(spark, {1: [[0.0, 2.0], [0.5, 1.0]]}).plu()
    assert values(p) == [[0, 1], [1, 0]] and values(low.matmul(up)) == [[0.5, 1.0], [0.0, 2.0]]
    assert values(from_literals(spark, {1: [[0.5, 0.0], [0.0, 4.0]]}).inverse()) == [[2.0, 0.0], [0.0, 0.25]]


def test_lists_are_inserted(spark):
    m = from_literals(spark, {1: [[1, 2], [3, 4]], 2: [[5, 6], [7, 8]]})
    assert values(m.insert_rows([9, 0], pos=1)) == [[1, 2], [9, 0], [3, 4]] and values(m.insert_rows([9, 0]), 2) == [[5, 6], [7, 8], [9, 0]]
    assert values(m.insert_cols([[7, 8], [Q(1, 2), 0]], pos=0)) == [[7, Q(1, 2), 1, 2], [8, 0, 3, 4]]
    assert values(m.insert_rows([[0.5, 1.5]])) == [[1.0, 2.0], [3.0, 4.0], [0.5, 1.5]]
    with pytest.raises(ValueError):
        m.insert_rows([[1], [2, 3]])
    with pytest.raises(Exception, match="meet"):
        m.insert_rows([1, 2, 3]).cells.collect()


def test_headers_do_not_run_the_kernel(spark, abt):
    for f in (abt["A"].rref(), abt["A"].inverse(), *abt["A"].plu()):
        assert "MapInPandas" not in f.header._jdf.queryExecution().executedPlan().toString()
    assert abt["A"].plu()[1].header.first().asDict() == {ID: 1, "n_rows": 4, "n_cols": 4, "augment": 4}


def test_positions(spark):
    m = from_literals(spark, {1: [[1, 2, 3], [4, 5, 6], [7, 8, 9]]})
    assert values(m.transpose()) == [[1, 4, 7], [2, 5, 8], [3, 6, 9]]
    assert values(m.swap_rows(0, -1).swap_rows(0, -1)) == values(m)
    assert values(m.swap_cols(0, 1))[0] == [2, 1, 3]
    assert values(m.block(slice(-2, 9), slice(0, 1))) == [[4], [7]]
    assert m.block(slice(2, 1), slice(None)).cells.isEmpty()
    row = m.scale(10).block(slice(0, 1), slice(None))
    wide = m.insert_rows(row, pos=1)
    assert values(wide) == [[1, 2, 3], [10, 20, 30], [4, 5, 6], [7, 8, 9]] and values(wide.block(slice(1, 2), slice(None))) == values(row)
    assert values(m.insert_rows(row))[-1] == [10, 20, 30]
    col = m.block(slice(None), slice(0, 1))
    assert m.augment_line().insert_cols(col, pos=0).header.first().augment == 3 and m.insert_cols(col).header.first().augment == 4
    assert m.insert_rows(row).header.first().augment == 3
    assert values(m.assign(from_literals(spark, {1: [[0, 0]]}).cells, row=2, col=1))[2] == [7, 0, 0]
    assert values(m.assign_cell(-1, -1, F.lit(0).cast(frac.DECIMAL)))[2][2] == 0
    for bad in (m.cell(3, 0), m.assign(from_literals(spark, {1: [[1]]}).cells, row=3).cells, m.insert_rows(col).cells, m.matmul(row).cells):
        with pytest.raises(Exception, match="out of range|meet"):
            bad.collect()
    with pytest.raises(ValueError):
        m.row(0, slice(0, 3, 2))


def test_shapes(spark):
    with pytest.raises(ValueError):
        from_literals(spark, {1: [[1], [2, 3]]})
    with pytest.raises(ValueError):
        from_literals(spark, {1: []})
    with pytest.raises(Exception, match="ragged"):
        from_dense(spark.createDataFrame([(1, [[1, 2], [3]])], "matrix_id long, m array<array<long>>")).cells.collect()
    whole = from_literals(spark, {1: [[1, 2], [3, 4]]})
    with pytest.raises(Exception, match="ragged"):
        MatrixFrame(whole.cells.filter("NOT (i = 1 AND j = 0)"), whole.header).checked().header.collect()
    with pytest.raises(Exception, match="square"):
        from_literals(spark, {1: [[1, 2]]}).inverse().cells.collect()
    with pytest.raises(Exception, match="at least one row"):
        scaled_identity(spark.createDataFrame([(1, 0)], "matrix_id long, n int")).cells.collect()


def test_sums_products_text(spark):
    m = from_literals(spark, {1: [[Q(1, 2), Q(1, 3)], [Q(1, 6), 2]]})
    r = m.sum().first()
    assert Q(int(r.val.num), int(r.val.den)) == 3
    assert values(m.plus(m)) == values(m.scale(2)) and values(m.minus(m)) == [[0, 0], [0, 0]] and values(m.negate()) == values(m.scale(-1))
    assert values(m.matmul(m)) == times(values(m), values(m))
    assert m.repr().first().text == "Matrix([[fraction(1, 2), fraction(1, 3)], [fraction(1, 6), fraction(2, 1)]])"
    assert m.render().first().text == "[ 0.500  0.333 ]\n[ 0.167  2.000 ]\n"
    assert from_literals(spark, {1: [[1, -20, 3]]}).augment_line().render().first().text == "[  1   -20  |   3  ]\n"
    v = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "matrix_id long, idx int, val int").withColumn("val", F.col("val").cast(frac.DECIMAL))
    w = from_literals(spark, {1: [[1, 2], [3, 4]]})
    assert values(w.matvec(v)) == [[4], [10]] and values(w.vecmat(v)) == [[5, 8]]
    assert order([10, 30, 5, 60]) == ((0, 1), 2)
    assert values(chain_product([w, w, w], [2, 2, 2, 2])) == times(times([[1, 2], [3, 4]], [[1, 2], [3, 4]]), [[1, 2], [3, 4]])


def test_vectors(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5, 6], [1], [[1], [2]], [[3], [4]])], "v array<long>, w array<long>, s array<long>, m array<array<long>>, n array<array<long>>")
    got = df.select(
        vec.add(F.col("v"), F.col("w"), INT), vec.dot(F.col("v"), F.col("w"), INT), vec.outer(F.col("v"), F.col("w"), INT), vec.nested(vec.add, F.col("m"), F.col("n"), INT), vec.slice_(F.col("v"), -2, 9),
        vec.get(F.col("v"), -1), vec.rdiv_scalar(F.lit(6), F.col("v"), INT), vec.text(F.col("v"), INT), vec.dot(F.array().cast("array<long>"), F.array().cast("array<long>"), INT), vec.text(vec.to_frac(F.col("s")), FRAC),
    ).first()
    ints = lambda x: [int(y) for y in x]
    assert ints(got[0]) == [5, 7, 9] and int(got[1]) == 32 and [ints(r) for r in got[2]] == [[4, 5, 6], [8, 10, 12], [12, 15, 18]]
    assert [ints(r) for r in got[3]] == [[4], [6]] and got[4] == [2, 3] and got[5] == 3 and [Q(int(x.num), int(x.den)) for x in got[6]] == [6, 3, 2]
    assert got[7] == "[ 1  2  3 ]" and int(got[8]) == 0 and got[9] == "[ 1.000 ]"
    with pytest.raises(Exception, match="lengths 3 and 1 differ"):
        df.select(vec.add(F.col("v"), F.col("s"), INT)).collect()


def test_plan_of_products(spark, abt, tmp_path):
    abt["B"].cells.write.parquet(str(tmp_path / "b"))
    b = MatrixFrame(spark.read.parquet(str(tmp_path / "b")), abt["B"].header)
    plan = abt["A"].matmul(b).cells._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("reduced", [True, False])
def test_replay_of_changes(spark, reduced):
    """The steps' rows and the replayed matrices against the whole trace and the eliminated form."""
    r = random.Random(9)
    made = {k: [[r.choice([0, 0, 1, -2, 3, Q(1, 2)]) for _ in range(c)] for _ in range(n)] for k, (n, c) in enumerate([(1, 1), (3, 3), (4, 2), (2, 5), (4, 5), (3, 4)])}
    made[9] = [[1, 0], [0, 1]]
    m = from_literals(spark, made, {3: 3, 4: 4})
    steps = m.changes(reduced)
    want = m.rref() if reduced else m.ref()
    assert sorted(m.replay(steps).cells.collect(), key=str) == sorted(want.to_fraction().cells.select(ID, "i", "j", "val").collect(), key=str)
    whole = {(x[ID], x["step"]): x for x in m.trace(reduced).collect()}
    seen = steps.collect()
    assert len(seen) == len(whole) and 9 not in {x[ID] for x in seen}
    for x in seen:
        w, cols = whole[x[ID], x["step"]], len(made[x[ID]][0])
        assert (x["op"], x["label"]) == (w["op"], w["label"]) and len(x["num"]) == (0 if x["op"] == "swap" else cols)
        if x["op"] != "swap":
            assert x["num"] == w["num"][x["target"] * cols : (x["target"] + 1) * cols] and x["den"] == w["den"][x["target"] * cols : (x["target"] + 1) * cols]
    with pytest.raises(TypeError):
        m.to_double().replay(steps)
