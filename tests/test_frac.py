import math
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ratiospark.functions import batch, frac

ROWS = [(1, 2, 1, 3), (-4, 6, 2, -4), (0, 5, 7, 7), (10**17 + 1, 3, 10**17, 3), (5, 1, -5, 10), (12, -18, 0, 1), (999999999999999989, 999999999999999877, 1, 2)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "a long, b long, c long, d long").select("*", frac.frac(F.col("a"), F.col("b")).alias("x"), frac.frac(F.col("c"), F.col("d")).alias("y"))


def value(r):
    return Fraction(int(r["num"]), int(r["den"]))


@pytest.mark.parametrize("op, want", [("add", lambda x, y: x + y), ("sub", lambda x, y: x - y), ("mul", lambda x, y: x * y)])
def test_arithmetic(df, op, want):
    for r in df.select("*", getattr(frac, op)(frac.mark(F.col("x")), frac.mark(F.col("y"))).alias("z")).collect():
        exact = want(Fraction(r.a, r.b), Fraction(r.c, r.d))
        assert (int(r.z["num"]), int(r.z["den"])) == (exact.numerator, exact.denominator)


def test_comparisons_are_exact(df):
    x, y = frac.mark(F.col("x")), frac.mark(F.col("y"))
    for r in df.select("*", *[getattr(frac, n)(x, y).alias(n) for n in ("eq", "lt", "le", "gt", "ge")]).collect():
        p, q = Fraction(r.a, r.b), Fraction(r.c, r.d)
        assert (r.eq, r.lt, r.le, r.gt, r.ge) == (p == q, p < q, p <= q, p > q, p >= q)


def test_division(spark):
    one = spark.range(1)
    got = one.select(
        frac.div(0, frac.frac(1, 2)).alias("zero"), frac.frac(1, frac.frac(1, 2)).alias("nested"), frac.try_div(1, 0).alias("none"),
        frac.eq(frac.frac(10**17 + 1), frac.frac(10**17)).alias("same"), frac.div(frac.frac(2, 3), frac.frac(-4, 9)).alias("sign"),
    ).first()
    assert value(got.zero) == 0 and value(got.nested) == 2 and got.none is None and got.same is False and value(got.sign) == Fraction(-3, 2)
    with pytest.raises(Exception, match="division by zero"):
        one.select(frac.div(1, 0)).collect()
    with pytest.raises(TypeError):
        frac.frac(0.5)


def test_floats_promote_and_fractions_are_refused(spark):
    one, half = spark.range(1), Fraction(1, 2)
    third, x = frac.frac(1, 3), frac.real(F.lit(0.5))
    got = one.select(
        frac.add(third, 0.5).alias("a"), frac.sub(0.5, third).alias("b"), frac.mul(third, x).alias("c"), frac.div(third, 0.25).alias("d"), frac.add(frac.add(1, 0.5), third).alias("e"),
        frac.lt(third, 0.5).alias("f"), frac.eq(frac.frac(1, 2), x).alias("g"), frac.try_div(third, 0.0).alias("h"), frac.add(half, third).alias("i"),
    ).first()
    assert tuple(got)[:8] == (1 / 3 + 0.5, 0.5 - 1 / 3, 1 / 3 * 0.5, 1 / 3 / 0.25, 1.5 + 1 / 3, True, True, None) and value(got.i) == Fraction(5, 6)
    for bad in (frac.frac(F.lit(0.5)), frac.add(third, F.lit(0.5)), frac.frac(1, F.lit(Decimal("2.50"))), frac.whole(F.lit(float("nan")))):
        with pytest.raises(Exception, match="is no whole number"):
            one.select(bad).collect()
    assert value(one.select(frac.frac(F.lit(4.0), F.lit(Decimal("6.00"))).alias("x")).first().x) == Fraction(2, 3)


def test_long_numbers_and_overflow(spark):
    big = Decimal("12345678901234567890123456789012345670")
    df = spark.createDataFrame([(big,)], "n decimal(38,0)")
    r = df.select(frac.frac(F.col("n"), 70).alias("x")).first().x
    assert value(r) == Fraction(int(big), 70)
    with pytest.raises(Exception, match="(?i)overflow|NUMERIC_VALUE_OUT_OF_RANGE"):
        df.select(frac.mul(F.col("n"), F.col("n"))).collect()


def test_gcd_null_text(spark):
    df = spark.createDataFrame([(0, 0), (0, -6), (-12, 18), (9223372036854775807, 9223372036854775806), (None, 3)], "a long, b long")
    assert [int(r[0]) if r[0] is not None else None for r in df.select(frac.gcd(F.col("a"), F.col("b"))).collect()] == [0, 6, 6, 1, None]
    assert spark.createDataFrame([(None,)], "a long").select(frac.add(F.col("a"), 1).alias("x")).first().x is None
    r = spark.range(1).select(frac.text(frac.frac(1, 16)).alias("t"), frac.repr_(frac.frac(2, -6)).alias("r"), frac.ratio(frac.frac(4, 2)).alias("q")).first()
    assert tuple(r) == ("0.062", "fraction(-1, 3)", "2")


def long_pairs(n, seed):
    """Operands of up to 38 digits: random, near each other, of common denominators, and of every sign."""
    r = random.Random(seed)
    whole = lambda: r.choice([-1, 1]) * r.randrange(10 ** r.randint(0, 38))
    rows = [(1, 10**20, 1, 10**20), (10**20, 3, 10**20, 7 * 10**19 + 1), (10**38 - 1, 10**38 - 2, 10**38 - 2, 10**38 - 3), (1 - 10**38, 1, 10**38 - 1, 1), (0, 1, 1, 10**38 - 1), (-(10**37), 3, -(10**37) - 1, 3)]
    for _ in range(n):
        a, b = whole(), abs(whole()) or 1
        rows.append((a, b, whole(), abs(whole()) or 1))
        rows.append((a, b, a + r.choice([-1, 0, 1]) if abs(a) < 10**38 - 1 else a, b))
        d = abs(whole()) % 10**18 + 1
        rows.append((whole() % 10**18, d, -(whole() % 10**18), d * r.randint(1, 9)))
    return rows


def test_comparison_of_any_two(spark):
    rows = long_pairs(150, 1)
    pair = lambda p, q: frac.mark(F.struct(F.col(p).cast(frac.DECIMAL).alias("num"), F.col(q).cast(frac.DECIMAL).alias("den")))
    reduced = [(f.numerator, f.denominator, g.numerator, g.denominator) for f, g in ((Fraction(a, b), Fraction(c, d)) for a, b, c, d in rows)]
    df = spark.createDataFrame([tuple(map(str, r)) for r in reduced], "a string, b string, c string, d string")
    x, y = pair("a", "b"), pair("c", "d")
    for r in df.select("*", frac.compare(x, y).alias("z"), *[getattr(frac, n)(x, y).alias(n) for n in ("lt", "le", "gt", "ge", "eq")]).collect():
        p, q = Fraction(int(r.a), int(r.b)), Fraction(int(r.c), int(r.d))
        assert (r.z, r.lt, r.le, r.gt, r.ge, r.eq) == ((p > q) - (p < q), p < q, p <= q, p > q, p >= q, p == q), (p, q)
    assert spark.range(1).select(frac.compare(F.lit(None).cast("long"), 1).alias("x"), frac.lt(frac.frac(1, 3), 0.5).alias("y")).first()[:] == (None, True)


def within(f, *parts):
    """Whether result and the parts that the method multiplies fit 38 digits."""
    return all(abs(v) < 10**38 for v in (f.numerator, f.denominator, *parts))


@pytest.mark.parametrize("op", ["add", "sub", "mul", "div"])
def test_results_that_fit_are_given(spark, op):
    """Intermediates are no longer than the operands' common form: sums by the divisor of the denominators, products cancelled crosswise."""
    rows = []
    for a, b, c, d in long_pairs(120, 2):
        p, q = Fraction(a, b), Fraction(c, d)
        g = math.gcd(p.denominator, q.denominator)
        u, v = p.numerator * (q.denominator // g), q.numerator * (p.denominator // g)
        want = p + q if op == "add" else p - q if op == "sub" else p * q if op == "mul" else p / q if q else None
        if want is not None and within(want, *((u, v, u + v, u - v) if op in ("add", "sub") else ())):
            rows.append((*map(str, (p.numerator, p.denominator, q.numerator, q.denominator, want.numerator, want.denominator)),))
    pair = lambda p, q: frac.mark(F.struct(F.col(p).cast(frac.DECIMAL).alias("num"), F.col(q).cast(frac.DECIMAL).alias("den")))
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, n string, m string")
    got = df.select("n", "m", getattr(frac, op)(pair("a", "b"), pair("c", "d")).alias("z")).collect()
    assert len(got) > 60 and all((str(int(r.z["num"])), str(int(r.z["den"]))) == (r.n, r.m) for r in got)


def test_sums_that_cancel(spark):
    r = spark.range(1).select(frac.add(frac.frac(1, F.lit(Decimal(10**20))), frac.frac(1, F.lit(Decimal(10**20)))).alias("x")).first().x
    assert value(r) == Fraction(1, 5 * 10**19)


def rounded(f, digits):
    n, d = abs(f.numerator) * 10**digits, f.denominator
    q, r = divmod(n, d)
    q += 2 * r > d or 2 * r == d and q % 2
    s = str(q).rjust(digits + 1, "0")
    return ("-" if f < 0 else "") + (f"{s[:-digits]}.{s[-digits:]}" if digits else s)


@pytest.mark.parametrize("digits", [3, 0, 7])
def test_text_is_exact(spark, digits):
    numbers = [Fraction(a, b) for a, b, _, _ in long_pairs(100, 3)] + [Fraction(10**30, 7), Fraction(-1, 3000), Fraction(1, 2000), Fraction(3, 2000), Fraction(1999, 2000), Fraction(-19999, 20000), Fraction(10**38 - 1, 10**38 - 2), Fraction(1, 10**37 * 3), Fraction(5, 2), Fraction(7, 2), Fraction(0)]
    numbers = [f for f in numbers if within(f)]
    df = spark.createDataFrame([(str(f.numerator), str(f.denominator)) for f in numbers], "a string, b string")
    x = frac.mark(F.struct(F.col("a").cast(frac.DECIMAL).alias("num"), F.col("b").cast(frac.DECIMAL).alias("den")))
    for r in df.select("*", frac.text(x, digits).alias("t")).collect():
        assert r.t == rounded(Fraction(int(r.a), int(r.b)), digits), (r.a, r.b)
    assert spark.range(1).select(frac.text(frac.frac(F.lit(None).cast("long"), 2)).alias("t")).first().t is None


def test_long_expressions_stay_short(spark):
    """Operands are computed once each, so that nested operations don't multiply."""
    df = spark.createDataFrame([(k, k + 2) for k in range(1, 9)], "a long, b long")
    x, want = frac.frac(F.col("a"), F.col("b")), lambda a, b: Fraction(a, b)
    y = x
    for k in range(2, 3):
        y = frac.neg(frac.div(frac.add(frac.mul(y, x), frac.frac(1, k)), frac.frac(k, 3)))
    for r in df.select("a", "b", y.alias("y"), frac.lt(y, x).alias("less"), frac.text(y).alias("t")).collect():
        q = p = want(r.a, r.b)
        for k in range(2, 3):
            q = -(q * p + Fraction(1, k)) / Fraction(k, 3)
        assert value(r.y) == q and r.less == (q < p) and r.t == rounded(q, 3)


def given_long(spark, rows):
    df = spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], "a string, b string, c string, d string")
    return df.select("*", *[batch.pair(F.col(p), F.col(q)).alias(n) for p, q, n in (("a", "b", "x"), ("c", "d", "y"))])


@pytest.mark.parametrize("op", ["add", "sub", "compare"])
def test_batches_of_long_numbers(spark, op):
    """Whatever result fits is given, also where what lies between has over 38 digits; operands may be unreduced, with negative denominators."""
    rows = [(a, -b, c, d) for a, b, c, d in long_pairs(100, 4) if b < 10**38] + long_pairs(100, 5) + [(3, -6, 2, 4), (-(2**63), 1, 2**63 - 1, 1), (2**63, 1, 2**64 - 1, 1), (0, -5, 0, 7)]
    want = {"add": lambda p, q: p + q, "sub": lambda p, q: p - q, "compare": lambda p, q: (p > q) - (p < q)}[op]
    rows = [r for r in rows if op == "compare" or within(want(Fraction(*r[:2]), Fraction(*r[2:])))]
    got = given_long(spark, rows).repartition(3).select("a", "b", "c", "d", getattr(batch, op)(F.col("x"), F.col("y")).alias("z")).collect()
    assert len(got) == len(rows) > 100
    for r in got:
        exact = want(Fraction(int(r.a), int(r.b)), Fraction(int(r.c), int(r.d)))
        assert r.z == exact if op == "compare" else (int(r.z["num"]), int(r.z["den"])) == (exact.numerator, exact.denominator)


def test_batches_with_nulls_and_errors(spark):
    df = given_long(spark, [(1, 2, 1, 3), (None, 2, 1, 3), (1, 2, 10**30, None), (1, 2, 1, 2)]).coalesce(1)
    got = df.select(batch.add(F.when(F.col("c") != "9", F.col("x")), F.col("y")).alias("z"), batch.compare(F.col("x"), F.col("y")).alias("c")).collect()
    assert [r.z and value(r.z) for r in got] == [Fraction(5, 6), None, None, 1] and [r.c for r in got] == [1, None, None, 0]
    assert df.filter("a = '7'").select(batch.add(F.col("x"), F.col("y"))).collect() == []
    with pytest.raises(Exception, match="division by zero"):
        given_long(spark, [(1, 0, 1, 3)]).select(batch.compare(F.col("x"), F.col("y"))).collect()
    with pytest.raises(Exception, match="more than 38 digits"):
        given_long(spark, [(10**38 - 1, 1, 1, 1)]).select(batch.add(F.col("x"), F.col("y"))).collect()


@pytest.mark.parametrize("name", ["frac_add_large", "frac_compare_large"])
def test_long_numbers_go_in_batches(spark, tmp_path, name):
    """Folds over decimals of many digits are interpreted node by node, some hundred times for each row."""
    from ratiospark.plans import catalogue

    spark.createDataFrame([(1, 2, 3, 4, 5.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "aggregate(" not in plan


def test_quotients_of_whole_numbers(spark):
    """Of 64 bits and beyond, whole decimals and doubles, nulls; fractions and zero divisors raise errors, also within lambdas."""
    rows = [(6, -4), (0, -3), (-(2**63), 2), (2**63, 6), (10**18, 4), (1 - 10**18, 3), (10**37, 15), (5, 10**38 - 1), (None, 3), (3, None)]
    df = spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], "a string, b string").select(F.col("a").cast(frac.DECIMAL).alias("a"), F.col("b").cast(frac.DECIMAL).alias("b"))
    got = df.coalesce(1).select(frac.of_wholes(F.col("a"), F.col("b")).alias("x"), F.get(F.transform(F.array("b"), lambda y: frac.of_wholes(6, y)), F.lit(0)).alias("y")).collect()
    assert [r.x and value(r.x) for r in got] == [None if None in r else Fraction(*r) for r in rows]
    assert [r.y and value(r.y) for r in got] == [b and Fraction(6, b) for _, b in rows]
    one = spark.range(1)
    assert value(one.select(frac.of_wholes(F.lit(4.0), F.lit(Decimal("6.00"))).alias("x")).first().x) == Fraction(2, 3)
    for bad, why in ((F.lit(2.5), "is no whole number"), (F.lit(Decimal("0.5")), "is no whole number"), (F.col("id"), "division by zero")):
        with pytest.raises(Exception, match=why):
            one.select(frac.of_wholes(1, bad)).collect()
