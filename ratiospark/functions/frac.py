"""Exact rational numbers: STRUCT<num: DECIMAL(38,0), den: DECIMAL(38,0)> with den > 0 and gcd(num, den) = 1; zero is 0/1.

Every function takes and gives Columns and stays within the JVM. A NULL operand gives NULL. Numbers beyond 38 digits raise an
error (ANSI mode), they never wrap. The canonical form makes struct equality exact, so rationals can be grouped and joined.

A float, or a column said to hold doubles by `real`, makes the result of + - * / a double and comparisons those of doubles. Any other
column with a number that isn't whole raises an error; nothing is rounded.

A handful of operations may be nested; longer chains belong into columns of their own (withColumn), as Spark resolves nested lambdas level by level."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,0)"
#: Numbers under this are safe in 64 bits.
SHORT = 10**18
TYPE = f"struct<num:{DECIMAL},den:{DECIMAL}>"


def _dec(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(Decimal(c))).cast(DECIMAL)


def exact(c) -> Column:
    """A whole number as a decimal; a number with a fraction raises an error, as does a float."""
    if isinstance(c, float):
        raise TypeError(f"{c!r} is no exact number")
    return F.when(c % 1 != 0, F.raise_error(F.format_string("%s is no whole number", c.cast("string"))).cast(DECIMAL)).otherwise(c.cast(DECIMAL)) if isinstance(c, Column) else _dec(c)


def negated(x: Column) -> Column:
    """-x of a decimal. Spark's own minus and abs round beyond 34 digits."""
    return (F.lit(0).cast(DECIMAL) - x).cast(DECIMAL)


def size(x: Column) -> Column:
    """The absolute value of a decimal, exactly."""
    return F.when(x < 0, negated(x)).otherwise(x)


def _under(x: Column, limit: int) -> Column:
    return (x < _dec(limit)) & (x > _dec(-limit))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quotient(a: Column, b: Column) -> Column:
    """The whole part of a / b for b > 0, towards zero, in decimals of any length (`div` would wrap to 64 bits). A decimal division keeps
    32 digits before its point; a longer quotient, of a divisor under 10^6, is put together from two parts."""
    direct = lambda x, y: ((x - x % y) / y).cast(DECIMAL)
    half = _dec(10**18)
    high, low = direct(a, half), (a % half).cast(DECIMAL)
    rest = ((high % b).cast(DECIMAL) * half + low).cast(DECIMAL)
    return F.when(_under(a, 10**32) | (b >= 10**6), direct(a, b)).otherwise((direct(high, b) * half + direct(rest, b)).cast(DECIMAL))


def gcd(a, b) -> Column:
    """Greatest common divisor, never negative; gcd(0, 0) = 0. As many steps of Euclid's method as the shorter number's digits need at most."""
    a, b = size(_dec(a)), size(_dec(b))
    digits = F.least(F.length(a.cast("string")), F.length(b.cast("string")))
    steps = F.sequence(F.lit(1), digits * 5 + 1)  # at most 4.79 for each digit

    def step(s: Column, _: Column) -> Column:
        return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(DECIMAL).alias("b")))

    found = F.aggregate(steps, F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), step, lambda s: s["a"])
    return F.when(a.isNotNull() & b.isNotNull(), found)


def gcd_long(a: Column, b: Column) -> Column:
    """gcd of two 64-bit numbers."""
    a, b = F.abs(a.cast("long")), F.abs(b.cast("long"))
    steps = F.sequence(F.lit(1), F.length(F.least(a, b).cast("string")) * 5 + 1)
    found = F.aggregate(steps, F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))), lambda s: s["a"])
    return F.when(a.isNotNull() & b.isNotNull(), found)


def _pair(num: Column, den: Column) -> Column:
    return F.struct(num.cast(DECIMAL).alias("num"), den.cast(DECIMAL).alias("den"))


def frac(num, den=1) -> Column:
    """num / den in lowest terms; both may be integers or rationals. A zero denominator raises an error, as does a fractional number."""
    if any(isinstance(x, float) for x in (num, den)):
        raise TypeError("a float is no exact number")
    if not marked(num) and not marked(den):
        return reduced(exact(num), exact(den))
    return div(num, den)


def of_wholes(a, b) -> Column:
    """frac of two numbers that are no rationals. Numbers of 64 bits, which most are, are told by a cast and stay in 64 bits throughout; the rest takes the long way."""
    a, b = (x if isinstance(x, Column) else exact(x) for x in (a, b))
    given = F.struct(a.try_cast("long").alias("n"), b.try_cast("long").alias("d"), a.alias("a"), b.alias("b"))
    over = lambda v, g: F.call_function("div", v, g)

    def short(x: Column) -> Column:
        divisor = gcd_long(x["n"], x["d"]) * F.when(x["d"] < 0, -1).otherwise(1)
        return let(F.struct(x["n"].alias("n"), x["d"].alias("d"), divisor.alias("g")), lambda y: _pair(over(y["n"], y["g"]), over(y["d"], y["g"])))

    few = lambda v: (v < SHORT) & (v > -SHORT)
    return _built(let(given, lambda x: F.when((x["n"] == x["a"]) & (x["d"] == x["b"]) & few(x["n"]) & few(x["d"]) & (x["d"] != 0), short(x)).otherwise(frac(x["a"], x["b"]))))


def whole(n) -> Column:
    """An integer as a rational, without a search for divisors; NULL stays NULL."""
    return known_whole(exact(n))


def known_whole(n: Column) -> Column:
    """whole, of a decimal column."""
    return mark(F.when(n.isNotNull(), _pair(n, F.lit(1))))


def as_frac(x) -> Column:
    """Python ints, Fractions and integer columns become rationals; a column built by this module stays."""
    if isinstance(x, bool) or isinstance(x, float):
        raise TypeError(f"{x!r} is no exact number")
    if isinstance(x, int):
        return whole(x)
    if isinstance(x, Fraction):
        return mark(_pair(_dec(x.numerator), _dec(x.denominator)))
    return x if marked(x) else whole(x)


def marked(x) -> bool:
    return isinstance(x, Column) and vars(x).get("_is_frac") is True


def mark(c: Column) -> Column:
    """Says that a column read from a table holds rationals."""
    c._is_frac = True
    return c


def _built(c: Column) -> Column:
    """A rational that arithmetic has made: operations take its value once instead of its expression many times."""
    c._is_built = True
    return mark(c)


def _once(f: Callable, *operands) -> Column:
    """f of rationals, each computed once."""
    given = [as_frac(x) for x in operands]
    if not any(vars(x).get("_is_built") for x in given):
        return f(*given)
    return let(F.struct(*[x.alias(f"_{k}") for k, x in enumerate(given)]), lambda v: f(*[mark(v[f"_{k}"]) for k in range(len(given))]))


def real(c: Column) -> Column:
    """Says that a column holds doubles."""
    c._is_real = True
    return c


def is_real(x) -> bool:
    return isinstance(x, float) or isinstance(x, Column) and vars(x).get("_is_real") is True


def _doubles(a, b) -> tuple[Column, Column] | None:
    """Both as doubles if one of them is a float or a column of doubles."""
    if not is_real(a) and not is_real(b):
        return None
    a, b = (F.lit(x) if isinstance(x, float) else x.cast("double") if is_real(x) else to_double(x) for x in (a, b))
    return a, b


def reduced(num: Column, den: Column, zero: str = "error") -> Column:
    """num / den of two decimals in lowest terms."""
    bad = F.raise_error(F.lit("division by zero")).cast(TYPE) if zero == "error" else F.lit(None).cast(TYPE)
    given = F.struct(num.cast(DECIMAL).alias("n"), den.cast(DECIMAL).alias("d"))

    def short(x: Column) -> Column:
        """The same in 64-bit arithmetic, several times as fast."""
        n, d = x["n"].cast("long"), x["d"].cast("long")
        whole = lambda g, v: F.call_function("div", v, F.when(d < 0, -g).otherwise(g))
        return let(F.greatest(gcd_long(n, d), F.lit(1).cast("long")), lambda g: _pair(whole(g, n), whole(g, d)))

    def body(x: Column) -> Column:
        return let(
            F.struct(x["n"].alias("n"), x["d"].alias("d"), F.greatest(gcd(x["n"], x["d"]), F.lit(1).cast(DECIMAL)).alias("g"), F.signum(x["d"]).cast(DECIMAL).alias("s")),
            lambda y: _pair(quotient((y["n"] * y["s"]).cast(DECIMAL), y["g"]), quotient((y["d"] * y["s"]).cast(DECIMAL), y["g"])),
        )

    return _built(F.when(num.isNotNull() & den.isNotNull(), let(given, lambda x: F.when(x["d"] == 0, bad).when(x["d"] == 1, _pair(x["n"], x["d"])).when(_under(x["n"], SHORT) & _under(x["d"], SHORT), short(x)).otherwise(body(x)))))


def neg(a) -> Column:
    return _built(_once(lambda x: F.when(x.isNotNull(), _pair(negated(x["num"]), x["den"])), a))


def abs_(a) -> Column:
    return _built(_once(lambda x: F.when(x.isNotNull(), _pair(size(x["num"]), x["den"])), a))


#: Numbers whose products of two, and sums of two such products, are safe in 64 bits.
HALF = 10**9


def _all_under(limit: int, *cs: Column) -> Column:
    under = [_under(c, limit) for c in cs]
    for u in under[1:]:
        under[0] = under[0] & u
    return under[0]


def _fractions(a: Column, b: Column, kind: str) -> Column:
    return F.struct(a["num"].cast(kind).alias("a"), a["den"].cast(kind).alias("b"), b["num"].cast(kind).alias("c"), b["den"].cast(kind).alias("d"))


def _sum(a: Column, b: Column, sign: int) -> Column:
    """a/b + sign c/d by the greatest common divisor of the denominators: what is left to cancel divides it, so that numbers stay within
    the size of the operands' common form. Most sums need no second divisor."""

    def body(kind: str, gcd_of: Callable, over: Callable) -> Column:
        as_ = lambda c: c.cast(kind)

        def cancelled(x: Column) -> Column:
            g = x["g"]
            b_, d_ = over(x["v"]["b"], g), over(x["v"]["d"], g)
            t = as_(as_(x["v"]["a"] * d_) + as_(F.lit(sign).cast(kind) * as_(x["v"]["c"] * b_)))
            return let(
                F.struct(t.alias("t"), b_.alias("b"), x["v"]["d"].alias("d"), F.greatest(gcd_of(t, g), F.lit(1).cast(kind)).alias("g")),
                lambda y: _pair(over(y["t"], y["g"]), as_(y["b"] * over(y["d"], y["g"]))),
            )

        def apart(x: Column) -> Column:
            v = x["v"]
            return _pair(as_(as_(v["a"] * v["d"]) + as_(F.lit(sign).cast(kind) * as_(v["c"] * v["b"]))), as_(v["b"] * v["d"]))

        return let(
            let(_fractions(a, b, kind), lambda v: F.struct(v.alias("v"), gcd_of(v["b"], v["d"]).alias("g"))),
            lambda x: F.when(x["g"] == 1, apart(x)).otherwise(cancelled(x)),
        )

    short = body("long", gcd_long, lambda x, y: F.call_function("div", x, y))
    small = _all_under(HALF, a["num"], a["den"], b["num"], b["den"])
    wholes = (a["den"] == 1) & (b["den"] == 1)
    n = a["num"] + b["num"] if sign > 0 else a["num"] - b["num"]
    return _built(F.when(a.isNotNull() & b.isNotNull(), F.when(wholes, _pair(n, F.lit(1))).when(small, short).otherwise(body(DECIMAL, gcd, quotient))))


def add(a, b) -> Column:
    if d := _doubles(a, b):
        return real(d[0] + d[1])
    return _built(_once(lambda x, y: _sum(x, y, 1), a, b))


def sub(a, b) -> Column:
    if d := _doubles(a, b):
        return real(d[0] - d[1])
    return _built(_once(lambda x, y: _sum(x, y, -1), a, b))


def _product(a: Column, b: Column, zero: str = "error") -> Column:
    """a/b times c/d; long numbers are cancelled crosswise before they are multiplied. b or d may be negative here, or zero (an error or null)."""

    def long(v: Column) -> Column:
        one = F.lit(1).cast(DECIMAL)
        divisors = lambda x: F.struct(x.alias("v"), F.greatest(gcd(x["a"], x["d"]), one).alias("g"), F.greatest(gcd(x["c"], x["b"]), one).alias("h"))
        sign = lambda v: F.when((v["b"] < 0) != (v["d"] < 0), F.lit(-1)).otherwise(1).cast(DECIMAL)
        return let(
            divisors(v),
            lambda x: _pair(
                (sign(x["v"]) * (quotient(x["v"]["a"], x["g"]) * quotient(x["v"]["c"], x["h"])).cast(DECIMAL)).cast(DECIMAL),
                (quotient(size(x["v"]["b"]), x["h"]) * quotient(size(x["v"]["d"]), x["g"])).cast(DECIMAL),
            ),
        )

    small = _all_under(HALF, a["num"], a["den"], b["num"], b["den"])
    bad = F.raise_error(F.lit("division by zero")).cast(TYPE) if zero == "error" else F.lit(None).cast(TYPE)
    wide = F.when((a["den"] == 0) | (b["den"] == 0), bad).otherwise(let(_fractions(a, b, DECIMAL), long))
    return _built(F.when(a.isNotNull() & b.isNotNull(), F.when(small, reduced((a["num"] * b["num"]).cast(DECIMAL), (a["den"] * b["den"]).cast(DECIMAL), zero)).otherwise(wide)))


def _turned(a: Column) -> Column:
    return F.struct(a["den"].alias("num"), a["num"].alias("den"))


def mul(a, b) -> Column:
    if d := _doubles(a, b):
        return real(d[0] * d[1])
    return _built(_once(_product, a, b))


def div(a, b) -> Column:
    """Division by zero raises an error; 0 / b is 0."""
    if d := _doubles(a, b):
        return real(d[0] / d[1])
    return _built(_once(lambda x, y: _product(x, F.when(y.isNotNull(), _turned(y))), a, b))


def try_div(a, b) -> Column:
    """Division by zero gives NULL."""
    if d := _doubles(a, b):
        return real(F.try_divide(*d))
    return _built(_once(lambda x, y: _product(x, F.when(y.isNotNull(), _turned(y)), zero="null"), a, b))


def to_double(a) -> Column:
    return _once(lambda x: x["num"].cast("double") / x["den"].cast("double"), a)


def compare(a, b) -> Column:
    """-1, 0 or 1 as a is less than b, equal to it or more. Short numbers are multiplied crosswise; of long ones the quotients are compared, then
    those of divisor and remainder the other way round, and so on (Euclid's steps on both), so that no number grows."""
    if d := _doubles(a, b):
        return F.when(d[0] < d[1], -1).when(d[0] > d[1], 1).when(d[0] == d[1], 0)
    return _once(_compared, a, b)


def _compared(a: Column, b: Column) -> Column:
    of = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    state = lambda n1, d1, n2, d2, way, out: F.struct(*[x.cast(DECIMAL).alias(k) for k, x in zip(("n1", "d1", "n2", "d2"), (n1, d1, n2, d2), strict=True)], way.cast("int").alias("way"), out.cast("int").alias("out"))
    null = F.lit(None)

    def step(s: Column, _: Column) -> Column:
        def told(q: Column) -> Column:
            r1, r2 = s["n1"] % s["d1"], s["n2"] % s["d2"]
            ended = F.when(q["x"] != q["y"], s["way"] * of(q["x"], q["y"])).when((r1 == 0) | (r2 == 0), s["way"] * of(F.signum(r1), F.signum(r2)))
            return F.when(ended.isNotNull(), state(s["n1"], s["d1"], s["n2"], s["d2"], s["way"], ended)).otherwise(state(s["d1"], r1, s["d2"], r2, -s["way"], null))

        return F.when(s["out"].isNotNull(), s).otherwise(let(F.struct(quotient(s["n1"], s["d1"]).alias("x"), quotient(s["n2"], s["d2"]).alias("y")), told))

    def wide(v: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.length(v["b"].cast("string")), F.length(v["d"].cast("string"))) * 5 + 2)
        start = state(size(v["a"]), v["b"], size(v["c"]), v["d"], F.signum(v["a"]), null)
        return F.when(F.signum(v["a"]) != F.signum(v["c"]), of(v["a"], v["c"])).when(v["a"] == 0, 0).otherwise(F.aggregate(steps, start, step, lambda s: s["out"]))

    small = _all_under(SHORT, a["num"], a["den"], b["num"], b["den"])
    return F.when(a.isNotNull() & b.isNotNull(), F.when(small, of(a["num"] * b["den"], b["num"] * a["den"])).otherwise(let(_fractions(a, b, DECIMAL), wide)))


def eq(a, b) -> Column:
    if d := _doubles(a, b):
        return d[0] == d[1]
    return _once(lambda x, y: (x["num"] == y["num"]) & (x["den"] == y["den"]), a, b)


def ne(a, b) -> Column:
    return ~eq(a, b)


def lt(a, b) -> Column:
    return compare(a, b) < 0


def le(a, b) -> Column:
    return compare(a, b) <= 0


def gt(a, b) -> Column:
    return compare(a, b) > 0


def ge(a, b) -> Column:
    return compare(a, b) >= 0


def text(a, digits: int = 3) -> Column:
    """The value with so many decimals, exactly, ties to even; a negative number keeps its sign where only zeros are left."""
    return _once(lambda x: _text(x, digits), a)


def _text(a: Column, digits: int) -> Column:
    ten = 10**digits
    whole = lambda x, y: F.call_function("div", x, y)

    def put(up: Column, front: Column, back: Column) -> Column:
        """front and back (whole numbers: before and behind the point), one more behind if up."""
        full = up & (back == ten - 1)
        front, back = front + F.when(full, 1).otherwise(0), F.when(full, 0).otherwise(back + F.when(up, 1).otherwise(0))
        return F.concat(front.cast(DECIMAL).cast("string"), F.lit("." if digits else ""), F.lpad(back.cast("long").cast("string"), digits, "0") if digits else F.lit(""))

    def short(v: Column) -> Column:
        n = v["n"] * ten
        q, r = whole(n, v["d"]), n % v["d"]
        return put((2 * r > v["d"]) | ((2 * r == v["d"]) & (q % 2 == 1)), whole(q, F.lit(ten)), q % ten)

    def digit(s: Column, _: Column) -> Column:
        """10 r / d without 10 r: by a tenth of d, which may be one too much."""
        r, e, f = s["r"], quotient(s["d"], F.lit(10).cast(DECIMAL)), s["d"] % 10
        guess = F.when(s["d"] < _dec(10**30), quotient((r * 10).cast(DECIMAL), s["d"])).otherwise(F.least(F.lit(9).cast(DECIMAL), quotient(r, e)))

        def then(x: Column) -> Column:
            rest = (((r - x * e) * 10).cast(DECIMAL) - x * f).cast(DECIMAL)
            less = F.when(rest < 0, 1).otherwise(0).cast(DECIMAL)
            return F.struct(F.when(rest < 0, rest + s["d"]).otherwise(rest).cast(DECIMAL).alias("r"), s["d"].alias("d"), ((s["q"] * 10).cast(DECIMAL) + x - less).cast(DECIMAL).alias("q"))

        return let(guess, then)

    def long(v: Column) -> Column:
        start = F.struct((v["n"] % v["d"]).cast(DECIMAL).alias("r"), v["d"].alias("d"), F.lit(0).cast(DECIMAL).alias("q"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, digit) if digits else start
        return let(F.struct(v.alias("v"), done.alias("s")), lambda x: put((x["s"]["r"] > x["s"]["d"] - x["s"]["r"]) | ((x["s"]["r"] == x["s"]["d"] - x["s"]["r"]) & ((x["s"]["q"] if digits else quotient(x["v"]["n"], x["v"]["d"])) % 2 == 1)), quotient(x["v"]["n"], x["v"]["d"]), x["s"]["q"]))

    parts = lambda kind: F.struct(size(a["num"]).cast(kind).alias("n"), a["den"].cast(kind).alias("d"))
    small = _under(a["num"], 10 ** (18 - digits)) & (a["den"] < SHORT) if digits < 16 else F.lit(False)
    return F.concat(F.when(a["num"] < 0, "-").otherwise(""), F.when(small, let(parts("long"), short)).otherwise(let(parts(DECIMAL), long)))


def repr_(a) -> Column:
    """Text from which the number can be built again."""
    a = as_frac(a)
    return F.format_string("fraction(%s, %s)", a["num"].cast("string"), a["den"].cast("string"))


def ratio(a) -> Column:
    """p/q, or p for an integer."""
    a = as_frac(a)
    return F.when(a["den"] == 1, a["num"].cast("string")).otherwise(F.concat_ws("/", a["num"].cast("string"), a["den"].cast("string")))
