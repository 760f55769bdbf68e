"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import batch, frac, vec
from ..functions.arith import DOUBLE, INT
from ..operators.matrix import ID, MatrixFrame
from ..sources.builders import from_dense, from_sparse, from_table, scaled_identity, vector
from ..streaming.gram import gram_cells
from .chain import chain_product

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# relations

S_SQL = "S AS (SELECT l_suppkey AS matrix_id, CAST(l_orderkey % 3 AS INTEGER) AS i, CAST(l_partkey % 3 AS INTEGER) AS j, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2, 3)"
B_SQL = "B AS (SELECT l_suppkey AS matrix_id, CAST(l_orderkey % 3 AS INTEGER) AS i, CAST(SUM(l_linenumber) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2)"
W_SQL = f"""{S_SQL}, {B_SQL},
W AS (SELECT matrix_id, {", ".join(f"MAX(CASE WHEN i = {i} AND j = {j} THEN CAST(val AS HUGEINT) END) AS a{i}{j}" for i in range(3) for j in range(3))} FROM S GROUP BY 1),
Y AS (SELECT matrix_id, {", ".join(f"MAX(CASE WHEN i = {i} THEN CAST(val AS HUGEINT) END) AS b{i}" for i in range(3))} FROM B GROUP BY 1)"""
F_SQL = "L AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n1, CAST(l_linenumber AS BIGINT) AS d1, l_suppkey % 7 - 3 AS n2, l_partkey % 5 + 1 AS d2 FROM lineitem)"
V_SQL = "V AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS v, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 37) AS BIGINT) + 11) AS w FROM embeddings)"


def S(spark, sf_dir) -> MatrixFrame:
    t = _table(spark, sf_dir, "lineitem")
    return from_table(t, F.col("l_suppkey"), F.col("l_orderkey") % 3, F.col("l_partkey") % 3, F.col("l_quantity").cast("long"))


def right_side(spark, sf_dir) -> MatrixFrame:
    t = _table(spark, sf_dir, "lineitem")
    return from_table(t, F.col("l_suppkey"), F.col("l_orderkey") % 3, F.lit(0), F.col("l_linenumber").cast("long"))


def rationals(spark, sf_dir) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    t = t.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n1"), F.col("l_linenumber").cast("long").alias("d1"), (F.col("l_suppkey") % 7 - 3).alias("n2"), (F.col("l_partkey") % 5 + 1).alias("d2"))
    return t


def vectors(spark, sf_dir) -> DataFrame:
    t = _table(spark, sf_dir, "embeddings")
    scaled = lambda k: F.transform("embedding", lambda x: F.floor(x.cast("double") * k).cast(frac.DECIMAL))
    return t.select("vec_id", scaled(100).alias("v"), F.transform(scaled(37), lambda x: (x + 11).cast(frac.DECIMAL)).alias("w"))


def _cells(m: MatrixFrame) -> DataFrame:
    if m.kind is INT or m.kind is DOUBLE:
        return m.cells.select(ID, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("val").cast("long" if m.kind is INT else "double").alias("val"))
    return m.cells.select(ID, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("val.num").cast("long").alias("num"), F.col("val.den").cast("long").alias("den"))


def _out(c, *keys: str):
    return [*keys, c["num"].cast("long").alias("num"), c["den"].cast("long").alias("den")]


def _joined(v):
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def _r(n: str, d: str) -> str:
    """num and den of n / d in lowest terms."""
    g = f"gcd({n}, {d})"
    return f"CAST(CASE WHEN {d} < 0 THEN -({n}) ELSE {n} END // {g} AS BIGINT) AS num, CAST(abs({d}) // {g} AS BIGINT) AS den"


def _frac_sql(n: str, d: str) -> str:
    return f"WITH {F_SQL}, P AS (SELECT l_orderkey, l_linenumber, {n} AS n, {d} AS d FROM L) SELECT l_orderkey, l_linenumber, {_r('n', 'd')} FROM P"


KEYS = ("l_orderkey", "l_linenumber")


def _binary(name: str, f, n: str, d: str) -> None:
    def run(spark, sf_dir):
        r = rationals(spark, sf_dir)
        a, b = frac.frac(F.col("n1"), F.col("d1")), frac.frac(F.col("n2"), F.col("d2"))
        r = r.select(*KEYS, a.alias("a"), b.alias("b"))
        return r.select(*KEYS, f(frac.mark(F.col("a")), frac.mark(F.col("b"))).alias("x")).select(*_out(F.col("x"), *KEYS))

    run.__name__ = name
    query(_frac_sql(n, d))(run)


# 2.E scalars


@query(_frac_sql("n1 * (n2 + 4)", "d1 * (n2 - 4)"))
def frac_reduce(spark, sf_dir):
    r = rationals(spark, sf_dir)
    return r.select(*KEYS, frac.frac(F.col("n1") * (F.col("n2") + 4), F.col("d1") * (F.col("n2") - 4)).alias("x")).select(*_out(F.col("x"), *KEYS))


_binary("frac_add", frac.add, "n1 * d2 + n2 * d1", "d1 * d2")
_binary("frac_sub", frac.sub, "n1 * d2 - n2 * d1", "d1 * d2")
_binary("frac_mul", frac.mul, "n1 * n2", "d1 * d2")


@query(_frac_sql("n2 * d1", "d2 * n1"))
def frac_div(spark, sf_dir):
    r = rationals(spark, sf_dir).select(*KEYS, frac.frac(F.col("n1"), F.col("d1")).alias("a"), frac.frac(F.col("n2"), F.col("d2")).alias("b"))
    return r.select(*KEYS, frac.div(frac.mark(F.col("b")), frac.mark(F.col("a"))).alias("x")).select(*_out(F.col("x"), *KEYS))


@query(f"WITH {F_SQL} SELECT l_orderkey, l_linenumber, CAST(n1 // gcd(n1, d1) AS DOUBLE) / CAST(d1 // gcd(n1, d1) AS DOUBLE) + CAST(0.5 AS DOUBLE) AS val FROM L")
def frac_add_float(spark, sf_dir):
    r = rationals(spark, sf_dir).select(*KEYS, frac.frac(F.col("n1"), F.col("d1")).alias("a"))
    return r.select(*KEYS, frac.add(frac.mark(F.col("a")), 0.5).alias("val"))


@query(f"WITH {F_SQL} SELECT l_orderkey, l_linenumber, CAST((-n2) // gcd(n2, d2) AS BIGINT) AS neg_num, CAST(abs(n2) // gcd(n2, d2) AS BIGINT) AS abs_num, CAST(d2 // gcd(n2, d2) AS BIGINT) AS den FROM L")
def frac_neg_abs(spark, sf_dir):
    r = rationals(spark, sf_dir).select(*KEYS, frac.frac(F.col("n2"), F.col("d2")).alias("b"))
    b = frac.mark(F.col("b"))
    return r.select(*KEYS, frac.neg(b)["num"].cast("long").alias("neg_num"), frac.abs_(b)["num"].cast("long").alias("abs_num"), frac.neg(b)["den"].cast("long").alias("den"))


@query(f"WITH {F_SQL} SELECT l_orderkey, l_linenumber, n1 * d2 = n2 * d1 AS eq, n1 * d2 <> n2 * d1 AS ne, n1 * d2 < n2 * d1 AS lt, n1 * d2 <= n2 * d1 AS le, n1 * d2 > n2 * d1 AS gt, n1 * d2 >= n2 * d1 AS ge FROM L")
def frac_compare(spark, sf_dir):
    r = rationals(spark, sf_dir).select(*KEYS, frac.frac(F.col("n1"), F.col("d1")).alias("a"), frac.frac(F.col("n2"), F.col("d2")).alias("b"))
    a, b = frac.mark(F.col("a")), frac.mark(F.col("b"))
    return r.select(*KEYS, *[getattr(frac, op)(a, b).alias(op) for op in ("eq", "ne", "lt", "le", "gt", "ge")])


#: Denominators of rationals whose cross products outgrow 38 digits.
_TEN20, _TEN30 = "CAST(100000000000000000000 AS HUGEINT)", 10**30


@query(f"""WITH {F_SQL}, P AS (SELECT l_orderkey, l_linenumber, CAST(n1 * d2 + n2 * d1 AS HUGEINT) AS n, CAST(d1 * d2 AS HUGEINT) * {_TEN20} AS d FROM L)
SELECT l_orderkey, l_linenumber, CAST(n // gcd(n, d) AS VARCHAR) AS num, CAST(d // gcd(n, d) AS VARCHAR) AS den FROM P""")
def frac_add_large(spark, sf_dir):
    """Sums over denominators of 21 digits: their product has 42, the result 22 at most."""
    ten = F.lit("1" + "0" * 20).cast(frac.DECIMAL)
    part = lambda n, d: batch.pair(F.col(n), F.col(d).cast(frac.DECIMAL) * ten)
    r = rationals(spark, sf_dir).select(*KEYS, batch.add(part("n1", "d1"), part("n2", "d2")).alias("x"))
    return r.select(*KEYS, F.col("x.num").cast("string").alias("num"), F.col("x.den").cast("string").alias("den"))


@query(f"WITH {F_SQL}, P AS (SELECT l_orderkey, l_linenumber, CASE WHEN n1 * d2 <> n2 * d1 THEN sign(n1 * d2 - n2 * d1) ELSE sign(d2 - d1) END AS c FROM L) SELECT l_orderkey, l_linenumber, c = 0 AS eq, c < 0 AS lt, c <= 0 AS le, c > 0 AS gt, c >= 0 AS ge FROM P")
def frac_compare_large(spark, sf_dir):
    """n / d and a 10^-30th of 1 / d more: cross products have over 60 digits."""
    ten = F.lit(str(_TEN30)).cast(frac.DECIMAL)
    part = lambda n, d: batch.pair(F.col(n).cast(frac.DECIMAL) * ten + 1, F.col(d).cast(frac.DECIMAL) * ten)
    r = rationals(spark, sf_dir).select(*KEYS, batch.compare(part("n1", "d1"), part("n2", "d2")).alias("c"))
    return r.select(*KEYS, *[f(F.col("c"), 0).alias(f.__name__) for f in (operator.eq, operator.lt, operator.le, operator.gt, operator.ge)])


@query(f"WITH {F_SQL} SELECT l_orderkey, l_linenumber, CAST(n1 // gcd(n1, d1) AS DOUBLE) / CAST(d1 // gcd(n1, d1) AS DOUBLE) AS val FROM L")
def frac_to_double(spark, sf_dir):
    return rationals(spark, sf_dir).select(*KEYS, frac.frac(F.col("n1"), F.col("d1")).alias("a")).select(*KEYS, frac.to_double(frac.mark(F.col("a"))).alias("val"))


@query(f"WITH {F_SQL} SELECT l_orderkey, l_linenumber, 'fraction(' || CAST(n2 // gcd(n2, d2) AS VARCHAR) || ', ' || CAST(d2 // gcd(n2, d2) AS VARCHAR) || ')' AS repr, CASE WHEN d2 // gcd(n2, d2) = 1 THEN CAST(n2 // gcd(n2, d2) AS VARCHAR) ELSE CAST(n2 // gcd(n2, d2) AS VARCHAR) || '/' || CAST(d2 // gcd(n2, d2) AS VARCHAR) END AS ratio FROM L")
def frac_repr(spark, sf_dir):
    r = rationals(spark, sf_dir).select(*KEYS, frac.frac(F.col("n2"), F.col("d2")).alias("b"))
    return r.select(*KEYS, frac.repr_(frac.mark(F.col("b"))).alias("repr"), frac.ratio(frac.mark(F.col("b"))).alias("ratio"))


@query(f"WITH {F_SQL} SELECT l_orderkey, l_linenumber, printf('%.3f', CAST(n2 AS DOUBLE) / d2) AS text FROM L")
def frac_text(spark, sf_dir):
    r = rationals(spark, sf_dir).select(*KEYS, frac.frac(F.col("n2"), F.col("d2")).alias("b"))
    return r.select(*KEYS, frac.text(frac.mark(F.col("b"))).alias("text"))


@query("SELECT l_orderkey, l_linenumber, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g FROM lineitem")
def gcd_pairs(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(*KEYS, frac.gcd_long(F.col("l_partkey"), F.col("l_suppkey")).alias("g"))


# 2.A constructors


@query(f"WITH {S_SQL} SELECT * FROM S")
def mat_from_table(spark, sf_dir):
    return _cells(S(spark, sf_dir).checked())


def _rows_sql(outer: str, inner: str) -> str:
    return f"WITH {S_SQL}, R AS (SELECT matrix_id, {outer} AS o, '[' || string_agg(CAST(val AS VARCHAR), ',' ORDER BY {inner}) || ']' AS r FROM S GROUP BY 1, 2) SELECT matrix_id, string_agg(r, ',' ORDER BY o) AS text FROM R GROUP BY 1"


def _nested_text(c: str):
    return F.array_join(F.transform(c, lambda r: F.concat(F.lit("["), _joined(r), F.lit("]"))), ",")


@query(_rows_sql("i", "j"))
def mat_rows(spark, sf_dir):
    return S(spark, sf_dir).rows().select(ID, _nested_text("rows").alias("text"))


@query(_rows_sql("j", "i"))
def mat_cols(spark, sf_dir):
    return S(spark, sf_dir).cols().select(ID, _nested_text("cols").alias("text"))


@query(f"WITH {S_SQL} SELECT * FROM S")
def mat_from_dense(spark, sf_dir):
    return _cells(from_dense(S(spark, sf_dir).dense().select(ID, "m")))


@query("SELECT s_suppkey AS matrix_id, CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, CAST(CASE WHEN a.range = b.range THEN 1 ELSE 0 END AS BIGINT) AS val FROM supplier, range(3) a, range(3) b")
def mat_identity(spark, sf_dir):
    return _cells(S(spark, sf_dir).identity())


@query("SELECT CAST(s_suppkey AS BIGINT) AS matrix_id, CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, CAST(CASE WHEN a.range = b.range THEN 7 ELSE 0 END AS BIGINT) AS val FROM supplier, range(4) a, range(4) b")
def mat_diag(spark, sf_dir):
    sizes = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(ID), F.lit(4).alias("n"))
    return _cells(scaled_identity(sizes, 7))


@query("SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS text FROM lineitem GROUP BY 1")
def vec_from_table(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    return vector(t, "l_orderkey", F.col("l_linenumber"), F.col("l_quantity").cast("long")).select("l_orderkey", _joined(F.col("v")).alias("text"))


# 2.B positions


@query(f"WITH {S_SQL} SELECT matrix_id, val FROM S WHERE i = 2 AND j = 1")
def mat_cell(spark, sf_dir):
    return S(spark, sf_dir).cell(-1, 1).select(ID, F.col("val").cast("long").alias("val"))


@query(f"WITH {S_SQL} SELECT matrix_id, j - 1 AS idx, val FROM S WHERE i = 1 AND j >= 1")
def mat_row_slice(spark, sf_dir):
    return S(spark, sf_dir).row(1, slice(1, 9)).select(ID, "idx", F.col("val").cast("long").alias("val"))


@query(f"WITH {S_SQL} SELECT matrix_id, i AS idx, val FROM S WHERE j = 2 AND i < 2")
def mat_col_slice(spark, sf_dir):
    return S(spark, sf_dir).col(-1, slice(None, -1)).select(ID, "idx", F.col("val").cast("long").alias("val"))


@query(f"WITH {S_SQL} SELECT matrix_id, i - 1 AS i, j, val FROM S WHERE i >= 1 AND j < 2")
def mat_block(spark, sf_dir):
    return _cells(S(spark, sf_dir).block(slice(1, None), slice(0, 2)))


@query(f"WITH {S_SQL} SELECT matrix_id, i, j, CASE WHEN i = 0 AND j = 2 THEN -1 ELSE val END AS val FROM S")
def mat_assign_cell(spark, sf_dir):
    return _cells(S(spark, sf_dir).assign_cell(0, -1, F.lit(-1).cast(frac.DECIMAL)))


@query(f"WITH {S_SQL} SELECT a.matrix_id, a.i, a.j, CASE WHEN b.val IS NULL THEN a.val ELSE b.val END AS val FROM S a LEFT JOIN S b ON a.matrix_id = b.matrix_id AND a.i = b.i + 1 AND a.j = b.j + 1 AND b.i < 2 AND b.j < 2")
def mat_assign(spark, sf_dir):
    s = S(spark, sf_dir)
    return _cells(s.assign(s.block(slice(0, 2), slice(0, 2)).cells, row=1, col=1))


@query(f"WITH {S_SQL} SELECT matrix_id, j AS i, i AS j, val FROM S")
def mat_transpose(spark, sf_dir):
    return _cells(S(spark, sf_dir).transpose())


@query(f"WITH {S_SQL} SELECT matrix_id, CASE i WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE i END AS i, j, val FROM S")
def mat_row_swap(spark, sf_dir):
    return _cells(S(spark, sf_dir).swap_rows(0, -1))


@query(f"WITH {S_SQL} SELECT matrix_id, i, CASE j WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE j END AS j, val FROM S")
def mat_col_swap(spark, sf_dir):
    return _cells(S(spark, sf_dir).swap_cols(0, 1))


@query(f"WITH {S_SQL} SELECT matrix_id, i, j, val AS num, CAST(1 AS BIGINT) AS den FROM S")
def mat_to_fraction(spark, sf_dir):
    return _cells(S(spark, sf_dir).to_fraction())


@query(f"WITH {S_SQL} SELECT matrix_id, CAST(3 AS INTEGER) AS n_rows, CAST(3 AS INTEGER) AS n_cols, CAST(2 AS INTEGER) AS augment FROM S GROUP BY 1")
def mat_augment(spark, sf_dir):
    return S(spark, sf_dir).augment_line().header


@query(f"WITH {S_SQL} SELECT * FROM S WHERE j < 2")
def mat_coefficients(spark, sf_dir):
    return _cells(S(spark, sf_dir).augment_line().coefficients())


@query(f"WITH {S_SQL} SELECT matrix_id, i, j - 1 AS j, val FROM S WHERE j >= 1")
def mat_constants(spark, sf_dir):
    return _cells(S(spark, sf_dir).augment_line(1).constants())


# 2.C insertion


@query(f"WITH {S_SQL} SELECT matrix_id, CASE WHEN i >= 1 THEN i + 2 ELSE i END AS i, j, val FROM S UNION ALL SELECT matrix_id, i + 1, j, val FROM S WHERE i < 2")
def mat_expand_rows(spark, sf_dir):
    s = S(spark, sf_dir)
    return _cells(s.insert_rows(s.block(slice(0, 2), slice(None)), pos=1))


@query(f"WITH {S_SQL}, {B_SQL} SELECT matrix_id, i, CASE WHEN j >= 2 THEN j + 1 ELSE j END AS j, val FROM S UNION ALL SELECT matrix_id, i, 2, val FROM B")
def mat_expand_cols(spark, sf_dir):
    return _cells(S(spark, sf_dir).insert_cols(right_side(spark, sf_dir), pos=-2))


# 2.D products, 2.G.1 and sums

_GRAM = f"WITH {S_SQL} SELECT a.matrix_id, a.i, b.i AS j, CAST(SUM(a.val * b.val) AS BIGINT) AS val FROM S a JOIN S b ON a.matrix_id = b.matrix_id AND a.j = b.j GROUP BY 1, 2, 3"


@query(_GRAM)
def gram(spark, sf_dir):
    return _cells(S(spark, sf_dir).gram())


@query(f"WITH {S_SQL} SELECT a.matrix_id, a.i, b.j, CAST(SUM(a.val * b.val) AS BIGINT) AS val FROM S a JOIN S b ON a.matrix_id = b.matrix_id AND a.j = b.i GROUP BY 1, 2, 3")
def matmul(spark, sf_dir):
    s = S(spark, sf_dir)
    return _cells(s.matmul(s))


@query(f"WITH {S_SQL}, {B_SQL} SELECT a.matrix_id, a.i, CAST(0 AS INTEGER) AS j, CAST(SUM(a.val * b.val) AS BIGINT) AS val FROM S a JOIN B b ON a.matrix_id = b.matrix_id AND a.j = b.i GROUP BY 1, 2")
def matvec(spark, sf_dir):
    return _cells(S(spark, sf_dir).matvec(right_side(spark, sf_dir).cells.select(ID, F.col("i").alias("idx"), "val")))


@query(f"WITH {S_SQL}, {B_SQL} SELECT a.matrix_id, CAST(0 AS INTEGER) AS i, a.j, CAST(SUM(a.val * b.val) AS BIGINT) AS val FROM S a JOIN B b ON a.matrix_id = b.matrix_id AND a.i = b.i GROUP BY 1, 3")
def vecmat(spark, sf_dir):
    return _cells(S(spark, sf_dir).vecmat(right_side(spark, sf_dir).cells.select(ID, F.col("i").alias("idx"), "val")))


@query(f"WITH {S_SQL}, {B_SQL}, X AS (SELECT a.matrix_id, a.i, SUM(a.val * b.val) AS val FROM S a JOIN B b ON a.matrix_id = b.matrix_id AND a.j = b.i GROUP BY 1, 2) SELECT a.matrix_id, a.i, CAST(0 AS INTEGER) AS j, CAST(SUM(a.val * x.val) AS BIGINT) AS val FROM S a JOIN X x ON a.matrix_id = x.matrix_id AND a.j = x.i GROUP BY 1, 2")
def mat_chain(spark, sf_dir):
    s = S(spark, sf_dir)
    return _cells(chain_product([s, s, right_side(spark, sf_dir)], [3, 3, 3, 1]))


@query(f"WITH {S_SQL} SELECT matrix_id, i, j, val * -3 AS val FROM S")
def mat_scalar(spark, sf_dir):
    return _cells(S(spark, sf_dir).scale(-3))


@query(f"WITH {S_SQL} SELECT matrix_id, i, j, CAST(val * 2 // gcd(val * 2, 6) AS BIGINT) AS num, CAST(6 // gcd(val * 2, 6) AS BIGINT) AS den FROM S")
def mat_scalar_frac(spark, sf_dir):
    return _cells(S(spark, sf_dir).scale(frac.frac(2, 6)))


@query(f"WITH {S_SQL} SELECT matrix_id, i, j, CAST(val AS DOUBLE) * CAST(0.5 AS DOUBLE) AS val FROM S")
def mat_scalar_float(spark, sf_dir):
    return _cells(S(spark, sf_dir).scale(0.5))


@query(f"WITH {S_SQL} SELECT a.matrix_id, a.i, b.j, CAST(SUM(a.val * b.val) AS DOUBLE) / 2 AS val FROM S a JOIN S b ON a.matrix_id = b.matrix_id AND a.j = b.i GROUP BY 1, 2, 3")
def mat_mixed_product(spark, sf_dir):
    s = S(spark, sf_dir)
    return _cells(s.matmul(s.scale(0.5)))


@query(f"WITH {S_SQL} SELECT matrix_id, CAST(SUM(val) AS BIGINT) AS val FROM S GROUP BY 1")
def mat_sum(spark, sf_dir):
    return S(spark, sf_dir).sum().select(ID, F.col("val").cast("long").alias("val"))


@query(f"WITH {S_SQL}, P AS (SELECT matrix_id, SUM(CASE WHEN i = 0 THEN val * 6 WHEN i = 1 THEN val * 3 ELSE val * 2 END) AS n FROM S GROUP BY 1) SELECT matrix_id, {_r('n', '6')} FROM P")
def mat_sum_frac(spark, sf_dir):
    s = S(spark, sf_dir)
    shares = MatrixFrame(s.cells.withColumn("val", frac.frac(F.col("val"), F.col("i") + 1)), s.header, "frac")
    return shares.sum().select(*_out(F.col("val"), ID))


@query(f"WITH {S_SQL} SELECT a.matrix_id, a.i, a.j, a.val + b.val AS val FROM S a JOIN S b ON a.matrix_id = b.matrix_id AND a.i = b.j AND a.j = b.i")
def mat_plus(spark, sf_dir):
    s = S(spark, sf_dir)
    return _cells(s.plus(s.transpose()))


@query(f"WITH {S_SQL} SELECT a.matrix_id, a.i, a.j, a.val - b.val AS val FROM S a JOIN S b ON a.matrix_id = b.matrix_id AND a.i = b.j AND a.j = b.i")
def mat_minus(spark, sf_dir):
    s = S(spark, sf_dir)
    return _cells(s.minus(s.transpose()))


_COLUMNS = ["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"]


@query("SELECT CAST(0 AS BIGINT) AS matrix_id, i, j, val FROM (" + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, CAST(SUM(CAST({a} AS BIGINT) * CAST({b} AS BIGINT)) AS BIGINT) AS val FROM lineitem" for i, a in enumerate(_COLUMNS) for j, b in enumerate(_COLUMNS)) + ") g")
def gram_columns(spark, sf_dir):
    """val is a long like the SQL's where every sum fits one, else a decimal; the SQL itself raises an error then."""
    cells = scratch.written(gram_cells(_table(spark, sf_dir, "lineitem"), F.lit(0), [F.col(c).cast("long") for c in _COLUMNS]), "gram")
    fits = cells.filter(~F.col("val").between(-(2**63), 2**63 - 1)).isEmpty()
    return cells.withColumn("val", F.col("val").cast("long")) if fits else cells


# 2.F vectors


def _vec_sql(expr: str) -> str:
    return f"WITH {V_SQL} SELECT vec_id, list_aggregate(list_transform(range(len(v)), lambda i: CAST({expr} AS VARCHAR)), 'string_agg', ',') AS text FROM V"


def _vec_query(name: str, f, expr: str) -> None:
    def run(spark, sf_dir):
        return vectors(spark, sf_dir).select("vec_id", _joined(f(F.col("v"), F.col("w"))).alias("text"))

    run.__name__ = name
    query(_vec_sql(expr))(run)


_vec_query("vec_add", lambda v, w: vec.add(v, w, INT), "v[i + 1] + w[i + 1]")
_vec_query("vec_sub", lambda v, w: vec.sub(v, w, INT), "v[i + 1] - w[i + 1]")
_vec_query("vec_mul", lambda v, w: vec.mul(v, w, INT), "v[i + 1] * w[i + 1]")
_vec_query("vec_neg", lambda v, w: vec.neg(v, INT), "-v[i + 1]")
_vec_query("vec_add_scalar", lambda v, w: vec.add_scalar(v, F.lit(5), INT), "v[i + 1] + 5")
_vec_query("vec_rsub_scalar", lambda v, w: vec.rsub_scalar(F.lit(5), v, INT), "5 - v[i + 1]")
_vec_query("vec_mul_scalar", lambda v, w: vec.mul_scalar(v, F.lit(-2), INT), "v[i + 1] * -2")
_vec_query("vec_slice", lambda v, w: vec.slice_(v, -4, None), "v[len(v) - 3 + i]")
ORACLE_SQL["vec_slice"] = f"WITH {V_SQL} SELECT vec_id, list_aggregate(list_transform(range(4), lambda i: CAST(v[len(v) - 3 + i] AS VARCHAR)), 'string_agg', ',') AS text FROM V"


@query(f"WITH {V_SQL} SELECT vec_id, list_aggregate(list_transform(range(len(v)), lambda i: CAST(v[i + 1] // gcd(v[i + 1], 6) AS VARCHAR) || '/' || CAST(6 // gcd(v[i + 1], 6) AS VARCHAR)), 'string_agg', ',') AS text FROM V")
def vec_div_scalar(spark, sf_dir):
    quotient = vec.div_scalar(F.col("v"), F.lit(6), INT)
    return vectors(spark, sf_dir).select("vec_id", F.array_join(F.transform(quotient, lambda x: F.concat_ws("/", x["num"].cast("string"), x["den"].cast("string"))), ",").alias("text"))


@query(f"WITH {V_SQL}, E AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x = 0 THEN 1 ELSE x END) AS v FROM V) SELECT vec_id, list_aggregate(list_transform(range(len(v)), lambda i: CAST(sign(v[i + 1]) * 6 // gcd(v[i + 1], 6) AS VARCHAR) || '/' || CAST(abs(v[i + 1]) // gcd(v[i + 1], 6) AS VARCHAR)), 'string_agg', ',') AS text FROM E")
def vec_rdiv_scalar(spark, sf_dir):
    safe = F.transform("v", lambda x: F.when(x == 0, 1).otherwise(x).cast(frac.DECIMAL))
    quotient = vec.rdiv_scalar(F.lit(6), safe, INT)
    return vectors(spark, sf_dir).select("vec_id", F.array_join(F.transform(quotient, lambda x: F.concat_ws("/", x["num"].cast("string"), x["den"].cast("string"))), ",").alias("text"))


@query(f"WITH {V_SQL}, E AS (SELECT vec_id, v, list_transform(w, lambda x: CASE WHEN x = 0 THEN 1 ELSE x END) AS w FROM V) SELECT vec_id, list_aggregate(list_transform(range(len(v)), lambda i: CAST((sign(w[i + 1]) * v[i + 1]) // gcd(v[i + 1], w[i + 1]) AS VARCHAR) || '/' || CAST(abs(w[i + 1]) // gcd(v[i + 1], w[i + 1]) AS VARCHAR)), 'string_agg', ',') AS text FROM E")
def vec_div(spark, sf_dir):
    safe = F.transform("w", lambda x: F.when(x == 0, 1).otherwise(x).cast(frac.DECIMAL))
    quotient = vec.div(F.col("v"), safe, INT)
    return vectors(spark, sf_dir).select("vec_id", F.array_join(F.transform(quotient, lambda x: F.concat_ws("/", x["num"].cast("string"), x["den"].cast("string"))), ",").alias("text"))


@query(f"WITH {V_SQL} SELECT vec_id, CAST(list_sum(list_transform(range(len(v)), lambda i: v[i + 1] * w[i + 1])) AS BIGINT) AS val FROM V")
def vec_dot(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", vec.dot(F.col("v"), F.col("w"), INT).cast("long").alias("val"))


@query(f"WITH {V_SQL} SELECT vec_id, CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, v[a.range + 1] * w[b.range + 1] AS val FROM V JOIN range(4096) a ON a.range < len(v) JOIN range(4096) b ON b.range < len(w)")
def vec_outer(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(vec.outer(F.col("v"), F.col("w"), INT)).alias("i", "r"))
    return rows.select("vec_id", "i", F.posexplode("r").alias("j", "val")).withColumn("val", F.col("val").cast("long"))


@query(f"WITH {V_SQL} SELECT vec_id, CAST(list_sum(v) * list_sum(w) AS BIGINT) AS val FROM V")
def sum_2d(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", vec.sum_2d(vec.outer(F.col("v"), F.col("w"), INT), INT).cast("long").alias("val"))


@query(f"WITH {V_SQL} SELECT vec_id, list_aggregate(list_transform(v, lambda x: CAST(x AS VARCHAR) || '/1'), 'string_agg', ',') AS text FROM V")
def vec_to_frac(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.array_join(F.transform(vec.to_frac(F.col("v")), lambda x: F.concat_ws("/", x["num"].cast("string"), x["den"].cast("string"))), ",").alias("text"))


def _pad(s: str, w: str) -> str:
    return f"repeat(' ', CAST({w} - {w} // 2 - (length({s}) - length({s}) // 2) + 1 AS BIGINT)) || {s} || repeat(' ', CAST({w} // 2 - length({s}) // 2 + 1 AS BIGINT))"


@query(f"WITH {V_SQL}, T AS (SELECT vec_id, list_transform(v, lambda x: CAST(x AS VARCHAR)) AS t FROM V), M AS (SELECT vec_id, t, list_max(list_transform(t, lambda s: length(s))) AS w FROM T) SELECT vec_id, '[' || list_aggregate(list_transform(range(len(t)), lambda i: {_pad('t[i + 1]', 'w')}), 'string_agg', '') || ']' AS text FROM M")
def vec_text(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", vec.text(F.col("v"), INT).alias("text"))


# 2.G elimination

DET = "(a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20))"


def _cells_sql(cells: list[tuple[int, int, str, str]]) -> str:
    union = " UNION ALL ".join(f"SELECT matrix_id, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, {n} AS n, {d} AS d FROM W JOIN Y USING (matrix_id)" for i, j, n, d in cells)
    return f"WITH {W_SQL}, C AS ({union}) SELECT matrix_id, i, j, {_r('n', 'd')} FROM C"


def _cramer(j: int) -> str:
    det = DET
    for i in range(3):
        det = det.replace(f"a{i}{j}", f"b{i}")
    return det


_I3 = [(i, j, "1" if i == j else "0", "1") for i in range(3) for j in range(3)]
_MINOR = "(a00 * a11 - a01 * a10)"
_U = [(0, 0, "a00", "1"), (0, 1, "a01", "1"), (0, 2, "a02", "1"), (1, 0, "0", "1"), (1, 1, _MINOR, "a00"), (1, 2, "(a00 * a12 - a02 * a10)", "a00"), (2, 0, "0", "1"), (2, 1, "0", "1"), (2, 2, DET, _MINOR)]
_L = [(0, 0, "1", "1"), (0, 1, "0", "1"), (0, 2, "0", "1"), (1, 0, "a10", "a00"), (1, 1, "1", "1"), (1, 2, "0", "1"), (2, 0, "a20", "a00"), (2, 1, "(a00 * a21 - a01 * a20)", _MINOR), (2, 2, "1", "1")]
_int = lambda cells: [(i, j, f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)") for i, j, n, d in cells]


def _cofactor(i: int, j: int) -> str:
    (r0, r1), (c0, c1) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    return f"({'-' if (i + j) % 2 else ''}(a{r0}{c0} * a{r1}{c1} - a{r0}{c1} * a{r1}{c0}))"


@query(_cells_sql(_int(_I3 + [(i, 3, _cramer(i), DET) for i in range(3)])))
def mat_rref_aug(spark, sf_dir):
    return _cells(S(spark, sf_dir).insert_cols(right_side(spark, sf_dir)).augment_line().rref())


@query(ORACLE_SQL["mat_rref_aug"])
def mat_rref_native(spark, sf_dir):
    return _cells(S(spark, sf_dir).insert_cols(right_side(spark, sf_dir)).augment_line().rref_native())


@query(ORACLE_SQL["mat_rref_aug"])
def mat_rref_modular(spark, sf_dir):
    return _cells(S(spark, sf_dir).insert_cols(right_side(spark, sf_dir)).augment_line().rref_modular())


#: Rows and columns of one matrix of all of lineitem.
_LARGE = 48


def _large_system(spark, sf_dir, size: int) -> MatrixFrame:
    """The quantities of all items in one square matrix, beside its product with the vector of j * j - 20."""
    t = _table(spark, sf_dir, "lineitem")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    a = from_sparse(t, F.lit(0), place("l_orderkey"), place("l_partkey"), F.col("l_quantity").cast("long"), size, size)
    known = a.header.select(ID, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("idx")).withColumn("val", (F.col("idx") * F.col("idx") - 20).cast(frac.DECIMAL))
    return a.insert_cols(a.matvec(known)).augment_line(size)


def _known_sql(size: int) -> str:
    return f"WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT CAST(0 AS BIGINT) AS matrix_id, CAST(range AS INTEGER) AS j, CAST(range * range - 20 AS VARCHAR) AS num, '1' AS den FROM range({size}), n WHERE n > 0"


def _solution(found: DataFrame, size: int) -> DataFrame:
    return found.filter(F.col("j") == size).select(ID, F.col("i").alias("j"), "num", "den")


_G_SQL = f"G AS (SELECT CAST(l_orderkey % {_LARGE} AS INTEGER) AS i, CAST(l_partkey % {_LARGE} AS INTEGER) AS j, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_G_SQL} SELECT CAST(0 AS BIGINT) AS matrix_id, a.i, b.i AS j, CAST(SUM(a.val * b.val) AS BIGINT) AS val FROM G a JOIN G b USING (j) GROUP BY 2, 3")
def mat_product_tiled(spark, sf_dir):
    """The quantities of all items in one matrix, times its transpose, by tiles."""
    t = _table(spark, sf_dir, "lineitem")
    a = from_sparse(t, F.lit(0), F.col("l_orderkey") % _LARGE, F.col("l_partkey") % _LARGE, F.col("l_quantity").cast("long"), _LARGE, _LARGE)
    return a.matmul_tiled(a.transpose(), 16).cells.withColumn("val", F.col("val").cast("long"))


@query(_known_sql(_LARGE))
def mat_solve_large(spark, sf_dir):
    """One matrix of the quantities of all items, solved for a known vector: minors of some hundred digits on the way."""
    return _solution(_large_system(spark, sf_dir, _LARGE).rref_text(), _LARGE)


@query(_known_sql(_LARGE))
def mat_solve_tiled(spark, sf_dir):
    """The same in bands and panels."""
    return _solution(_large_system(spark, sf_dir, _LARGE).rref_tiled(16), _LARGE)


@query(_cells_sql(_int(_U)))
def mat_ref_u(spark, sf_dir):
    return _cells(S(spark, sf_dir).ref())


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, * FROM ({_cells_sql(_int(cells))}) x" for part, cells in (("P", _I3), ("L", _L), ("U", _U))))
def mat_plu(spark, sf_dir):
    cells = S(spark, sf_dir).factors()
    return cells.select("part", ID, "i", "j", F.col("val.num").cast("long").alias("num"), F.col("val.den").cast("long").alias("den"))


@query(_cells_sql(_int(_L)))
def mat_lower(spark, sf_dir):
    return _cells(S(spark, sf_dir).lower())


@query(_cells_sql(_int([(i, j, _cofactor(j, i), DET) for i in range(3) for j in range(3)])))
def mat_inverse(spark, sf_dir):
    return _cells(S(spark, sf_dir).inverse())


@query(f"WITH {S_SQL} SELECT matrix_id, CAST(0 AS BIGINT) AS wrong_cells, CAST(3 AS INTEGER) AS rank_e FROM S GROUP BY 1")
def mat_pinv_singular(spark, sf_dir):
    """E A = rref(A) for matrices whose last row is the sum of the others, and E is invertible."""
    s = S(spark, sf_dir)
    top = s.block(slice(0, 2), slice(None))
    last = top.cells.groupBy(ID, F.lit(0).alias("i"), "j").agg(F.sum("val").cast(frac.DECIMAL).alias("val"))
    a = top.insert_rows(MatrixFrame(last, top.header.withColumn("n_rows", F.lit(1)))).to_fraction().written()
    e = a.inverse().written()
    d = e.matmul(a).minus(a.rref()).cells
    wrong = d.groupBy(ID).agg(F.sum((F.col("val.num") != 0).cast("long")).alias("wrong_cells"))
    return wrong.join(e.pivots().select(ID, F.col("rank").alias("rank_e")), ID)


def _placed(spark, sf_dir, places: list[list[tuple[int, int] | None]]) -> MatrixFrame:
    """S with its cells at other places; None is a zero."""
    cell = lambda p: F.lit(0).cast(frac.DECIMAL) if p is None else F.get(F.get("m", F.lit(p[0])), F.lit(p[1]))
    rows = F.array(*[F.array(*[cell(p) for p in r]) for r in places])
    return from_dense(S(spark, sf_dir).dense().select(ID, rows.alias("m")))


#: A tall matrix: a zero on top of the first column, and a row of zeros.
_TALL = [[None, (0, 1), (0, 2)], [None, None, None], [(2, 0), (2, 1), (2, 2)], [(1, 0), (1, 1), (1, 2)]]
#: Where its rows end: the lowest comes up, then the zeros change places with the last row.
_ORDER = [3, 0, 2, 1]
_AHEAD, _REST = "(a10 * a21 - a20 * a11)", "(a10 * a22 - a20 * a12)"
_TALL_U = [(0, 0, "a10", "1"), (0, 1, "a11", "1"), (0, 2, "a12", "1"), (1, 0, "0", "1"), (1, 1, "a01", "1"), (1, 2, "a02", "1"), (2, 0, "0", "1"), (2, 1, "0", "1"), (2, 2, f"({_REST} * a01 - {_AHEAD} * a02)", "(a10 * a01)"), *[(3, j, "0", "1") for j in range(3)]]
_TALL_BELOW = {(2, 0): ("a20", "a10"), (2, 1): (_AHEAD, "(a10 * a01)")}
_TALL_L = [(i, j, *_TALL_BELOW.get((i, j), ("1" if i == j else "0", "1"))) for i in range(4) for j in range(4)]
_TALL_P = [(i, j, "1" if j == _ORDER[i] else "0", "1") for i in range(4) for j in range(4)]


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, * FROM ({_cells_sql(_int(cells))}) x" for part, cells in (("P", _TALL_P), ("L", _TALL_L), ("U", _TALL_U))))
def mat_plu_swaps(spark, sf_dir):
    """P, L and U of a tall matrix that needs two changes of rows and has a row of zeros."""
    cells = _placed(spark, sf_dir, _TALL).factors()
    return cells.select("part", ID, "i", "j", F.col("val.num").cast("long").alias("num"), F.col("val.den").cast("long").alias("den"))


@query(_cells_sql(_int([(_ORDER[i], j, n, d) for i, j, n, d in _TALL_L])))
def mat_lower_swaps(spark, sf_dir):
    return _cells(_placed(spark, sf_dir, _TALL).lower())


@query(_cells_sql(_int(_TALL_U)))
def mat_ref_swaps(spark, sf_dir):
    return _cells(_placed(spark, sf_dir, _TALL).ref())


@query(_cells_sql(_int([(0, 0, "0", "1"), (0, 1, "1", "1"), (0, 2, "0", "1"), (0, 3, "(a12 * a00 - a11 * a01)", "(a10 * a00)"), (1, 0, "0", "1"), (1, 1, "0", "1"), (1, 2, "1", "1"), (1, 3, "a01", "a00"), *[(2, j, "0", "1") for j in range(4)]])))
def mat_rref_wide(spark, sf_dir):
    """The reduced form of a wide matrix with a column of zeros, a row twice and a change of rows."""
    wide = [[None, None, (0, 0), (0, 1)], [None, (1, 0), (1, 1), (1, 2)], [None, None, (0, 0), (0, 1)]]
    return _cells(_placed(spark, sf_dir, wide).rref())


@query(f"WITH U AS ({_cells_sql(_int(_U))}) SELECT matrix_id, i, j, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) / 2 AS val FROM U")
def mat_ref_double(spark, sf_dir):
    """The echelon form of a matrix of doubles."""
    return _cells(S(spark, sf_dir).scale(0.5).ref())


@query(f"WITH {W_SQL} SELECT matrix_id, CAST(CASE WHEN {DET} <> 0 THEN 3 END AS INTEGER) AS rank FROM W")
def mat_rank(spark, sf_dir):
    return S(spark, sf_dir).pivots().select(ID, "rank")


def _trace_sql() -> str:
    """The steps of a matrix without zeros on the way, in terms of its cells: numerator and denominator of each row's numbers after each."""
    minor = "(a00 * a11 - a10 * a01)"
    second = [("0", "1"), (minor, "a00"), ("(a00 * a12 - a10 * a02)", "a00")]
    third = [("0", "1"), ("(a00 * a21 - a20 * a01)", "a00"), ("(a00 * a22 - a20 * a02)", "a00")]
    rows = [[(f"a{i}{j}", "1") for j in range(3)] for i in range(3)]
    unit = lambda i: [("1" if i == j else "0", "1") for j in range(3)]
    #: row changed, what it becomes, the row that is subtracted (None: it is multiplied), how many times
    steps = [
        (1, second, 0, ("a10", "a00")), (2, third, 0, ("a20", "a00")), (2, [("0", "1"), ("0", "1"), (DET, minor)], 1, (third[1][0], minor)),
        (2, unit(2), None, (minor, DET)), (1, [*second[:2], ("0", "1")], 2, second[2]), (0, [("a00", "1"), ("a01", "1"), ("0", "1")], 2, ("a02", "1")),
        (1, unit(1), None, ("a00", minor)), (0, [("a00", "1"), ("0", "1"), ("0", "1")], 1, ("a01", "1")), (0, unit(0), None, ("1", "a00")),
    ]
    big = lambda x: f"CAST({x} AS HUGEINT)"
    cut = lambda x, n, d: f"CAST(abs({big(x)}) // gcd({big(n)}, {big(d)}) AS VARCHAR)"
    sign = lambda n, d: f"CASE WHEN {n} < 0 AND {d} > 0 OR {n} > 0 AND {d} < 0 THEN '-' ELSE '' END"
    size = lambda n, d: f"{cut(n, n, d)} || CASE WHEN {cut(d, n, d)} = '1' THEN '' ELSE '/' || {cut(d, n, d)} END"
    parts = []
    for k, (row, becomes, other, (n, d)) in enumerate(steps):
        rows[row] = becomes
        numbers = " || ',' || ".join(f"{sign(n, d)} || {cut(n, n, d)} || '/' || {cut(d, n, d)}" for r in rows for n, d in r)
        if other is None:
            label = f"CASE WHEN {n} = -({d}) THEN '-' ELSE {sign(n, d)} || {size(n, d)} END || 'R{row + 1}'"
            done = f"{n} <> {d}"
        else:
            label = f"'R{row + 1} ' || CASE WHEN {sign(n, d)} = '-' THEN '+ ' ELSE '- ' END || CASE WHEN abs({n}) = abs({d}) THEN '' ELSE {size(n, d)} END || 'R{other + 1}'"
            done = f"{n} <> 0"
        parts.append(f"SELECT matrix_id, {k} AS k, '{'add' if other is not None else 'scale'}' AS op, {label} AS label, {numbers} AS numbers FROM W WHERE {done}")
    return f"WITH {W_SQL}, T AS ({' UNION ALL '.join(parts)}) SELECT matrix_id, CAST(row_number() OVER (PARTITION BY matrix_id ORDER BY k) AS INTEGER) AS step, op, label, numbers FROM T"


@query(_trace_sql())
def mat_trace(spark, sf_dir):
    return S(spark, sf_dir).trace().select(ID, "step", "op", "label", F.array_join(F.zip_with("num", "den", lambda p, q: F.concat_ws("/", p, q)), ",").alias("numbers"))


@query(ORACLE_SQL["mat_rref_aug"])
def mat_trace_replay(spark, sf_dir):
    """The steps of the trace, done one after another to the matrices, give the reduced form."""
    a = S(spark, sf_dir).insert_cols(right_side(spark, sf_dir)).augment_line()
    return _cells(a.replay(a.changes()))


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, * FROM ({_cells_sql(_int(cells))}) x" for part, cells in (("swaps", _TALL_U), ("plain", _U))))
def mat_trace_replay_ref(spark, sf_dir):
    """The same of the echelon form, with and without changes of rows."""
    parts = {"swaps": _placed(spark, sf_dir, _TALL), "plain": S(spark, sf_dir)}
    swaps, plain = (_cells(a.replay(a.changes(reduced=False))).select(F.lit(part).alias("part"), "*") for part, a in parts.items())
    return swaps.unionByName(plain)


@query(f"WITH {S_SQL}, T AS (SELECT matrix_id, i, j, CAST(val AS VARCHAR) AS s, MAX(length(CAST(val AS VARCHAR))) OVER (PARTITION BY matrix_id) AS w FROM S), P AS (SELECT matrix_id, i, '[' || string_agg((CASE WHEN j = 2 THEN ' | ' ELSE '' END) || {_pad('s', 'w')}, '' ORDER BY j) || ']' || chr(10) AS line FROM T GROUP BY 1, 2) SELECT matrix_id, string_agg(line, '' ORDER BY i) AS text FROM P GROUP BY 1")
def mat_render(spark, sf_dir):
    return S(spark, sf_dir).augment_line().render()


@query(f"WITH {S_SQL}, R AS (SELECT matrix_id, i, '[' || string_agg(CAST(val AS VARCHAR), ', ' ORDER BY j) || ']' AS r FROM S GROUP BY 1, 2) SELECT matrix_id, 'Matrix([' || string_agg(r, ', ' ORDER BY i) || '], 2)' AS text FROM R GROUP BY 1")
def mat_repr(spark, sf_dir):
    return S(spark, sf_dir).augment_line().repr()
