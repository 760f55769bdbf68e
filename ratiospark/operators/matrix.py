"""Matrices as relations: cells (matrix_id, i, j, val) and headers (matrix_id, n_rows, n_cols, augment).

A MatrixFrame holds any number of matrices of one kind of number. Every operation gives a new frame. Cells are dense: zeros are
stored. augment is the first column of constants, n_cols when there are none. Positions may be negative, from the end; for an insertion
-1 stands after the last. Joins are on matrix_id and a position, so that Catalyst picks the strategy and sums are pre-aggregated."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import frac, vec
from ..functions.arith import DOUBLE, FRAC, KINDS, Arith
from . import bareiss, elimination, modular, tiled

ID = "matrix_id"


def _at(pos: int, size: Column, what: str) -> Column:
    """A position within size, or an error."""
    p = F.lit(pos) if pos >= 0 else size + pos
    return F.when((p >= 0) & (p < size), p).otherwise(F.raise_error(F.format_string(f"{what} {pos} is out of range for %d", size)).cast("int"))


def _bounds(s: slice, size: Column) -> tuple[Column, Column]:
    if s.step not in (None, 1):
        raise ValueError("slices have step 1")
    clamp = lambda p: F.greatest(F.lit(0), size + p) if p < 0 else F.least(size, F.lit(p))
    return F.lit(0) if s.start is None else clamp(s.start), size if s.stop is None else clamp(s.stop)


def _insertion(pos: int, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size, F.lit(pos) if pos >= 0 else size + pos + 1))


class MatrixFrame:
    def __init__(self, cells: DataFrame, header: DataFrame, kind: str = "int", listed: DataFrame | None = None):
        """listed: the same matrices as listed() gives them, where whoever makes them has them so at hand."""
        self.cells, self.header, self.kind, self._listed = cells, header, KINDS[kind], listed

    # shape

    def _with(self, cells: DataFrame | None = None, header: DataFrame | None = None, kind: Arith | None = None) -> MatrixFrame:
        return MatrixFrame(self.cells if cells is None else cells, self.header if header is None else header, (kind or self.kind).name)

    def _sized(self) -> DataFrame:
        return self.cells.join(self.header, ID)

    def _plain(self, header: DataFrame) -> DataFrame:
        """Without a line before constants."""
        return header.withColumn("augment", F.col("n_cols"))

    def written(self) -> MatrixFrame:
        """The same matrices, written to the shared folder and read back, for frames that are used several times."""
        return self._with(scratch.written(self.cells, "cells"), scratch.written(self.header, "header"))

    def checked(self) -> MatrixFrame:
        """Raises an error for a matrix without cells, with missing ones or with some twice."""
        seen = self.cells.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i", "j").alias("d"), F.max("i").alias("mi"), F.max("j").alias("mj"), F.min(F.least("i", "j")).alias("low"))
        ok = (F.col("n") == F.col("n_rows") * F.col("n_cols")) & (F.col("d") == F.col("n")) & (F.col("mi") < F.col("n_rows")) & (F.col("mj") < F.col("n_cols")) & (F.col("low") >= 0)
        head = self.header.join(seen, ID, "left").filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.format_string("matrix %s is ragged or empty", F.col(ID))).cast("boolean")))
        return self._with(header=head.select(ID, "n_rows", "n_cols", "augment"))

    def dense(self) -> DataFrame:
        """matrix_id, n_rows, n_cols, augment, m: an array of rows."""
        row = self.cells.groupBy(ID, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "val"))), lambda x: x["val"]).alias("row"))
        rows = row.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]).alias("m"))
        return self.header.join(rows, ID)

    def listed(self) -> DataFrame:
        """matrix_id, n_rows, n_cols, augment, vals: an array of all numbers in row order."""
        if self._listed is not None:
            return self._listed
        flat = self.cells.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("i", "j", "val"))).alias("c"))
        return self.header.join(flat, ID).select(ID, "n_rows", "n_cols", "augment", F.col("c.val").alias("vals"))

    def rows(self) -> DataFrame:
        return self.dense().select(ID, F.col("m").alias("rows"))

    def cols(self) -> DataFrame:
        return self.transpose().dense().select(ID, F.col("m").alias("cols"))

    # numbers

    def to_fraction(self) -> MatrixFrame:
        if self.kind is FRAC:
            return self
        if self.kind is DOUBLE:
            raise TypeError("doubles are no exact numbers")
        return self._with(self.cells.withColumn("val", frac.known_whole(F.col("val"))), kind=FRAC)

    def to_double(self) -> MatrixFrame:
        val = F.col("val")
        return self._with(self.cells.withColumn("val", frac.to_double(frac.mark(val)) if self.kind is FRAC else val.cast("double")), kind=DOUBLE)

    def _lift(self, other: MatrixFrame) -> tuple[MatrixFrame, MatrixFrame]:
        """Both of one kind: doubles if one is of doubles, else rationals if one is of rationals."""
        if self.kind is other.kind:
            return self, other
        if DOUBLE in (self.kind, other.kind):
            return self.to_double(), other.to_double()
        return self.to_fraction(), other.to_fraction()

    def scale(self, k: Column | int | float | Fraction) -> MatrixFrame:
        """Every cell times k. A Fraction or a rational column gives rationals, a float or a column of doubles (frac.real) doubles; any
        other column must hold whole numbers."""
        if frac.is_real(k) and self.kind is not DOUBLE:
            return self.to_double().scale(k)
        if (frac.marked(k) or isinstance(k, Fraction)) and self.kind.name == "int":
            return self.to_fraction().scale(k)
        if self.kind is DOUBLE:
            k = (frac.to_double(k) if frac.marked(k) else k.cast("double")) if isinstance(k, Column) else self.kind.lit(k)
        else:
            k = self.kind.lit(k)
        return self._with(self.cells.withColumn("val", self.kind.mul(F.col("val"), k)))

    def negate(self) -> MatrixFrame:
        return self._with(self.cells.withColumn("val", self.kind.neg(F.col("val"))))

    def _cellwise(self, other: MatrixFrame, f) -> MatrixFrame:
        a, b = self._lift(other)
        shape = a.header.join(b.header.select(ID, F.col("n_rows").alias("r"), F.col("n_cols").alias("c")), ID)
        fits = F.when((F.col("n_rows") == F.col("r")) & (F.col("n_cols") == F.col("c")), True).otherwise(F.raise_error(F.lit("shapes differ")).cast("boolean"))
        both = a.cells.join(b.cells.select(ID, "i", "j", F.col("val").alias("other")), [ID, "i", "j"]).join(shape.filter(fits).select(ID), ID)
        return a._with(both.select(ID, "i", "j", f(a.kind)(F.col("val"), F.col("other")).alias("val")))

    def plus(self, other: MatrixFrame) -> MatrixFrame:
        return self._cellwise(other, lambda k: k.add)

    def minus(self, other: MatrixFrame) -> MatrixFrame:
        return self._cellwise(other, lambda k: k.sub)

    def _sum(self, df: DataFrame, keys: list[str], value: Column, kind: Arith) -> DataFrame:
        """Sums by key. Rationals are first summed for each denominator, which is distributive; the few sums left are added up."""
        if kind is not FRAC:
            return df.groupBy(*keys).agg(F.sum(value).cast(kind.type).alias("val"))
        parts = df.select(*keys, value.alias("v")).groupBy(*keys, F.col("v.den").alias("d")).agg(F.sum("v.num").cast(frac.DECIMAL).alias("n"))
        lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("ps"))
        total = F.aggregate("ps", frac.whole(0), lambda s, p: frac.add(frac.mark(s), frac.reduced(p["n"], p["d"])))
        return lists.select(*keys, total.alias("val"))

    def sum(self) -> DataFrame:
        """matrix_id, val: the sum of all cells."""
        return self._sum(self.cells, [ID], F.col("val"), self.kind)

    # products

    def matmul(self, other: MatrixFrame, *, check: bool = True) -> MatrixFrame:
        """The product of the matrices of equal ids. Without check the inner sizes are taken to agree, which spares reading the headers."""
        a, b = self._lift(other)
        size = a.header.select(ID, "n_rows", F.col("n_cols").alias("inner")).join(b.header.select(ID, F.col("n_rows").alias("inner_b"), "n_cols"), ID)
        fits = F.when(F.col("inner") == F.col("inner_b"), True).otherwise(F.raise_error(F.format_string("%d columns meet %d rows", "inner", "inner_b")).cast("boolean"))
        header = size.filter(fits).select(ID, "n_rows", "n_cols", F.col("n_cols").alias("augment"))
        left, right = a.cells.select(ID, "i", F.col("j").alias("k"), F.col("val").alias("x")), b.cells.select(ID, F.col("i").alias("k"), "j", F.col("val").alias("y"))
        if check:  # cells meet the headers that passed, or the check would be pruned
            left = left.join(header.select(ID), ID)
        return MatrixFrame(a._sum(left.join(right, [ID, "k"]), [ID, "i", "j"], a.kind.mul(F.col("x"), F.col("y")), a.kind), header, a.kind.name)

    def matmul_tiled(self, other: MatrixFrame, side: int = tiled.SIDE) -> MatrixFrame:
        """matmul of large integer matrices, by tiles. Cells that are zero aren't among the result's; dense operations need filled."""
        if self.kind.name != "int" or other.kind.name != "int":
            raise TypeError("needs integers")
        size = self.header.select(ID, "n_rows", F.col("n_cols").alias("inner")).join(other.header.select(ID, F.col("n_rows").alias("inner_b"), "n_cols"), ID)
        fits = F.when(F.col("inner") == F.col("inner_b"), True).otherwise(F.raise_error(F.format_string("%d columns meet %d rows", "inner", "inner_b")).cast("boolean"))
        header = size.filter(fits).select(ID, "n_rows", "n_cols", F.col("n_cols").alias("augment"))
        return MatrixFrame(tiled.product(self.cells.join(header.select(ID), ID), other.cells, side), header)

    def filled(self) -> MatrixFrame:
        """With a cell for every place: those that aren't there are zero."""
        places = self.header.select(ID, "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("i")).select(ID, "i", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("j"))
        zero = {"int": F.lit(0).cast(frac.DECIMAL), "frac": frac.whole(0), "double": F.lit(0.0)}[self.kind.name]
        return self._with(places.join(self.cells, [ID, "i", "j"], "left").withColumn("val", F.coalesce("val", zero)))

    def matvec(self, vectors: DataFrame) -> MatrixFrame:
        """Times column vectors (matrix_id, idx, val): matrices of one column."""
        column = vectors.select(ID, F.col("idx").alias("i"), F.lit(0).alias("j"), "val")
        size = vectors.groupBy(ID).agg(F.count(F.lit(1)).cast("int").alias("n_rows")).select(ID, "n_rows", F.lit(1).alias("n_cols"), F.lit(1).alias("augment"))
        return self.matmul(MatrixFrame(column, size, self.kind.name))

    def vecmat(self, vectors: DataFrame) -> MatrixFrame:
        """Row vectors (matrix_id, idx, val) times the matrices: matrices of one row."""
        row = vectors.select(ID, F.lit(0).alias("i"), F.col("idx").alias("j"), "val")
        size = vectors.groupBy(ID).agg(F.count(F.lit(1)).cast("int").alias("n_cols")).select(ID, F.lit(1).alias("n_rows"), "n_cols", F.col("n_cols").alias("augment"))
        return MatrixFrame(row, size, self.kind.name).matmul(self)

    def gram(self) -> MatrixFrame:
        """A times its transpose."""
        return self.matmul(self.transpose(), check=False)

    # positions

    def transpose(self) -> MatrixFrame:
        head = self.header.select(ID, F.col("n_cols").alias("n_rows"), F.col("n_rows").alias("n_cols"), F.col("n_rows").alias("augment"))
        return self._with(self.cells.select(ID, F.col("j").alias("i"), F.col("i").alias("j"), "val"), head)

    def cell(self, i: int, j: int) -> DataFrame:
        """matrix_id, val."""
        s = self._sized()
        return s.filter((F.col("i") == _at(i, F.col("n_rows"), "row")) & (F.col("j") == _at(j, F.col("n_cols"), "column"))).select(ID, "val")

    def row(self, i: int, cols: slice = slice(None)) -> DataFrame:
        """matrix_id, idx, val: part of a row."""
        a, b = _bounds(cols, F.col("n_cols"))
        return self._sized().filter((F.col("i") == _at(i, F.col("n_rows"), "row")) & (F.col("j") >= a) & (F.col("j") < b)).select(ID, (F.col("j") - a).alias("idx"), "val")

    def col(self, j: int, rows: slice = slice(None)) -> DataFrame:
        """matrix_id, idx, val: part of a column."""
        a, b = _bounds(rows, F.col("n_rows"))
        return self._sized().filter((F.col("j") == _at(j, F.col("n_cols"), "column")) & (F.col("i") >= a) & (F.col("i") < b)).select(ID, (F.col("i") - a).alias("idx"), "val")

    def block(self, rows: slice, cols: slice) -> MatrixFrame:
        """A part as matrices; empty parts have no header."""
        (a, b), (c, d) = _bounds(rows, F.col("n_rows")), _bounds(cols, F.col("n_cols"))
        cells = self._sized().filter((F.col("i") >= a) & (F.col("i") < b) & (F.col("j") >= c) & (F.col("j") < d)).select(ID, (F.col("i") - a).alias("i"), (F.col("j") - c).alias("j"), "val")
        head = self.header.select(ID, (b - a).alias("n_rows"), (d - c).alias("n_cols")).filter("n_rows > 0 AND n_cols > 0").withColumn("augment", F.col("n_cols"))
        return self._with(cells, head)

    def coefficients(self) -> MatrixFrame:
        cells = self._sized().filter(F.col("j") < F.col("augment")).select(ID, "i", "j", "val")
        return self._with(cells, self.header.filter("augment > 0").select(ID, "n_rows", F.col("augment").alias("n_cols"), "augment"))

    def constants(self) -> MatrixFrame:
        cells = self._sized().filter(F.col("j") >= F.col("augment")).select(ID, "i", (F.col("j") - F.col("augment")).alias("j"), "val")
        width = F.col("n_cols") - F.col("augment")
        return self._with(cells, self.header.filter(width > 0).select(ID, "n_rows", width.alias("n_cols"), width.alias("augment")))

    def augment_line(self, pos: int = -2) -> MatrixFrame:
        """The line goes before column pos; -1 is after the last column, -2 before the last."""
        return self._with(header=self.header.withColumn("augment", _insertion(pos, F.col("n_cols"))))

    def assign(self, patch: DataFrame, row: int = 0, col: int = 0) -> MatrixFrame:
        """Cells of patch (matrix_id, i, j, val), moved by row and col, take the place of those there. One outside raises an error."""
        p = patch.select(ID, (F.col("i") + row).alias("i"), (F.col("j") + col).alias("j"), F.col("val").alias("new"))
        inside = (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < F.col("n_rows")) & (F.col("j") < F.col("n_cols"))
        p = p.join(self.header, ID).filter(F.when(inside, True).otherwise(F.raise_error(F.lit("a cell is out of range")).cast("boolean"))).select(ID, "i", "j", F.struct("new").alias("p"))
        return self._with(self.cells.join(p, [ID, "i", "j"], "left").select(ID, "i", "j", F.when(F.col("p").isNotNull(), F.col("p.new")).otherwise(F.col("val")).alias("val")))

    def assign_cell(self, i: int, j: int, value: Column) -> MatrixFrame:
        here = (F.col("i") == _at(i, F.col("n_rows"), "row")) & (F.col("j") == _at(j, F.col("n_cols"), "column"))
        return self._with(self._sized().select(ID, "i", "j", F.when(here, value).otherwise(F.col("val")).alias("val")))

    def _swapped(self, axis: str, size: str, a: int, b: int) -> MatrixFrame:
        x, y = _at(a, F.col(size), axis), _at(b, F.col(size), axis)
        moved = F.when(F.col(axis) == x, y).when(F.col(axis) == y, x).otherwise(F.col(axis))
        return self._with(self._sized().withColumn(axis, moved).select(ID, "i", "j", "val"))

    def swap_rows(self, a: int, b: int) -> MatrixFrame:
        return self._swapped("i", "n_rows", a, b)

    def swap_cols(self, a: int, b: int) -> MatrixFrame:
        """May cross the line before the constants."""
        return self._swapped("j", "n_cols", a, b)

    def _beside(self, lines: Sequence, column: bool) -> MatrixFrame:
        """A line of numbers, or several, as rows or columns of a matrix for each of this frame's."""
        from ..sources.builders import kind_of

        lines = [list(x) for x in lines] if lines and isinstance(lines[0], (list, tuple)) else [list(lines)]
        if not lines[0] or any(len(x) != len(lines[0]) for x in lines):
            raise ValueError("lines are ragged or empty")
        kind = KINDS[kind_of([x for line in lines for x in line])]
        places = ("j", "i") if column else ("i", "j")
        cells = F.array(*[F.struct(F.lit(a).alias(places[0]), F.lit(b).alias(places[1]), kind.lit(x).alias("val")) for a, line in enumerate(lines) for b, x in enumerate(line)])
        n, m = (len(lines[0]), len(lines)) if column else (len(lines), len(lines[0]))
        head = self.header.select(ID, F.lit(n).alias("n_rows"), F.lit(m).alias("n_cols"), F.lit(m).alias("augment"))
        return MatrixFrame(self.header.select(ID, F.inline(cells)).select(ID, "i", "j", "val"), head, kind.name)

    def _inserted(self, other: MatrixFrame, pos: int, axis: str, size: str, across: str) -> MatrixFrame:
        a, b = self._lift(other)
        head = a.header.join(b.header.select(ID, F.col(size).alias("k"), F.col(across).alias("across_b")), ID)
        fits = F.when(F.col(across) == F.col("across_b"), True).otherwise(F.raise_error(F.format_string("%d cells meet %d", across, "across_b")).cast("boolean"))
        head = head.filter(fits).withColumn("p", _insertion(pos, F.col(size)))
        spots = head.select(ID, "k", "p")
        old = a.cells.join(spots, ID).withColumn(axis, F.when(F.col(axis) >= F.col("p"), F.col(axis) + F.col("k")).otherwise(F.col(axis)))
        new = b.cells.join(spots, ID).withColumn(axis, F.col(axis) + F.col("p"))
        line = F.col("augment") if axis == "i" else F.when(F.col("augment") >= F.col("p"), F.col("augment") + F.col("k")).otherwise(F.col("augment"))
        head = head.select(ID, *[(F.col(c) + F.col("k")).alias(c) if c == size else F.col(c) for c in ("n_rows", "n_cols")], line.alias("augment"))
        keep = [ID, "i", "j", "val"]
        return MatrixFrame(old.select(*keep).unionByName(new.select(*keep)), head, a.kind.name)

    def insert_rows(self, other: MatrixFrame | Sequence, *, pos: int = -1) -> MatrixFrame:
        """other: matrices of equal ids, or a row of numbers, or a list of such rows, which every matrix gets."""
        return self._inserted(other if isinstance(other, MatrixFrame) else self._beside(other, False), pos, "i", "n_rows", "n_cols")

    def insert_cols(self, other: MatrixFrame | Sequence, *, pos: int = -1) -> MatrixFrame:
        """other: as for insert_rows, with columns. A line at or after pos moves along."""
        return self._inserted(other if isinstance(other, MatrixFrame) else self._beside(other, True), pos, "j", "n_cols", "n_rows")

    def identity(self) -> MatrixFrame:
        """The identity of as many rows."""
        from ..sources.builders import scaled_identity

        return scaled_identity(self.header.select(ID, F.col("n_rows").alias("n")))

    # elimination

    def _packed(self) -> DataFrame:
        """matrix_id, n_rows, n_cols, augment, num, den: a matrix in one row, its numbers as text in row order."""
        whole = self.kind is not FRAC
        num = F.col("val") if whole else F.col("val.num")
        den = F.lit(1) if whole else F.col("val.den")
        flat = self.cells.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("i", "j", num.cast("string").alias("p"), den.cast("string").alias("q")))).alias("c"))
        return self.header.join(flat, ID).select(ID, "n_rows", "n_cols", "augment", F.col("c.p").alias("num"), F.col("c.q").alias("den"))

    def _eliminated(self, what: str) -> DataFrame:
        """The kernel's rows. Doubles are eliminated exactly, as the binary fractions that they are, and rounded once at the end."""
        return self._packed().mapInPandas(elimination.kernel(what, self.kind is DOUBLE), elimination.OUT)

    def _unpacked(self, out: DataFrame) -> DataFrame:
        """part, matrix_id, i, j, val. Numbers of over 38 digits raise an error here; the kernel's texts have them."""
        cells = out.select("part", ID, "n_cols", F.posexplode(F.arrays_zip("num", "den")).alias("k", "v"))
        pair = F.struct(F.col("v.num").cast(frac.DECIMAL).alias("num"), F.col("v.den").cast(frac.DECIMAL).alias("den"))
        val = F.col("v.num").cast("double") if self.kind is DOUBLE else pair
        return cells.select("part", ID, F.floor(F.col("k") / F.col("n_cols")).cast("int").alias("i"), (F.col("k") % F.col("n_cols")).alias("j"), val.alias("val"))

    def _frames(self, out: DataFrame, part: str) -> MatrixFrame:
        """One part of the kernel's rows. Sizes come from this frame's, so that reading them doesn't run the kernel once more."""
        head = self.header
        if part in ("P", "L", "lower", "inverse"):
            head = head.select(ID, "n_rows", F.col("n_rows").alias("n_cols"), F.col("n_rows").alias("augment"))
        return MatrixFrame(self._unpacked(out.filter(F.col("part") == part)).drop("part"), head, "double" if self.kind is DOUBLE else "frac")

    def ref(self) -> MatrixFrame:
        return self._frames(self._eliminated("ref"), "ref")

    def rref(self) -> MatrixFrame:
        return self._frames(self._eliminated("rref"), "rref")

    def rref_native(self) -> MatrixFrame:
        """rref of integer matrices within the JVM, for numbers whose minors fit 32 digits (see bareiss); the constants of zero
        rows may differ from rref's by the order of rows."""
        if self.kind.name != "int":
            raise TypeError("needs integers")
        done = self.dense().select(ID, bareiss.rref(F.col("m"), F.col("augment")).alias("m"))
        cells = done.select(ID, F.posexplode("m").alias("i", "r")).select(ID, "i", F.posexplode("r").alias("j", "val"))
        return self._with(cells, kind=FRAC)

    def rref_modular(self) -> MatrixFrame:
        """rref by elimination modulo many primes: many tasks for one matrix, and no rationals until the end (see modular)."""
        return self._with(modular.cells(self._exact_modular(False), frac.DECIMAL), kind=FRAC)

    def inverse_modular(self) -> MatrixFrame:
        """inverse, in the same way."""
        found = self._with(header=self._plain(self.header))
        return found._with(modular.cells(found._exact_modular(True), frac.DECIMAL), kind=FRAC)

    def rref_text(self) -> DataFrame:
        """matrix_id, i, j, num, den, pivots: rref_modular with numbers as text of any length."""
        return self._exact_modular(False)

    def rref_tiled(self, band: int = tiled.ROWS) -> DataFrame:
        """matrix_id, i, j, num, den, pivots: rref of integer matrices too large for a task, in bands of rows and panel by panel (see tiled)."""
        if self.kind.name != "int":
            raise TypeError("needs integers")
        return tiled.reduced(self.cells, self.header, band)

    def _exact_modular(self, invert: bool) -> DataFrame:
        if self.kind is DOUBLE:
            raise TypeError("doubles are no exact numbers")
        return modular.reduced(self._packed(), invert)

    def pivots(self) -> DataFrame:
        """matrix_id, pivots, rank."""
        return self._eliminated("ref").select(ID, "pivots", F.size("pivots").alias("rank"))

    def plu(self) -> tuple[MatrixFrame, MatrixFrame, MatrixFrame]:
        """P, L, U with P A = L U."""
        out = self._eliminated("plu")
        return self._frames(out, "P"), self._frames(out, "L"), self._frames(out, "U")

    def factors(self) -> DataFrame:
        """part (P, L or U), matrix_id, i, j, val: all three from one pass of the kernel."""
        return self._unpacked(self._eliminated("plu"))

    def lower_upper(self) -> tuple[MatrixFrame, MatrixFrame]:
        """lower, U with lower U = A: lower is the transpose of P, times L."""
        out = self._eliminated("lower")
        return self._frames(out, "lower"), self._frames(out, "U")

    def lower(self) -> MatrixFrame:
        return self.lower_upper()[0]

    def inverse(self) -> MatrixFrame:
        """The inverse; for a singular matrix an invertible E with E A = rref(A). A line before constants doesn't count."""
        return self._frames(self._with(header=self._plain(self.header))._eliminated("inverse"), "inverse")

    def trace(self, reduced: bool = True) -> DataFrame:
        """matrix_id, step, op, label, num, den: the steps to the reduced form, or to the echelon form alone, and all numbers after each,
        in row order."""
        return self._eliminated("trace" if reduced else "ref trace").select(ID, "step", "op", "label", "n_cols", "num", "den")

    def changes(self, reduced: bool = True) -> DataFrame:
        """matrix_id, step, op, label, target, source, factor_num, factor_den, num, den: the same steps, each with the numbers of the row that it
        changes (none for a swap), so that a step costs as many numbers as the matrix has columns. See replay."""
        out = self._eliminated("changes" if reduced else "ref changes")
        return out.select(ID, "step", "op", "label", "target", "source", "factor_num", "factor_den", "num", "den")

    def replay(self, steps: DataFrame) -> MatrixFrame:
        """The matrices after their steps (matrix_id, step, op, target, source, factor_num, factor_den), as one fold within the JVM: rows change
        places, are multiplied or added to. Numbers must fit 38 digits. A matrix without steps stays as it is."""
        if self.kind is DOUBLE:
            raise TypeError("doubles are no exact numbers")
        factor = F.struct(F.col("factor_num").cast(frac.DECIMAL).alias("num"), F.col("factor_den").cast(frac.DECIMAL).alias("den"))
        lists = steps.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("step", "op", "target", "source", factor.alias("k")))).alias("steps"))
        given = self.to_fraction().dense().join(lists, ID, "left")

        def step(m: Column, s: Column) -> Column:
            other, k = F.get(m, s["source"]), frac.mark(s["k"])
            scaled = lambda row: F.transform(row, lambda x: frac.mul(frac.mark(x), k))
            added = lambda row: F.zip_with(row, other, lambda x, y: frac.add(frac.mark(x), frac.mul(frac.mark(y), k)))
            swapped = lambda row, i: F.when(i == s["target"], other).when(i == s["source"], F.get(m, s["target"])).otherwise(row)
            changed = lambda row: F.when(s["op"] == "scale", scaled(row)).otherwise(added(row))
            return F.when(s["op"] == "swap", F.transform(m, swapped)).otherwise(F.transform(m, lambda row, i: F.when(i == s["target"], changed(row)).otherwise(row)))

        done = given.select(ID, F.when(F.col("steps").isNull(), F.col("m")).otherwise(F.aggregate("steps", F.col("m"), step)).alias("m"))
        cells = done.select(ID, F.posexplode("m").alias("i", "r")).select(ID, "i", F.posexplode("r").alias("j", "val"))
        return self._with(cells, kind=FRAC)

    # text

    def render(self) -> DataFrame:
        """matrix_id, text: a bracketed line for each row, cells centred to the widest of the matrix, " | " before the constants."""
        kind = self.kind
        texts = self.dense().withColumn("t", F.transform("m", lambda r: F.transform(r, lambda x: kind.text(x))))
        texts = texts.withColumn("w", F.array_max(F.transform(F.flatten("t"), F.length)))
        cell = lambda s, k: F.concat(F.when(k == F.col("augment"), " | ").otherwise(""), vec.centred(s, F.col("w")))
        line = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, cell), ""), F.lit("]\n"))
        return texts.select(ID, F.array_join(F.transform("t", line), "").alias("text"))

    def repr(self) -> DataFrame:
        """matrix_id, text: a constructor call with all cells, and the line before constants if there is one."""
        kind = self.kind
        rows = F.transform("m", lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, lambda x: kind.repr(x)), ", "), F.lit("]")))
        tail = F.when(F.col("augment") < F.col("n_cols"), F.concat(F.lit(", "), F.col("augment").cast("string"))).otherwise("")
        return self.dense().select(ID, F.concat(F.lit("Matrix(["), F.array_join(rows, ", "), F.lit("]"), tail, F.lit(")")).alias("text"))
