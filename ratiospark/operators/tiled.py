"""Exact reduced form and product of integer matrices that are too large for a task.

For the reduced form a matrix is kept in bands of ROWS rows, once for each of many primes. Elimination goes panel by panel, a panel being as many columns as a band
has rows: the bands' parts of the panel are reduced in one task for each prime, which gives each band the factors by which it takes in the
panel's pivot rows; then every band is updated by one product of matrices. The bands are written down after each panel. No task holds more
than a panel, a band and a panel's pivot rows. Rationals come back as in modular, block by block.
For the product matrices are cut into square tiles, which are joined instead of cells.

Primes are below 2^23, so that products of 64 pairs of residues and their sum are whole doubles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .modular import SPARE, _is_prime, rationals, remaindered

ROWS = 64
_LARGEST = (1 << 23) - 1

Key = tuple[pa.Scalar, ...]


def primes(n: int) -> list[int]:
    """The n largest primes below 2^23. There are over 500,000, enough for numbers of some 10 million bits."""
    found, x = [], _LARGEST
    while len(found) < n:
        if _is_prime(x):
            found.append(x)
        x -= 2
    return found


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], [name for name, _ in fields])


BANDS = "matrix_id long, p int, band int, n_rows int, n_cols int, line int, cells binary"


def _bands(high: int, ps: list[int]):
    """Rows of numbers of one band -> the band modulo each prime."""

    def run(key: Key, rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        n = min(high, first["n_rows"] - first["band"] * high)
        numbers = [[0] * first["n_cols"] for _ in range(n)]
        for r in rows.select(["i", "row"]).to_pylist():
            for c in r["row"]:
                numbers[r["i"] - first["band"] * high][c["j"]] = int(c["val"])
        short = all(abs(x) < 1 << 62 for row in numbers for x in row)
        given = np.array(numbers, np.int64 if short else object)
        head = (first["matrix_id"],)
        return _table([(*head, p, first["band"], first["n_rows"], first["n_cols"], first["augment"], np.mod(given, p).astype(np.int32).tobytes()) for p in ps], BANDS)

    return run


def _part(c: int, high: int):
    """The bands' columns of panel c, of those before the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                cells = np.frombuffer(r["cells"], np.int32).reshape(-1, r["n_cols"])[:, c * high : min((c + 1) * high, r["line"])]
                rows.append((r["matrix_id"], r["p"], r["band"], r["n_rows"], cells.shape[1], r["line"], cells.tobytes()))
            yield from _table(rows, BANDS).to_batches()

    return run


FACTORS = "matrix_id long, p int, band int, own array<int>, at array<int>, pivot_rows array<int>, pivot_cols array<int>, factors binary"


def factored(a: np.ndarray, used: np.ndarray, p: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Gauss-Jordan steps in the columns of a: (row, column) of the pivots, and by what each row takes in the pivots' rows as they were before.
    A pivot row is nothing but what it takes in. The first row that is not used and isn't zero gives a column's pivot."""
    a, pivots = a.astype(np.int64), []
    take = np.zeros((len(a), a.shape[1]), np.int64)
    used = used.copy()
    for col in range(a.shape[1]):
        free = np.flatnonzero((a[:, col] != 0) & ~used)
        if not len(free):
            continue
        row, q = int(free[0]), len(pivots)
        inverse = pow(int(a[row, col]), -1, p)
        take[row, q] = 1
        take[row, : q + 1] = take[row, : q + 1] * inverse % p
        a[row] = a[row] * inverse % p
        others = a[:, col].copy()
        others[row] = 0
        a = (a - others[:, None] * a[row]) % p
        take[:, : q + 1] = (take[:, : q + 1] - others[:, None] * take[row, : q + 1]) % p
        used[row] = True
        pivots.append((row, col))
    return pivots, take[:, : len(pivots)]


def _factor(c: int, high: int):
    """Parts of a panel, and the factors of the panel before -> each band's factors. own, at: the pivots among its rows, and their places among the
    panel's. pivot_rows, pivot_cols: all pivots so far."""

    def run(key: Key, parts: pa.Table, before: pa.Table) -> pa.Table:
        bands = sorted(parts.to_pylist(), key=lambda r: r["band"])
        p, width = bands[0]["p"], bands[0]["n_cols"]
        a = np.concatenate([np.frombuffer(r["cells"], np.int32).reshape(-1, width) for r in bands]) if width else np.zeros((bands[0]["n_rows"], 0), np.int64)
        last = before.slice(0, 1).to_pylist()
        rows, cols = (last[0]["pivot_rows"], last[0]["pivot_cols"]) if last else ([], [])
        used = np.zeros(len(a), bool)
        used[rows] = True
        pivots, take = factored(a, used, p)
        rows, cols, out = rows + [r for r, _ in pivots], cols + [c * high + k for _, k in pivots], []
        for r in bands:
            low = r["band"] * high
            mine = [(row - low, k) for k, (row, _) in enumerate(pivots) if low <= row < low + high]
            out.append((r["matrix_id"], p, r["band"], [x for x, _ in mine], [k for _, k in mine], rows, cols, take[low : low + high].astype(np.int32).tobytes()))
        return _table(out, FACTORS)

    return run


TAKEN = "matrix_id long, p int, at int, row binary"


def _pivot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands beside their factors -> the panel's pivot rows."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cells = np.frombuffer(r["cells"], np.int32).reshape(-1, r["n_cols"])
            rows += [(r["matrix_id"], r["p"], k, cells[x].tobytes()) for x, k in zip(r["own"], r["at"], strict=True)]
        yield from _table(rows, TAKEN).to_batches()


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands beside their factors and the panel's pivot rows -> the bands after the panel."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cells = np.frombuffer(r["cells"], np.int32).reshape(-1, r["n_cols"]).astype(float)
            if r["taken"]:
                pivots = np.stack([np.frombuffer(x["row"], np.int32) for x in sorted(r["taken"], key=lambda x: x["at"])]).astype(float)
                take = np.frombuffer(r["factors"], np.int32).reshape(len(cells), -1).astype(float)
                cells[r["own"]] = 0
                cells = (cells + take @ pivots) % r["p"]
            rows.append((r["matrix_id"], r["p"], r["band"], r["n_rows"], r["n_cols"], r["line"], cells.astype(np.int32).tobytes()))
        yield from _table(rows, BANDS).to_batches()


CELLS = "matrix_id long, i int, j int, num string, den string, pivots array<int>"


def _put_together(high: int, bits: int):
    """A band modulo all primes, with the pivots -> its cells, rows in the order of their pivots."""

    def run(key: Key, given: pa.Table) -> pa.Table:
        classes: dict[tuple, list] = {}
        for r in sorted(given.to_pylist(), key=lambda r: -r["p"]):
            classes.setdefault((tuple(r["pivot_rows"]), tuple(r["pivot_cols"])), []).append(r)
        (rows, cols), right = max(classes.items(), key=lambda x: len(x[1]))
        ps, bound, n_cols = [r["p"] for r in right], 1 << bits, right[0]["n_cols"]
        if math.prod(ps) <= 2 * bound * bound:
            raise ArithmeticError(f"too many of the primes divide numbers of matrix {right[0]['matrix_id']}")
        numbers, m = remaindered(np.stack([np.frombuffer(r["cells"], np.int32) for r in right]), ps)
        found = rationals(numbers, m, bound)
        place = {row: k for k, row in enumerate(rows)}
        place |= {row: k for k, row in enumerate((x for x in range(right[0]["n_rows"]) if x not in place), len(rows))}
        low = right[0]["band"] * high
        return _table([(right[0]["matrix_id"], place[low + k // n_cols], k % n_cols, *v, list(cols)) for k, v in enumerate(found)], CELLS)

    return run


def bound_bits(cells: DataFrame) -> int:
    """Bits of the product of the rows' lengths, the largest of all matrices; an upper bound of every minor."""
    x = F.col("val").cast("double")
    lengths = cells.groupBy("matrix_id", "i").agg(F.log2(F.sum(x * x) + 1).alias("l")).groupBy("matrix_id").agg((F.sum("l") / 2).alias("bits"))
    return math.ceil((lengths.agg(F.max("bits")).first()[0] or 0) * (1 + 1e-9)) + 1


def reduced(cells: DataFrame, header: DataFrame, high: int = ROWS) -> DataFrame:
    """cells (matrix_id, i, j, val: whole numbers), header (matrix_id, n_rows, n_cols, augment) -> CELLS of the reduced forms, numbers as text of any
    length. high: rows of a band, 64 at most. Cells that aren't there are zero; several of one place raise no error, the last counts.

    Constants of rows without a pivot are as the elimination leaves them, and in the order of the rows. Runs as jobs, one after another, a
    few for each panel of the widest matrix."""
    if not 1 <= high <= ROWS:
        raise ValueError(f"a band has 1 to {ROWS} rows")
    bits = bound_bits(cells)
    ps = primes(-(-(2 * bits + 2) // 22) + SPARE)
    spine = header.select("matrix_id", "n_rows", "n_cols", "augment", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("i"))
    lines = cells.groupBy("matrix_id", "i").agg(F.collect_list(F.struct("j", F.col("val").cast("string").alias("val"))).alias("row"))
    lines = spine.join(lines, ["matrix_id", "i"], "left").withColumn("row", F.coalesce("row", F.array().cast("array<struct<j:int,val:string>>"))).withColumn("band", F.floor(F.col("i") / high).cast("int"))
    bands = written(lines.groupBy("matrix_id", "band").applyInArrow(_bands(high, ps), BANDS), "bands")
    widest = header.agg(F.max("augment")).first()[0] or 0
    key, own = ["matrix_id", "p"], ["matrix_id", "p", "band"]
    factors = None
    for c in range(-(-widest // high)):
        before = factors.filter("band = 0") if factors is not None else bands.sparkSession.createDataFrame([], FACTORS)
        factors = written(bands.mapInArrow(_part(c, high), BANDS).groupBy(*key).cogroup(before.groupBy(*key)).applyInArrow(_factor(c, high), FACTORS), "factors")
        beside = bands.join(factors.select(*own, "own", "at", "factors"), own)
        taken = beside.filter(F.size("own") > 0).select(*own, "n_cols", "own", "at", "cells").mapInArrow(_pivot_rows, TAKEN)
        taken = taken.groupBy(*key).agg(F.collect_list(F.struct("at", "row")).alias("taken"))  # as many rows as a band has
        bands = written(beside.join(taken, key, "left").mapInArrow(_update, BANDS), "bands")
    signs = factors.filter("band = 0").select(*key, "pivot_rows", "pivot_cols") if factors is not None else bands.select(*key, F.array().cast("array<int>").alias("pivot_rows"), F.array().cast("array<int>").alias("pivot_cols")).distinct()
    return bands.join(signs, key).groupBy("matrix_id", "band").applyInArrow(_put_together(high, bits), CELLS)


# products

#: Rows and columns of a tile.
SIDE = 64
TILES = "matrix_id long, top int, left int, high int, wide int, whole int, cells binary"


def _tile(key: Key, rows: pa.Table) -> pa.Table:
    """Cells of one tile (at and across within it) -> the tile: 64-bit numbers, or text where one is longer."""
    at, across = rows.column("at").to_numpy(), rows.column("across").to_numpy()
    numbers = [int(v) for v in rows.column("val").to_pylist()]
    high, wide, whole = int(at.max()) + 1, int(across.max()) + 1, all(abs(x) < 1 << 62 for x in numbers)
    cells = np.zeros((high, wide), np.int64 if whole else object)
    np.add.at(cells, (at, across), np.array(numbers, cells.dtype))
    given = cells.tobytes() if whole else ",".join(map(str, cells.ravel())).encode()
    return _table([(key[0].as_py(), key[1].as_py(), key[2].as_py(), high, wide, int(whole), given)], TILES)


def _opened(r: dict, side: str) -> np.ndarray:
    given, shape = r[f"{side}_cells"], (r[f"{side}_high"], r[f"{side}_wide"])
    return np.frombuffer(given, np.int64).reshape(shape) if r[f"{side}_whole"] else np.array([int(x) for x in given.decode().split(",")], object).reshape(shape)


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b, exactly; b may have fewer rows than a has columns, or more (what is missing is zero). Small numbers as doubles, which hold
    them and their sums; others in unbounded integers."""
    n = min(a.shape[1], b.shape[0])
    a, b = a[:, :n], b[:n]
    largest = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if a.dtype != object and b.dtype != object and largest(a) * largest(b) * max(1, n) < 1 << 53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


def _multiplied(side: int):
    """Pairs of tiles -> the cells of their products, zeros left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = tile_product(_opened(r, "a"), _opened(r, "b"))
                i, j = np.nonzero(c)
                cols = [pa.array(np.full(len(i), r["matrix_id"], np.int64)), pa.array((i + side * r["top"]).astype(np.int32)), pa.array((j + side * r["left"]).astype(np.int32)), pa.array([str(v) for v in c[i, j]], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["matrix_id", "i", "j", "val"])

    return run


def product(a: DataFrame, b: DataFrame, side: int = SIDE) -> DataFrame:
    """Cells (matrix_id, i, j, val: whole numbers) of the products of the matrices of equal ids; zeros may be left out of all three. A pair of tiles
    is one row of the join and gives a cell's sum over `side` products, where a join of cells gives each of them a row. Numbers of over 38
    digits raise an error."""

    def tiles(cells: DataFrame, name: str) -> DataFrame:
        tile = lambda c: F.floor(F.col(c) / side).cast("int")
        dealt = cells.select("matrix_id", tile("i").alias("top"), tile("j").alias("left"), (F.col("i") % side).alias("at"), (F.col("j") % side).alias("across"), F.col("val").cast("string").alias("val"))
        packed = dealt.groupBy("matrix_id", "top", "left").applyInArrow(_tile, TILES)
        return packed.select("matrix_id", "top", "left", *[F.col(c).alias(f"{name}_{c}") for c in ("high", "wide", "whole", "cells")])

    both = tiles(a, "a").withColumnRenamed("left", "inner").join(tiles(b, "b").withColumnRenamed("top", "inner"), ["matrix_id", "inner"])
    parts = both.drop("inner").mapInArrow(_multiplied(side), "matrix_id long, i int, j int, val string")
    return parts.groupBy("matrix_id", "i", "j").agg(F.sum(F.col("val").cast("decimal(38,0)")).cast("decimal(38,0)").alias("val"))
