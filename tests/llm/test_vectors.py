"""Centroid clustering against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiospark.llm import centroids

rng = random.Random(3)


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [x for _, x in first]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x: min(range(len(cs)), key=lambda c: (square(x, cs[c]), c))
    for _ in range(rounds):
        a = [nearest(x) for _, x in kept]
        for c in range(len(cs)):
            if own := [x for (_, x), b in zip(kept, a) if b == c]:
                cs[c] = [sum(v) // len(own) for v in zip(*own)]
    a = [nearest(x) for _, x in kept]
    d = [square(x, cs[c]) for (_, x), c in zip(kept, a)]
    per = [sum(v for v, b in zip(d, a) if b == c) for c in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((str(i), c, v, per[c], sum(per), sha[c]) for (i, _), c, v in zip(kept, a, d))


def vectors():
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(11)]
    rows = [(i, [v + rng.gauss(0, 0.3) for v in rng.choice(heads)]) for i in range(500)]
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [float("nan")] * 64), (505, [float("inf")] + [0.0] * 63), (506, [1.0] * 65), (507, [-0.0005] * 64)]
    rows += [(600 + i, rows[0][1]) for i in range(40)] + [rows[3], rows[3], (None, rows[4][1]), (None, rows[5][1])]
    return rows


def found(df, **more):
    return sorted((str(r["vec_id"]), *tuple(r)[1:]) for r in centroids.sort_means(df, **more).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK", 64)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("x") for n in ("x", "h", "chunk", "n", "a", "cluster", "label")})
    before = {t.name for t in spark.catalog.listTables()}
    assert found(df) == brute(rows)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert found(df.repartition(7)) == brute(rows)


def test_large_numbers(spark):
    """Components whose squares doubles don't hold; a distance over 63 bits is null."""
    rows = [(i, [float(rng.choice([3e4, 3e4 + 1, -7e4]) + i % 3) for _ in range(64)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == brute(rows)
    far = spark.createDataFrame([(1, [0.0] * 64), (2, [1e12] * 64), (3, [2e12] * 64)], "vec_id long, embedding array<double>")
    got = centroids.sort_means(far, k=1).collect()
    assert {r["distance"] for r in got} >= {None} and {r["inertia"] for r in got} == {None}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df) == brute(rows)


def test_scan_skips_only_what_is_further():
    """Distances of the scan are the least ones, with ties to the smaller number, from any start."""
    g = np.random.default_rng(1)
    cs = g.integers(-3, 4, (9, 4))
    cs[5] = cs[2]
    x = g.integers(-3, 4, (3000, 4)).astype(float)
    d = ((x[:, None] - cs[None]) ** 2).sum(axis=2)
    means = centroids.SortMeans(cs.tolist())
    for before in (np.zeros(3000, int), g.integers(0, 9, 3000)):
        a, own = means.assign(x, before)
        assert (a == d.argmin(axis=1)).all() and (own == d.min(axis=1)).all()
