"""Clustering of integer vectors around centroids by sort-means."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch, table

#: Fixed values of the contract.
SIZE = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = "3"
#: Vectors in a chunk, a row of the tables that the rounds read.
CHUNK = 4096
#: Components up to this give squared distances that doubles hold exactly; others are reckoned in Python's unbounded integers.
EXACT = 1 << 22
_LONG = 1 << 63


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(vec_id, x): rows with exactly size components, none null or not finite, as doubles SCALE * x; their floors are the vectors."""
    x = F.col(vector_col).cast("array<double>")
    fine = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: v * SCALE)  # a power of two: exact; the floor is taken with the chunks
    return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def seeds(vectors: DataFrame, k: int, seed: str = SEED) -> list[list[int]]:
    """The k vectors with the least hashes of their ids, of equal ids the least in order of components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[math.floor(v) for v in r["x"]] for r in vectors.orderBy(F.asc_nulls_last(h), "x").select("x").limit(k).collect()]


def _chunks(size: int):
    """(vec_id, x, h) of a chunk -> one row: ids and components as bytes, in the order of h."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("h").to_numpy(), kind="stable")))
        x = np.floor(rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, size))
        ids = rows.column("vec_id")
        kind = "i2" if np.abs(x).max() < 1 << 15 else "f8"
        known = np.array(ids.is_valid())
        cols = [[key[0].as_py()], [len(x)], [kind], [ids.fill_null(0).to_numpy().tobytes()], [known.tobytes()], [x.astype(kind).tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["chunk", "n", "kind", "ids", "known", "x"])

    return run


CHUNKS = "chunk long, n int, kind string, ids binary, known binary, x binary"


def _exact(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from c: exact, as doubles of small whole numbers or as integers."""
    if x.dtype == object or c.dtype == object:
        d = (x if x.dtype == object else _exact(x)) - (c if c.dtype == object else _exact(c[None])[0])
        return (d * d).sum(axis=1)
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class SortMeans:
    """Centroids, their distances from each other, and for each the others from the nearest on."""

    def __init__(self, centroids: list[list[int]]):
        small = all(abs(v) <= EXACT for c in centroids for v in c)
        self.centroids = np.array(centroids, float) if small else np.array(centroids, object)
        k = len(centroids)
        self.apart = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in centroids] for x in centroids]
        self.order = [sorted((j for j in range(k) if j != i), key=lambda j: (self.apart[i][j], j)) for i in range(k)]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids (of equally near ones the smaller number) and squared distances. Each vector's scan begins at its centroid
        before and goes through the others by their distance from that one; it stops where this is over twice the vector's own, as all
        from there on are further off. An equal distance is still looked at, for its smaller number."""
        if x.dtype != object and len(x) and np.abs(x).max() > EXACT:
            x = _exact(x)
        best = before.astype(np.int64)
        kind = object if x.dtype == object or self.centroids.dtype == object else float
        distance = np.zeros(len(x), kind)
        for start in np.unique(before).tolist():
            rows = np.flatnonzero(before == start)
            own = _squares(x[rows], self.centroids[start])
            distance[rows] = own
            for other in self.order[start]:
                going = self.apart[start][other] <= 4 * own
                rows, own = rows[going.astype(bool)], own[going.astype(bool)]
                if not len(rows):
                    break
                d = _squares(x[rows], self.centroids[other])
                nearer = ((d < distance[rows]) | ((d == distance[rows]) & (other < best[rows]))).astype(bool)
                best[rows[nearer]], distance[rows[nearer]] = other, d[nearer]
        return best, distance


def _vectors(batch: pa.RecordBatch, i: int, size: int) -> np.ndarray:
    n, kind = batch.column("n")[i].as_py(), batch.column("kind")[i].as_py()
    return np.frombuffer(batch.column("x")[i].as_py(), kind, n * size).reshape(n, size).astype(float)


def _before(batch: pa.RecordBatch, i: int) -> np.ndarray:
    given = batch.column("a")[i].as_py() if "a" in batch.schema.names else None
    n = batch.column("n")[i].as_py()
    return np.zeros(n, np.int64) if given is None else np.frombuffer(given, np.int32, n).astype(np.int64)


def _sums(x: np.ndarray, a: np.ndarray, k: int) -> list[list[str] | None]:
    """For each cluster the sums of the components, as text of any length."""
    out = []
    for c in range(k):
        own = x[a == c]
        small = not len(own) or np.abs(own).max() <= EXACT  # sums of CHUNK of these are exact in doubles
        total = own.sum(axis=0).astype(np.int64) if small else _exact(own).sum(axis=0)
        out.append([str(int(v)) for v in total] if len(own) else None)
    return out


def _round(means: SortMeans, size: int):
    """Chunks and the assignment before -> the new one and the sums of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                x = _vectors(batch, i, size)
                a, _ = means.assign(x, _before(batch, i))
                k = len(means.order)
                rows.append((batch.column("chunk")[i].as_py(), a.astype(np.int32).tobytes(), np.bincount(a, minlength=k).tolist(), _sums(x, a, k)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["chunk", "a", "times", "sums"])

    return run


ROUND = "chunk long, a binary, times array<long>, sums array<array<string>>"


def _last(means: SortMeans, size: int):
    """Chunks and the assignment before -> a row for each vector; a distance over 63 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, d = means.assign(_vectors(batch, i, size), _before(batch, i))
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                known = np.frombuffer(batch.column("known")[i].as_py(), bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(a.astype(np.int32)), pa.array([int(v) if v < _LONG else None for v in d.tolist()], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


class _Tables:
    """Tables of one run, bucketed by chunk so that a round's join moves no vectors; with names and folders of their own."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.folder, self.names = spark, buckets, scratch(spark, "centroids"), []

    def save(self, df: DataFrame) -> DataFrame:
        name = f"centroids_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "chunk").sortBy("chunk").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def sort_means(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """One row per kept row of df: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly size components, none null or not finite, as whole numbers floor(SCALE * x). Centroids begin as the k kept
    vectors with the least hashes of seed and id. A round assigns every vector by SortMeans and moves each centroid that has vectors
    to the floor of their mean, exactly; all rounds and a last assignment are done. Vectors are packed once, in chunks of CHUNK, into a
    table bucketed by chunk; a round reads it beside the assignment before, bucketed alike, and moves sums of chunks alone.

    With fewer than k kept vectors each is a centroid; without any there are no rows. Equal distances go to the smaller number. Rows of
    one id are vectors like others; a null id comes last among the hashes. Sums of components are exact up to 38 digits, beyond that
    an error, as is a component over 10^305; distances and inertias beyond 63 bits are null. Other columns are ignored."""
    spark = df.sparkSession
    vectors = kept_vectors(df, id_col, vector_col, size)
    first = seeds(vectors, k, seed)
    if not first:
        nothing = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], nothing)
    n_chunks = max(1, -(-vectors.count() // CHUNK))
    buckets = max(1, min(n_chunks, partitions(spark)))
    tables = _Tables(spark, buckets)
    h = F.xxhash64("vec_id", "x")
    keyed = vectors.withColumn("h", h).withColumn("chunk", F.pmod(F.col("h"), F.lit(n_chunks)).cast("long")).repartition(buckets, "chunk")
    packed = tables.save(keyed.groupBy("chunk").applyInArrow(_chunks(size), CHUNKS))
    means, held = SortMeans(first), None
    read = lambda *cols: packed.select("chunk", *cols) if held is None else packed.select("chunk", *cols).join(held.select("chunk", "a"), "chunk")
    centroids = first
    for _ in range(rounds):
        held = tables.save(read("n", "kind", "x").mapInArrow(_round(means, size), ROUND))
        cells = held.select(F.posexplode("sums").alias("c", "s")).filter("s IS NOT NULL").select("c", F.posexplode("s").alias("j", "v"))
        total = cells.groupBy("c", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # k * size rows
        times = {r["c"]: r["n"] for r in held.select(F.posexplode("times").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()}
        moved = {(r["c"], r["j"]): int(r["v"]) // times[r["c"]] for r in total}
        centroids = [[moved.get((c, j), v) for j, v in enumerate(x)] for c, x in enumerate(centroids)]
        means = SortMeans(centroids)
    out = read("n", "kind", "x", "ids", "known").mapInArrow(_last(means, size), "vec_id long, cluster int, distance long")
    path = scratch(spark, "assigned")
    out.write.parquet(path)
    tables.drop()
    done = spark.read.schema(out.schema).parquet(path)
    whole = "decimal(38,0)"
    per = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast(whole))).alias("s")).collect()}  # k rows
    fits = lambda v: F.lit(int(v) if v is not None and v < _LONG else None).cast("long")
    inertia = None if None in per.values() else sum(per.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return done.select(
        "vec_id", "cluster", "distance", of([fits(per.get(c)) for c in range(len(sha))]).alias("cluster_inertia"), fits(inertia).alias("inertia"), of([F.lit(s) for s in sha]).alias("centroid_sha256")
    )


def op11(spark, sf_dir):
    return sort_means(table(spark, sf_dir, "embeddings"))
