"""Reduced forms over a stream against batches, after every batch and after a restart."""

import random
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from ratiospark.operators.elimination import eliminate
from ratiospark.streaming import echelon

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield spark
    spark.conf.set(name, before)


def want(rows):
    r = eliminate([[Q(x) for x in row] for row in rows], len(rows[0]), reduce=True)
    cells = [x for row in r.rows[: len(r.pivots)] for x in row]
    return len(r.pivots), r.pivots, [str(x.numerator) for x in cells], [str(x.denominator) for x in cells]


def test_basis_of_rows_one_by_one():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 6)
        rows, basis = [], {}
        for _ in range(r.randint(1, 9)):
            rows.append([r.choice([0, 0, 1, -2, 7, 10**30]) for _ in range(n)])
            rank = len(basis)
            assert echelon.insert(basis, rows[-1]) == (len(basis) > rank)
            assert (len(basis), *echelon.reduced(basis)) == want(rows)


def test_streamed_rows_equal_batches(rocks, tmp_path):
    """Batch after batch, with the state restored by a new query each time."""
    spark, r, seen = rocks, random.Random(2), {}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "matrix_id long, row array<long>"
    for batch in range(4):
        rows = [(k, [r.randint(-5, 5) if r.random() < 0.7 else 0 for _ in range(3 + k)]) for k in range(4) for _ in range(r.randint(0, 2))] + [(0, None), (1, [1, None, 2, 3]), (None, [1])]
        for k, row in rows:
            if k is not None and row and None not in row:
                seen.setdefault(k, []).append(row)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

        def keep(df, number):
            df.withColumn("number", F.lit(number)).write.mode("append").parquet(out)

        query = echelon.echelon(spark.readStream.schema(schema).parquet(source)).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
        newest = {}
        for x in spark.read.parquet(out).collect():
            if x.matrix_id not in newest or x.number > newest[x.matrix_id].number:
                newest[x.matrix_id] = x
        assert {k: (x.rank, x.pivots, x.num, x.den) for k, x in newest.items() if x.rank} == {k: want(v) for k, v in seen.items() if want(v)[0]}


def test_ragged_rows_are_refused(rocks, tmp_path):
    spark = rocks
    spark.createDataFrame([(1, [1, 2]), (1, [1, 2, 3])], "matrix_id long, row array<long>").write.parquet(str(tmp_path / "in"))
    query = echelon.echelon(spark.readStream.schema("matrix_id long, row array<long>").parquet(str(tmp_path / "in"))).writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="ragged"):
        query.awaitTermination()
