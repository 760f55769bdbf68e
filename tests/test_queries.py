import glob
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

from ratiospark.plans import catalogue  # noqa: E402


def plain(x):
    if pd.isna(x):
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x


def compare(spark, run, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = run(spark, SF).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(str([plain(x) for x in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_whole_outer_product(spark):
    v = [r for r in catalogue.vectors(spark, SF).collect()]
    want = sorted((r.vec_id, i, j, int(x * y)) for r in v for i, x in enumerate(r.v) for j, y in enumerate(r.w))
    assert len(want) == sum(len(r.v) ** 2 for r in v) > 64 * len(v)
    got = catalogue.QUERIES["vec_outer"](spark, SF)
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["vec_id", "i", "j", "val"]


def test_entry_without_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 90
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streamed_gram(spark, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    from ratiospark.streaming.gram import gram_cells

    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/lineitem.parquet", tmp_path / "in")
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    make = lambda d: gram_cells(d, F.col("l_suppkey"), [F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")])
    q = make(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("grams").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("grams").collect()) == sorted(make(t).collect())


def test_gram_of_columns_past_64_bits(spark, tmp_path):
    from pyspark.sql import functions as F

    t = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 4 * 10**9)
    t.write.parquet(str(tmp_path / "lineitem.parquet"))
    names = ["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = [[int(x) for x in r] for r in t.select(*names).collect()]
    want = sorted((0, i, j, sum(r[i] * r[j] for r in rows)) for i in range(4) for j in range(4))
    assert max(w[3] for w in want) > 2**64
    assert sorted((r.matrix_id, r.i, r.j, int(r.val)) for r in catalogue.gram_columns(spark, str(tmp_path)).collect()) == want
    assert dict(catalogue.gram_columns(spark, SF).dtypes)["val"] == "bigint"
