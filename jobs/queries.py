"""The jobs as queries: each runs its job twice into one new folder and returns the output as it stands then."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from ratiospark.scratch import fresh_folder

from . import solve_systems, text_regression


def _config(name: str) -> dict:
    return json.loads(Path(__file__).with_name(name).read_text())


def job1(spark, sf_dir):
    """Bytes of documents by their words and lines, for each source. A glob, since the table may be one file."""
    folder = fresh_folder(spark, "job1")
    for _ in range(2):
        text_regression.run(spark, _config("text_regression.json"), f"{sf_dir}/documents.parquet*", folder, f"{folder}/checkpoint")
    out = text_regression.result(spark, folder)
    return out.select(F.col("grp").alias("source"), "feature", "num", "den", "rank", "status", "n")


def job2(spark, sf_dir):
    """A system of two equations for each customer."""
    folder = fresh_folder(spark, "job2")
    for _ in range(2):
        solve_systems.run(spark, _config("solve_systems.json"), sf_dir, folder)
    return solve_systems.result(spark, folder).select("matrix_id", "rank", "status", "j", "num", "den")


QUERIES = {"job1_text_regression": job1, "job2_solve_systems": job2}


def _det(a: list[list[str]]) -> str:
    return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"


_X = ["1", "w", "l"]
_GRAM = [[f"g{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_RIGHT = ["h0", "h1", "h2"]


def _cramer(k: int) -> str:
    return _det([[_RIGHT[i] if j == k else _GRAM[i][j] for j in range(3)] for i in range(3)])


def _reduced(n: str, d: str) -> str:
    return f"CAST(sign({d}) * {n} // greatest(gcd({n}, {d}), 1) AS VARCHAR) AS num, CAST(abs({d}) // greatest(gcd({n}, {d}), 1) AS VARCHAR) AS den"


_SUMS = ", ".join(
    [f"CAST(sum(CAST({_X[i]} AS HUGEINT) * {_X[j]}) AS HUGEINT) AS g{i}{j}" for i in range(3) for j in range(i, 3)] + [f"CAST(sum(CAST({x} AS HUGEINT) * y) AS HUGEINT) AS h{i}" for i, x in enumerate(_X)]
)
_MINORS = " OR ".join(f"{_GRAM[i][i]} * {_GRAM[j][j]} <> {_GRAM[i][j]} * {_GRAM[i][j]}" for i in range(3) for j in range(i + 1, 3))

ORACLE_SQL = {
    # a Gram matrix is never contradictory, and its rank shows in its principal minors
    "job1_text_regression": rf"""
WITH t AS (
  SELECT source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w,
    CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS BIGINT) AS l, CAST(strlen(coalesce(text, '')) AS BIGINT) AS y FROM documents
), s AS (SELECT source, count(*) AS n, {_SUMS} FROM t GROUP BY source),
d AS (SELECT *, {_det(_GRAM)} AS det FROM s),
r AS (SELECT *, CAST(CASE WHEN det <> 0 THEN 3 WHEN {_MINORS} THEN 2 ELSE 1 END AS INTEGER) AS rank FROM d),
c AS ({" UNION ALL ".join(f"SELECT source, '{f}' AS feature, {_cramer(k)} AS p, det AS q, rank, 'unique' AS status, n FROM r WHERE det <> 0" for k, f in enumerate(["constant", "words", "lines"]))})
SELECT source, feature, {_reduced("p", "q")}, rank, status, n FROM c
UNION ALL SELECT source, NULL, NULL, NULL, rank, 'many', n FROM r WHERE det = 0""",
    "job2_solve_systems": f"""
WITH o AS (
  SELECT o_custkey AS matrix_id, o_orderkey % 2 AS i, month(o_orderdate) % 2 AS j, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders
), s AS (
  SELECT matrix_id, {", ".join(f"CAST(sum(CASE WHEN i = {i} AND j = {j} THEN v ELSE 0 END) AS HUGEINT) AS a{i}{j}" for i in range(2) for j in range(2))},
    {", ".join(f"CAST(sum(CASE WHEN i = {i} THEN 1 ELSE 0 END) AS HUGEINT) AS b{i}" for i in range(2))} FROM o GROUP BY 1
), d AS (SELECT *, a00 * a11 - a01 * a10 AS det, a00 <> 0 OR a01 <> 0 OR a10 <> 0 OR a11 <> 0 AS filled FROM s),
r AS (
  SELECT *, CAST(CASE WHEN det <> 0 THEN 2 WHEN filled THEN 1 ELSE 0 END AS INTEGER) AS rank,
    CASE WHEN det <> 0 THEN 'unique' WHEN a00 * b1 <> a10 * b0 OR a01 * b1 <> a11 * b0 OR (a00 = 0 AND a01 = 0 AND b0 <> 0) OR (a10 = 0 AND a11 = 0 AND b1 <> 0) THEN 'none' ELSE 'many' END AS status FROM d
)
SELECT matrix_id, rank, status, CAST(0 AS INTEGER) AS j, {_reduced("(b0 * a11 - b1 * a01)", "det")} FROM r WHERE status = 'unique'
UNION ALL SELECT matrix_id, rank, status, CAST(1 AS INTEGER) AS j, {_reduced("(a00 * b1 - a10 * b0)", "det")} FROM r WHERE status = 'unique'
UNION ALL SELECT matrix_id, rank, status, NULL, NULL, NULL FROM r WHERE status <> 'unique'""",
}
