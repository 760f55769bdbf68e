"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .centroids import op11
from .common import table
from .decontamination import op5
from .exact_dedup import exact_dedup
from .html_extract import op7
from .line_dedup import op8
from .mixing import op2
from .quality import op6
from .sharding import op1
from .simhash import op3
from .suffix_dedup import op12
from .toxicity import op10
from .warc import op4


def op9(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1, "op2_mixing": op2, "op3_simhash": op3, "op4_warc": op4, "op5_decontamination": op5, "op6_quality": op6, "op7_html_extract": op7, "op8_line_dedup": op8, "op9_exact_dedup": op9, "op10_toxicity": op10, "op11_centroids": op11, "op12_suffix_dedup": op12}



def _clusters_sql(size: int = 64, k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds written out: nearest centroids, then floors of means."""
    square = f"CAST(list_sum(list_transform(range(1, {size + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS line, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT v.line, v.vec_id, v.x, c.c, {square} AS d FROM v, c{r} c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY d, c) AS rk FROM d{r}) WHERE rk = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) t(i) GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"""
WITH {", ".join(parts)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)"""


ORACLE_SQL = {
    "op11_centroids": _clusters_sql(),
    "op4_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p""",
    "op9_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, row_number() OVER w AS rk, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, rk = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op12_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS line, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT line, doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT line, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
m AS (SELECT line, i FROM (SELECT line, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT line, i, sum(fresh) OVER (PARTITION BY line ORDER BY i) AS run FROM (SELECT line, i, CASE WHEN i > lag(i) OVER (PARTITION BY line ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM m)),
r AS MATERIALIZED (SELECT line, run, min(i) AS a, max(i) + 49 AS z FROM g GROUP BY line, run),
k AS (SELECT line, a AS till, coalesce(lag(z) OVER (PARTITION BY line ORDER BY a), 0) AS since FROM (SELECT line, a, z FROM r UNION ALL SELECT line, octet_length(b) + 1, octet_length(b) + 1 FROM d)),
p AS (SELECT k.line, string_agg(hex(array_slice(b, since + 1, till - 1)), '' ORDER BY since) AS kept FROM k JOIN d USING (line) WHERE since + 1 <= till - 1 GROUP BY k.line),
n AS (SELECT line, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM r GROUP BY line)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(coalesce(unhex(kept), ''::BLOB)) AS kept_sha256
FROM d LEFT JOIN p USING (line) LEFT JOIN n USING (line)""",
}
