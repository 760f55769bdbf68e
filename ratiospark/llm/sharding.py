"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, spread, table, written

DIMS = ("bytes", "tokens", "rows")
KEY = ["__rs_k1", "__rs_k2", "__rs_k3"]


def _packer(capacity: list[float], residual: list[list[float]]):
    """A streaming packer: each unit goes where the dot product of its size and the residual capacity is highest.

    capacity: of one shard in one task, by dimension; residual: the part of it that is free at the start, by shard."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale, left, turn = np.array([1 / c if c else 0.0 for c in capacity]), np.array(residual), None
        for pdf in batches:
            if turn is None and len(pdf):
                turn = int(pdf["__rs_k1"].iloc[0]) % len(left)  # ties fall to other shards in other tasks
                left = np.roll(left, -turn, axis=0)
            sizes, at = pdf[[f"sum_{d}" for d in DIMS]].to_numpy(float) * scale, np.empty(len(pdf), np.int32)
            for i, v in enumerate(sizes):
                at[i] = s = int((left @ v).argmax())
                left[s] -= v
            pdf["shard"] = (at + (turn or 0)) % len(left)
            yield pdf[[*KEY, "__rs_chunk", "shard", *[f"sum_{d}" for d in DIMS]]]

    return pack


def _keyed(docs: DataFrame, id_col: str, text_col: str, group_col: str | None, overhead: int) -> DataFrame:
    """docs with _id, _size, _crc, _tokens and the group's key: the text's hash, crc and size, or group_col's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + F.lit(overhead)).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    key = [F.xxhash64(text), crc, size] if group_col is None else [F.xxhash64(group_col), F.lit(0).cast("long"), F.lit(0).cast("long")]
    return docs.withColumns({"__rs_id": F.col(id_col).cast("long"), "__rs_size": size, "__rs_crc": crc, "__rs_tokens": n_words(F.col(text_col))} | dict(zip(KEY, key, strict=True)))


def _chunk(rows: DataFrame, split: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(split), KEY, "left").withColumn("__rs_chunk", F.coalesce(F.pmod(F.xxhash64("__rs_id"), F.col("__rs_chunks")), F.lit(0)).cast("int"))


def _place(base: DataFrame, n_shards: int, units_per_task: int, max_tasks: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with keys and sizes -> the groups that are split (KEY, __rs_chunks), every unit's shard (KEY, __rs_chunk, shard), and the number of rows."""
    sums = [F.sum("__rs_size").alias("sum_bytes"), F.sum("__rs_tokens").alias("sum_tokens"), F.count(F.lit(1)).alias("sum_rows")]
    totals = base.agg(*sums).first()
    n_tasks = spread(totals["sum_rows"], units_per_task, max_tasks)
    share = [(totals[f"sum_{d}"] or 0) / n_shards for d in DIMS]
    part = F.greatest(*[F.col(f"sum_{d}") / s if s else F.lit(0.0) for d, s in zip(DIMS, share, strict=True)])  # of a shard
    # more than half a shard: at most 2 * n_shards groups for each dimension
    groups = base.groupBy(*KEY).agg(*sums)
    split = written(groups.filter((part > 0.5) & (F.col("sum_rows") > 1)).select(*KEY, F.ceil(2 * part).cast("int").alias("__rs_chunks")), "shard-split")
    units = written(_chunk(base, split).groupBy(*KEY, "__rs_chunk").agg(*sums).withColumn("part", part), "shard-units")
    order, schema = [F.desc("part"), *KEY, "__rs_chunk"], ", ".join(f"{k} long" for k in KEY) + ", __rs_chunk int, shard int, sum_bytes long, sum_tokens long, sum_rows long"
    if n_tasks == 1:
        return split, units.coalesce(1).sortWithinPartitions(*order).mapInPandas(_packer(share, [[1.0] * len(DIMS)] * n_shards), schema).select(*KEY, "__rs_chunk", "shard"), totals["sum_rows"]
    # at most 8 * n_shards * n_tasks units for each dimension
    large = F.col("part") * 8 * n_tasks > 1
    first = written(units.filter(large).coalesce(1).sortWithinPartitions(*order).mapInPandas(_packer(share, [[1.0] * len(DIMS)] * n_shards), schema), "shard-large")
    load = {r["shard"]: r for r in first.groupBy("shard").agg(*[F.sum(f"sum_{d}").alias(d) for d in DIMS]).collect()}
    residual = [[1 - load[i][d] / s if i in load and s else 1.0 for d, s in zip(DIMS, share, strict=True)] for i in range(n_shards)]
    dealt = units.filter(~large).repartition(n_tasks, *KEY, "__rs_chunk").sortWithinPartitions(*order)
    return split, first.unionByName(dealt.mapInPandas(_packer([s / n_tasks for s in share], residual), schema)).select(*KEY, "__rs_chunk", "shard"), totals["sum_rows"]


def pack_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, overhead: int = 8, units_per_task: int = 20_000, max_tasks: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, tokens, shard, slot.

    Rows of a group (equal texts, or equal group_col) are packed as one unit with the vector (bytes, tokens, rows), in falling
    order of size, each where the dot product with the residual capacity is highest. Units of more than an eighth of
    a task's share of a shard, whose number is bounded by the tasks, are placed first in one task; the others are dealt
    by hash to tasks that own equal parts of every shard's remaining capacity. A task holds one vector per shard, so
    that memory does not grow. A group larger than half a shard is split by id into chunks, so that a group of any size
    fits; smaller groups stay together. Slots count the rows of a shard without gaps: numbered within hash blocks and
    shifted by the counts of the blocks before.

    Null texts have no bytes, crc 0 and share a group with empty ones. Null and repeated ids are rows like others. An empty
    table gives no rows; other columns are ignored."""
    cols = dict.fromkeys([id_col, text_col, *([group_col] if group_col else [])])
    base = written(_keyed(docs.select(*cols), id_col, text_col, group_col, overhead).select("__rs_id", "__rs_size", "__rs_crc", "__rs_tokens", *KEY), "shard-rows")
    split, placed, n = _place(base, n_shards, units_per_task, max_tasks)
    n_blocks = spread(n, 50_000, 4096)
    rows = _chunk(base, split).join(placed, [*KEY, "__rs_chunk"]).withColumn("block", F.pmod(F.xxhash64("__rs_id", *KEY), F.lit(n_blocks)).cast("int"))
    rows = written(rows.select(F.col("__rs_id").alias("doc_id"), F.col("__rs_size").alias("size"), F.col("__rs_crc").alias("text_crc32"), F.col("__rs_tokens").alias("tokens"), "shard", "block", *KEY), "shard-placed")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # n_shards * 4096 rows at most
    starts = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", *KEY))
    return rows.withColumn("within", within).join(F.broadcast(starts), ["shard", "block"]).select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("within") - 1).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, overhead: int = 8, units_per_task: int = 20_000, max_tasks: int = 1024) -> DataFrame:
    """docs with the column shard (in place of one of that name), packed as by pack_shards."""
    keyed = _keyed(docs, id_col, text_col, group_col, overhead)
    split, placed, _ = _place(written(keyed.select("__rs_id", "__rs_size", "__rs_crc", "__rs_tokens", *KEY), "shard-rows"), n_shards, units_per_task, max_tasks)
    placed = written(placed.withColumnRenamed("shard", "__rs_shard"), "shard-placed")
    rows = _chunk(keyed, split).join(placed, [*KEY, "__rs_chunk"])
    return rows.select(*[c for c in docs.columns if c != "shard"], F.col("__rs_shard").alias("shard"))


def op1(spark, sf_dir):
    out = pack_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
