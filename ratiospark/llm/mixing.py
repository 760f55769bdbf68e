"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, table, written
from .quality import fit_good, p_good

#: Cells of the order-preserving histogram of keys for each source: FINE coarse ones of FINE each.
FINE = 1 << 10
CELLS = FINE * FINE
LEAST_WEIGHT = 0.25


def quality_weight(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> Column:
    """Between LEAST_WEIGHT and 1: P(good) of the text under the model of the label `quality` (quality.fit_good); without labels
    LEAST_WEIGHT for all."""
    return F.greatest(F.lit(LEAST_WEIGHT), p_good(fit_good(docs, labels, id_col=id_col, text_col=text_col, **how), F.col(text_col)))


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sk, source_size -> also target. Sources in order of sk take the weights in turn; a target stops at most times its
    source's size and what is over goes to the others by weight, until none is above. One row per source, no row of a document.

    In order of (cap / weight), the capped sources are a prefix: the shortest one after which the level reached by the rest
    is not above the next source's own ratio."""
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy("sk")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = everything.orderBy("ratio", "sk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sk", "level"))).over(everything))
    free = F.struct("ratio", "sk") >= F.struct(F.col("final.ratio").alias("ratio"), F.col("final.sk").alias("sk"))
    return s.withColumn("target", F.when(free, F.col("w") * F.col("final.level")).otherwise(F.col("cap"))).select("sk", "source_size", "target")


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    """docs with _id, _tie, _sk (source, null last), _size (words), _key and its _cell."""
    text = F.col(text_col)
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    docs = docs.withColumns({
        "__rs_id": F.col(id_col).cast("long"), "__rs_tie": F.xxhash64(text), "__rs_sk": F.when(F.col(source_col).isNull(), "t").otherwise(F.concat(F.lit("s"), F.col(source_col))),
        "__rs_size": n_words(text), "__rs_key": -F.log(u) / (F.lit(1.0) if weight is None else F.greatest(F.lit(LEAST_WEIGHT), weight)),
    })
    return docs.withColumn("__rs_cell", F.least(F.lit(CELLS - 1), F.floor((1 - F.exp(-F.col("__rs_key") * LEAST_WEIGHT)) * CELLS)).cast("int"))


def _edge(cells: DataFrame, goal: DataFrame, cell: str) -> DataFrame:
    """goal with edge and start: the last cell that begins within the budget, and the words before it. cells: sk, cell, words, with at
    most FINE rows a source; goal.start is where they begin."""
    before = F.sum("words").over(Window.partitionBy("__rs_sk").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.withColumn("before", F.coalesce(before, F.lit(0))).join(goal, "__rs_sk").withColumn("begin", F.col("start") + F.col("before")).filter(F.col("begin") <= F.col("budget"))
    edge = starts.groupBy("__rs_sk").agg(F.max(F.struct(F.col(cell).alias("c"), "begin")).alias("e"))
    return goal.drop("start").join(edge, "__rs_sk").withColumns({f"edge_{cell}": F.col("e.c"), "start": F.col("e.begin")}).drop("e")


def _sources(base: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """sk and __rs_source: size, target, epochs, the cell in which the budget ends and the last place taken in it.

    The edge is looked for among FINE coarse cells, then among the FINE cells of one of these, then among the rows of one of those."""
    coarse = base.withColumn("coarse", F.floor(F.col("__rs_cell") / FINE).cast("int"))
    cells = written(coarse.groupBy("__rs_sk", "coarse").agg(F.sum("__rs_size").alias("words")), "mix-cells")
    goal = targets(cells.groupBy(F.col("__rs_sk").alias("sk")).agg(F.sum("words").alias("source_size")), weights, most).withColumnRenamed("sk", "__rs_sk")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = written(goal.withColumns({"budget": F.col("target") - F.col("epochs") * F.col("source_size"), "start": F.lit(0).cast("long")}), "mix-goal")
    first = written(_edge(cells, goal, "coarse"), "mix-edge")
    inner = coarse.join(first.select("__rs_sk", "edge_coarse"), "__rs_sk").filter(F.col("coarse") == F.col("edge_coarse"))
    cells = written(inner.groupBy("__rs_sk", F.col("__rs_cell").alias("fine")).agg(F.sum("__rs_size").alias("words")), "mix-cells")
    edge = written(_edge(cells, first, "fine"), "mix-edge")
    upto = F.col("start") + F.sum("__rs_size").over(Window.partitionBy("__rs_sk").orderBy("__rs_key", F.asc_nulls_first("__rs_id"), "__rs_tie").rowsBetween(Window.unboundedPreceding, 0))
    close = base.join(edge, "__rs_sk").filter(F.col("__rs_cell") == F.col("edge_fine")).withColumn("chosen", 2 * upto - F.col("__rs_size") < 2 * F.col("budget"))
    last = close.filter("chosen").groupBy("__rs_sk").agg(F.max(F.struct("__rs_key", "__rs_id", "__rs_tie")).alias("last"))
    return written(edge.join(last, "__rs_sk", "left").select("__rs_sk", F.struct("source_size", "target", "epochs", F.col("edge_fine").alias("cell"), "last").alias("__rs_source")), "mix-sources")


def _repeats() -> Column:
    s, place = F.col("__rs_source"), F.struct("__rs_key", "__rs_id", "__rs_tie")
    chosen = (F.col("__rs_cell") < s["cell"]) | ((F.col("__rs_cell") == s["cell"]) & F.coalesce(place <= s["last"], F.lit(False)))
    return s["epochs"] + chosen.cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, repeats, taken (words, repeats counted).

    weight: a document's quality, LEAST_WEIGHT at least, for instance quality_weight; without it all are alike.

    A source first gives whole epochs; the rest of its target comes from a sample without replacement: every document gets
    the key -ln(u) / weight, u from a hash of the id and seed, keys are sorted within the source and sizes summed up to
    the budget. The document on the budget's edge is taken if that ends nearer to it. Reruns agree.

    To sort no source in one task, keys go into CELLS cells in their order; cells below the one with the edge are taken
    whole, those above not at all, and rows are sorted in the cell with the edge alone (about 4 / CELLS of the source).
    Sums of cells find that cell in two steps, with FINE rows a source in each.

    Null texts have no words; null sources form the last source; equal keys are ordered by id (null first) and text hash,
    and rows that agree in these are taken together. An empty table gives no rows; other columns are ignored."""
    base = _keyed(docs.select(*dict.fromkeys([id_col, text_col, source_col])), seed, id_col, text_col, source_col, weight).select(F.col(source_col).alias("source"), "__rs_id", "__rs_tie", "__rs_sk", "__rs_size", "__rs_key", "__rs_cell")
    base = written(base, "mix-rows")
    rows = base.join(_sources(base, weights, most), "__rs_sk")
    return rows.select(F.col("__rs_id").alias("doc_id"), "source", F.col("__rs_size").alias("size"), "__rs_source.source_size", "__rs_source.target", _repeats().alias("repeats"), (_repeats() * F.col("__rs_size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """docs as mix takes them: each row as many times as it is taken, columns unchanged; nulls, ties, repeated rows and empty tables as
    for mix. Texts are written once beside their keys and not shuffled."""
    keyed = written(_keyed(docs, seed, id_col, text_col, source_col, weight), "mix-rows")
    sources = _sources(keyed.select("__rs_id", "__rs_tie", "__rs_sk", "__rs_size", "__rs_key", "__rs_cell"), weights, most)
    rows = keyed.join(sources, "__rs_sk").withColumn("__rs_n", _repeats().cast("int")).filter("__rs_n > 0")
    return rows.withColumn("__rs_n", F.explode(F.sequence(F.lit(1), "__rs_n"))).select(docs.columns)


def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix(docs, weight=quality_weight(docs, table(spark, sf_dir, "labels"))).select("doc_id", "source", "size", "source_size", "target", "taken")
