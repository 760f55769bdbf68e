"""Quality: expected grade and tail probability from an ordinal regression on graded ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .ordinal import OrdinalModel, train

#: P(grade >= 1) from which a document is kept.
LIMIT = 0.5


def fit_quality(docs: DataFrame, labels: DataFrame, grade: Column | None = None, **how) -> OrdinalModel:
    """A model of ratings: of the given grades 0, 1, 2, or of the label `quality`, whose ones are graded 1 or 2 by the strength of the
    evidence for it (ordinal.graded)."""
    if grade is None:
        return train(docs, labels, F.col("quality"), 2, split=True, **how)
    return train(docs, labels, grade, 3, **how)


def fit_good(docs: DataFrame, labels: DataFrame, **how) -> OrdinalModel:
    """A model of the label `quality` alone, without grades above it: one fit, for those who need p_good and no more."""
    return train(docs, labels, F.col("quality"), 2, **how)


def p_good(model: OrdinalModel, text: Column) -> Column:
    """P(grade >= 1) of texts."""
    return F.element_at(model.column(text).getField("tails"), 1)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None, **how) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, grade (0 low, 1 good, 2 surely good), p_good (grade 1 or more), p_best (grade 2), kept.

    The model is fitted on labels (see fit_quality and train), then scores every whole text. Null and empty texts have the features of an
    empty text; ids may be null or repeated; equal texts get equal scores; other columns are ignored; an empty table gives no rows."""
    model = fit_quality(docs, labels, grade, id_col=id_col, text_col=text_col, **how)
    s = docs.select(F.col(id_col).cast("long").alias("doc_id"), model.column(F.col(text_col)).alias("s"))
    good = F.element_at("s.tails", 1)
    return s.select("doc_id", F.col("s.expected").alias("expected_grade"), F.col("s.grade").alias("grade"), good.alias("p_good"), F.element_at("s.tails", 2).alias("p_best"), (good >= LIMIT).alias("kept"))


def op6(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
