"""Toxicity: expected severity from an ordinal regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .ordinal import OrdinalModel, train

#: P(severity >= 1) from which a document is toxic.
LIMIT = 0.5


def fit_toxicity(docs: DataFrame, labels: DataFrame, grade: Column | None = None, **how) -> OrdinalModel:
    """A model of severities: of the given grades 0, 1, 2, or of the label `toxic`, whose ones are graded 1 or 2 by the strength of the
    evidence for it (ordinal.graded)."""
    if grade is None:
        return train(docs, labels, F.col("toxic"), 2, split=True, **how)
    return train(docs, labels, grade, 3, **how)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None, **how) -> DataFrame:
    """One row per row of docs: doc_id, expected_severity, severity (0 clean, 1 toxic, 2 strongly toxic), p_toxic, toxic.

    The model is fitted on labels (see fit_toxicity and train), then scores every whole text. Null and empty texts have the features of
    an empty text; ids may be null or repeated; equal texts get equal scores; other columns are ignored; an empty table gives no rows."""
    model = fit_toxicity(docs, labels, grade, id_col=id_col, text_col=text_col, **how)
    s = docs.select(F.col(id_col).cast("long").alias("doc_id"), model.column(F.col(text_col)).alias("s"))
    p = F.element_at("s.tails", 1)
    return s.select("doc_id", F.col("s.expected").alias("expected_severity"), F.col("s.grade").alias("severity"), p.alias("p_toxic"), (p >= LIMIT).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None, **how) -> DataFrame:
    """docs without the toxic rows, columns unchanged.

    Null and empty texts go only if an empty text is toxic to the model; rows with null or repeated ids are judged each by its text, so
    repeated rows go or stay together; an empty table gives no rows; without labels no row goes."""
    model = fit_toxicity(docs, labels, grade, id_col=id_col, text_col=text_col, **how)
    return docs.filter(F.element_at(model.column(F.col(text_col)).getField("tails"), 1) < LIMIT)


def op10(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
