"""What the trained classifiers share: labels, held-out rows and the form of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import small_side
from meterlens.session import settle


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % of


def held_out(doc_id: Column, of: int, kept: int) -> Column:
    """True for the rows whose labels are never learned; a null id has none."""
    return F.coalesce(remainder(doc_id, of) == kept, F.lit(False))


def training_labels(
    labels: DataFrame, id_column: str, label_column: str, of: int, kept: int
) -> DataFrame:
    """(doc_id, label) of the rows to learn from, one per id (the larger of several labels)."""
    return settle(
        labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1))
        .filter(~held_out(F.col(id_column), of, kept))
        .groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label_column).cast("int").alias("label"))
    )


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, ...) that have a label; labels travel to them if their size allows."""
    return rows.join(small_side(labels), "doc_id")


def decided(scored: DataFrame, of: int, kept: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) from (doc_id, score)."""
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), of, kept).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
