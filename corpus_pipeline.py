"""The training-data pipeline: five stages over the documents, each written and read again.

All stages but the last return the columns of documents. Toxic documents go; of each group
of near-duplicates (five-word shingles, similarity 0.8) one document stays; documents that
hold a window of a benchmark item go; personal data are replaced in the texts of the rest,
which are then packed into sequences.

Defined cases, for every stage: a row is named by its id and text, so null ids and repeated
ids are rows of their own; rows that repeat id and text are one document, of which near_duplicates
keeps one row; a null or empty text has no n-grams (its score is that of the constant alone), is
linked with nothing, holds no passage and no personal data, and is packed as its end id alone; an
empty table gives an empty table. Further columns are passed on unchanged up to packing, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.catalog.base import Query
from meterlens.llm import decontamination, neardup, packing, pii, toxicity
from meterlens.llm.common import fresh, small_side, table
from meterlens.llm.queries import TOKENIZER, pii_key
from meterlens.session import settle


def _known(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a column that names them by id and text, and the name of that column."""
    name = fresh(docs, "named")
    key = F.md5(F.col("text").cast("binary")).alias("key")
    return docs.withColumn(name, F.struct("doc_id", key)), name


def _same(known: DataFrame, name: str, ids: DataFrame):
    named = known[name]
    return named["doc_id"].eqNullSafe(ids["id"]) & named["key"].eqNullSafe(ids["key"])


def _ids(rows: DataFrame) -> DataFrame:
    return settle(rows.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.key").alias("key")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one of rows that repeat."""
    known, name = _known(docs)
    groups = neardup.near_duplicates(known.select(name, "text"), id_column=name)
    kept = _ids(groups.filter("kept"))
    return (
        known.join(kept, _same(known, name, kept), "left_semi")
        .dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    known, name = _known(docs)
    hit = _ids(decontamination.contamination(
        known.select(name, "text"), table(spark, sf_dir, "benchmark"), id_column=name
    ).filter("contaminated"))
    return known.join(small_side(hit), _same(known, name, hit), "left_anti").select(*docs.columns)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and their new lengths."""
    replaced = pii.surrogates(docs, pii_key(spark))
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in packed sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal),
    ("packing", pack),
]

# No SQL trains a classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
