"""Audit of how filters interact: what each removes, in every order and alone.

1. One pass over the texts gives each row the bits of the filters that look at it alone,
   and the MD5 of its text.
2. Filter E is an existential self-join. Rows whose MD5 occurs under several ids are
   fetched with their texts, each text is reduced to its smallest id, and a left-semi join
   on hash, exact text and smaller id marks the copies. Hot texts are split into lanes.
3. Marked ids and the other failures are united and added up to one set of bits per row;
   rows are counted by (part, bits), at most 32 per part, whatever the table's size.
4. All orders follow from these counts: a constant table says for each order and step which
   of the 32 combinations are kept, removed or redundant.

Defined cases: a null text is empty; a null part is an empty string; a null id is never
smaller than another and has no smaller one; rows that repeat id and text are no copies of
each other, and each counts; of several labels of an id the larger holds, and a label of a
null id is left out; an empty table gives an empty result; columns other than the three
named are not looked at. Rows that share id, part and MD5 are taken to share their text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import lanes_for_join, let, small_side
from meterlens.session import settle

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
COMBINATIONS = 1 << len(FILTERS)
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
LANE_ROWS = 1024

ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    def of_words(words: Column) -> Column:
        n = F.size(words).cast("long")
        distinct = F.size(F.array_distinct(words)).cast("long")
        return F.when(n < LEAST_WORDS, 1).otherwise(0) + F.when(
            100 * distinct < DISTINCT_PERCENT * n, 2
        ).otherwise(0)

    words = F.filter(F.split(text, SPACES), lambda word: word != "")
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return (
        let(words, of_words)
        + F.when(capitals > CAPITALS_PERCENT * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(MARKS), 8).otherwise(0)
    )


def later_copies(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of rows whose text some smaller id has.

    ``texts`` has (doc_id, part, hash, text); ``rows`` the same without the text, settled.
    """
    shared = settle(
        rows.groupBy("hash").agg(
            F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
        ).filter("low < high").select("hash", "n")
    )
    left, right = lanes_for_join(texts, shared, "hash", F.struct("doc_id", "part"), rows.count())
    lanes = F.ceil(F.col("n") / LANE_ROWS).cast("int")
    same = settle(
        left.join(small_side(settle(right)), ["hash", "lane"])
        .select("doc_id", "part", "hash", "text", "n",
                F.pmod(F.xxhash64("doc_id", "part"), lanes).cast("int").alias("lane"))
    )
    first = (
        same.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
        .select("hash", "text", "first", F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"))
    ).alias("f")
    on = [F.col(f"s.{c}") == F.col(f"f.{c}") for c in ("hash", "lane", "text")]
    smaller = F.col("f.first") < F.col("s.doc_id")
    return same.alias("s").join(first, [*on, smaller], "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str,
                 part_column: str) -> DataFrame:
    """(part, bits, n, good, toxic): rows of each part by the set of filters that they fail."""
    texts = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    ).withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = settle(texts.select("doc_id", "part", "hash", own_failures(F.col("text")).alias("bits")))
    marked = later_copies(texts, rows).select("*", F.lit(COPY).alias("bits"), F.lit(0).alias("n"))
    failed = (
        rows.withColumn("n", F.lit(1)).unionByName(marked)
        .groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
        # However often one id repeats, it has few rows when it meets its label.
        .groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    )
    known = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )

    def labelled(name: str) -> Column:
        return F.sum(F.when(F.col(name) == 1, F.col("n")).otherwise(0)).alias(name)

    return failed.join(known, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), labelled("good"), labelled("toxic")
    )


def step_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which combinations each (order, step) keeps, removes, finds removed before, and its filter."""
    bits = np.arange(COMBINATIONS)
    kept, removed, redundant, own = [], [], [], []
    for order in ORDERS:
        left = np.ones(COMBINATIONS, bool)
        for letter in order:
            which = FILTERS.index(letter)
            fails = (bits >> which & 1).astype(bool)
            removed.append(left & fails)
            redundant.append(~left & fails)
            left = left & ~fails
            kept.append(left)
            own.append(which)
    return tuple(np.array(t).astype(np.int64) for t in (kept, removed, redundant, own))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def _orders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, removed, redundant, own = step_tables()
    by_filter = np.stack([removed[own == f].sum(axis=0) for f in range(len(FILTERS))])
    order, step = (list(column) for column in zip(*STEPS))
    for batch in batches:
        for part, counts in zip(batch.column("part"), batch.column("counts")):
            n, good, toxic = np.zeros((3, COMBINATIONS), np.int64)
            for c in counts.as_py():
                n[c["bits"]], good[c["bits"]], toxic[c["bits"]] = c["n"], c["good"], c["toxic"]
            columns = (kept @ n, removed @ n, redundant @ n, n[1 << own], removed @ good,
                       removed @ toxic, (by_filter @ n)[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * len(STEPS)), pa.array(order), pa.array(step, pa.int32()),
                 *map(pa.array, columns)],
                names=["part", "filter_order", "step", *COUNTS],
            )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of ``COUNTS``."""
    counted = combinations(docs, labels, id_column, text_column, part_column)
    return counted.groupBy("part").agg(
        F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("counts")  # at most 32
    ).mapInArrow(_orders, RESULT)
