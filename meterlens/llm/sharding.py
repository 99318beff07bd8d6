"""Sharding by jump consistent hashing.

A document's key alone decides its shard, and one more shard takes rows only into
itself. No table of ring points is kept. Rows of a shard are numbered in key order:
the narrow rows are range-partitioned by (shard, key), and a row's slot is its global
place less the place where its shard begins.

Defined cases: a null key counts as key 0; a null text has no bytes and the checksum
of the empty text; rows with equal keys share a shard and have slots of their own in
an order fixed by size and checksum; an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import part_bases, parts_for
from meterlens.session import settle

# Fixed values of the published jump hash.
MULTIPLIER = 2862933555777941757
RANGE = 1 << 31

ROW_BYTES = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, from 0 to ``shards`` - 1."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = jump[moving]
        state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        # As published, the quotient is rounded before the product.
        jump[moving] = ((shard[moving] + 1) * (RANGE / draw)).astype(np.int64)
        moving = moving[jump[moving] < shards]
    return shard


def _shards(shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(jump_hash(keys, shards), pa.int32()),
                 pa.array(jump_hash(keys, shards + 1), pa.int32())],
                names=[*batch.schema.names, "shard", "grown_shard"],
            )

    return run


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)),
             pa.array(np.arange(nth, nth + n, dtype=np.int64))],
            names=[*batch.schema.names, "part", "nth"],
        )
        nth += n


def shard_documents(
    docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("key"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    columns = "doc_id long, key long, size long, text_crc32 long, shard int, grown_shard int"
    assigned = settle(narrow.mapInArrow(_shards(shards), columns))
    order = ["shard", "key", "doc_id", "size", "text_crc32"]
    numbered = settle(
        assigned.repartitionByRange(parts_for(assigned), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_numbered, columns + ", part int, nth long")
    )
    bases = part_bases(numbered.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    sizes = dict(numbered.groupBy("shard").count().collect())  # one row per shard
    begins = np.cumsum([0, *(sizes.get(s, 0) for s in range(shards))])
    part_base = np.array([bases.get(p, 0) for p in range(max(bases, default=0) + 1)], np.int64)

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = part_base[batch.column("part").to_numpy()] - begins[batch.column("shard").to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard", "grown_shard")]
                + [pa.array(base + batch.column("nth").to_numpy())],
                names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "slot"],
            )

    return numbered.mapInArrow(
        slots, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, slot long"
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
             "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_column: str = "doc_id") -> None:
    """Write whole rows into one folder per shard (``shard=...``).

    Null keys go where key 0 goes. A table with a column ``shard`` of its own is an error,
    since the folders would hide it; other columns are written unchanged.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the table has a column named shard, which the folders would replace")

    @F.pandas_udf("int")
    def shard_of(keys):
        import pandas as pd

        return pd.Series(jump_hash(keys.to_numpy(), shards).astype(np.int32))

    key = F.coalesce(F.col(id_column).cast("long"), F.lit(0))
    docs.withColumn("shard", shard_of(key)).write.partitionBy("shard").parquet(path)
