"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Which bins are open depends only on how many pieces there are of each length, so
the packing is planned on the table of lengths (at most ``capacity`` rows) and is
the exact best-fit-decreasing packing of all pieces of the corpus. A segment tree
over remaining capacities finds the tightest open bin in logarithmic time; pieces
of one length that meet bins with one remaining capacity are placed together. The
plan is then applied by every task to its own pieces: a piece knows its rank among
the pieces of its length from its place in its partition and the counts of the
partitions before.

Defined cases: a null or empty text is one piece that holds the end id alone;
repeated rows are packed each for itself; an empty table gives an empty table;
columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import running_base
from meterlens.llm.tokens import encoder
from meterlens.session import settle

CAPACITY = 2048
END_ID = 0


class Capacities:
    """Segment tree: which remaining capacities some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)

    def set(self, remaining: int, some: bool) -> None:
        node = remaining + self.leaves
        self.some[node] = int(some)
        while node > 1:
            node >>= 1
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """Smallest capacity of at least ``length`` that an open bin has."""
        node = length + self.leaves
        if self.some[node]:
            return length
        while node > 1 and (node & 1 or not self.some[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node + (not self.some[2 * node])
        return node - self.leaves


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), sorted: where pieces of each length go.

    A row holds for ranks from its first to that of the next row of its length;
    rank ``first + i`` goes into bin ``first bin + i``.
    """
    tree, bins = Capacities(capacity), 0
    runs: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs of bins
    plan: list[tuple[int, int, int, int]] = []

    def fill(length: int, rank: int, first: int, n: int, remaining: int, each: int) -> int:
        for layer in range(each):
            plan.append((length, rank, first, capacity - remaining + layer * length))
            rank += n
        left = remaining - each * length
        if left:
            runs.setdefault(left, []).append((first, n))
            tree.set(left, True)
        return rank

    for length in sorted(counts, reverse=True):
        need, rank = counts[length], 0
        while rank < need:
            remaining = tree.tightest(length)
            rest = need - rank
            if remaining is None:
                each = min(capacity // length, rest)
                n = rest // each
                rank = fill(length, rank, bins, n, capacity, each)
                bins += n
                continue
            first, n = runs[remaining].pop()
            each = min(remaining // length, rest)
            used = min(n, rest // each)
            if used < n:
                runs[remaining].append((first + used, n - used))
            if not runs[remaining]:
                tree.set(remaining, False)
            rank = fill(length, rank, first, used, remaining, each)
    return np.array(sorted(plan), np.int64).reshape(-1, 4)


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "part int, nth long, ids array<int>"
)


def _pieces(tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], encoder(tokenizer_path).dtype)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                doc = doc_id.as_py()
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = np.ascontiguousarray(ids[start:start + capacity], "<u4")
                    row = (doc, piece, start, len(cut), zlib.crc32(cut), part,
                           int(seen[len(cut)]), cut.astype(np.int32) if keep_ids else None)
                    seen[len(cut)] += 1
                    held += len(cut)
                    for column, value in zip(out, row):
                        column.append(value)
                if held > 500_000:
                    yield _batch(out)
                    out, held = [[] for _ in range(8)], 0
            yield _batch(out)

    return run


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
             pa.list_(pa.int32()))
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Place of every piece: its document, ids (if kept), sequence and offset there."""
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    pieces = settle(narrow.mapInArrow(_pieces(tokenizer_path, capacity, end_id, keep_ids), PIECES))
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in
              counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = best_fit_plan(counts, capacity)
    based = running_base(counted, ["length"], "part", "n", "before").drop("n")
    ranked = pieces.join(based, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("nth")).alias("rank"), *(["ids"] if keep_ids else []),
    )
    # The plan has rows by capacity, whatever the corpus: it travels with the function.
    keys = plan[:, 0] << 48 | plan[:, 1]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in range(5)]
                + [pa.array(plan[row, 2] + rank - plan[row, 1]), pa.array(plan[row, 3])]
                + [batch.column(c) for c in range(6, batch.num_columns)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                + (["ids"] if keep_ids else []),
            )

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long")
    return ranked.mapInArrow(place, schema + (", ids array<int>" if keep_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), from pieces packed with ``keep_ids``."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]
        )).alias("ids")
    )
