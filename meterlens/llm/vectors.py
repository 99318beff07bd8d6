"""Exact top-k search by inner product with vector-approximation files.

Vectors become whole numbers and then cells: each component is kept as one of 256
equal steps between the least and largest value of its dimension. The approximation
file holds row numbers and cells, nothing else, and is all that is scanned:

1. The cell bounds of a row give the least and the most its score can be. The kth best
   of the least scores over all rows is a floor for a query's result.
2. Rows whose most reaches the floor are candidates: a narrow table (query, row, most).
3. Exact vectors are fetched by a join on the row for the candidates with the highest
   bounds; their exact scores raise the floor. Batches grow (``BATCHES`` times ``k``, then
   the rest), and end when no bound left reaches the kth exact score.

Of equal vectors only the ``k + 1`` least ids are in the file: with a query's own row barred,
no other can be in a result. Results are exact, ties included.

Queries are held in blocks of about ``QUERIES_AT_ONCE`` (a stated set). The driver holds
one block's vectors and a floor for each; scores of all rows are never written.

Defined cases: vectors that are null, empty, or hold null or non-finite components take
no part; vectors of another length than the query's are no candidates for it; repeated
rows are candidates each for itself (a row is only barred from its own query); null row
ids sort last among ties; an empty table gives an empty table; other columns are not
looked at. Scores beyond a long are clipped to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlens.llm.common import drop_settled, small_side
from meterlens.session import settle

SCALE = 256
CELLS = 256
QUERIES_AT_ONCE = 4096
# Components up to this size make exact sums in 64 bits for up to 2**11 dimensions.
EXACT_COMPONENT = 1 << 26
CHUNK = 1024
# Candidates of the first batches, in multiples of k; the last batch is the rest.
BATCHES = (4, 64)
# Numbers that a task holds at once while it computes exact scores.
HELD = 1 << 21
LONGEST = float(1 << 63)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null for vectors that take no part."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fits & (F.size(vector) > 0), F.transform(
        vector, lambda x: F.floor(x.cast("double") * scale).cast("long")
    ))


class Cells:
    """Cell limits of every dimension and the bounds they give."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low.astype(np.float64)
        self.step = np.maximum(1.0, np.ceil((high.astype(np.float64) - self.low + 1) / CELLS))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.low) // self.step, 0, CELLS - 1).astype(np.uint8)

    def least(self, cells: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The least score of each query (rows) with each approximated vector."""
        return -self.most(cells, -queries)

    def most(self, cells: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The most it can be, a little more for the rounding of doubles."""
        low = self.low + cells * self.step
        bound = np.maximum(queries, 0) @ (low + (self.step - 1)).T + np.minimum(queries, 0) @ low.T
        bound = np.clip(bound, -LONGEST, LONGEST)  # as scores are
        return bound + (1e-9 * np.abs(bound) + 1e-6)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products, row by row."""
    largest = max(int(np.abs(queries).max(initial=0)), int(np.abs(vectors).max(initial=0)))
    if largest < EXACT_COMPONENT and vectors.shape[1] <= 2048:
        return np.einsum("ij,ij->i", queries, vectors)
    exact = (queries.astype(object) * vectors.astype(object)).sum(axis=1)
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], np.int64)


def _approximate(cells: Cells):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = cells.of(_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([m.tobytes() for m in marks], pa.binary())],
                names=["row", "cells"],
            )

    return run


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and cells of the approximation file, some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            marks = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8)
            yield part.column("row").to_numpy(), marks.reshape(part.num_rows, -1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _floors(cells: Cells, rows: np.ndarray, queries: np.ndarray, k: int):
    """Per task and query: the k best of the least scores."""
    exact = queries.astype(np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k), -np.inf)
        for row, marks in _chunks(batches):
            least = cells.least(marks, exact)
            _bar(least, rows, row)
            best = np.partition(np.concatenate([best, least], axis=1), -k, axis=1)[:, -k:]
        query, place = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(best[query, place])], names=["query", "least"]
        )

    return run


def _bar(scores: np.ndarray, rows: np.ndarray, candidates: np.ndarray) -> None:
    """A row is no candidate for its own query."""
    order = np.argsort(rows)
    at = np.searchsorted(rows[order], candidates)
    at[at == len(rows)] = 0
    own = np.flatnonzero(rows[order][at] == candidates)
    scores[order[at[own]], own] = -np.inf


def _candidates(cells: Cells, rows: np.ndarray, queries: np.ndarray, floors: np.ndarray):
    """(query, row, most) of every row whose most reaches the query's floor."""
    exact = queries.astype(np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, marks in _chunks(batches):
            most = cells.most(marks, exact)
            _bar(most, rows, row)
            query, place = np.nonzero((most >= floors[:, None]) & np.isfinite(most))
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(row[place]), pa.array(most[query, place])],
                names=["query", "row", "most"],
            )

    return run


def _exact(queries: np.ndarray):
    """Exact scores of fetched vectors with the queries that ask for them."""
    held = max(1, HELD // max(1, queries.shape[1]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, asking = _matrix(batch.column("vector")), batch.column("asking")
            query = asking.flatten().to_numpy()
            at = np.repeat(np.arange(batch.num_rows), np.diff(asking.offsets.to_numpy()))
            for start in range(0, len(query), held):
                q, v = query[start:start + held], at[start:start + held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), batch.column("row").take(pa.array(v)),
                     batch.column("vec_id").take(pa.array(v)), pa.array(_scores(queries[q], vectors[v]))],
                    names=["query", "row", "vec_id", "score"],
                )

    return run


SCORED = "query int, row long, vec_id long, score long"


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(file: DataFrame, own: DataFrame, cells: Cells, rows: np.ndarray, asked: np.ndarray,
            k: int, tally: list | None) -> DataFrame:
    """The k best rows of each query of a block: (query, row, vec_id, score, rank), written."""
    spark = file.sparkSession
    least = file.mapInArrow(_floors(cells, rows, asked, k), "query int, least double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("least")))
    floors = np.full(len(rows), -np.inf)
    for query, value in least.withColumn("nth", nth).filter(F.col("nth") == k) \
            .select("query", "least").collect():  # one number per query of the block
        floors[query] = value
    candidates = settle(file.mapInArrow(
        _candidates(cells, rows, asked, floors), "query int, row long, most double"
    ))
    best, left = None, candidates
    for batch in (*BATCHES, None):
        chosen = left
        if batch:
            nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "row"))
            chosen = left.withColumn("nth", nth).filter(F.col("nth") <= batch * k)
        chosen = settle(chosen.select("query", "row", "most"))
        # A row is asked for by the queries of one block at most.
        needed = settle(chosen.groupBy("row").agg(F.collect_list("query").alias("asking")))
        if tally is not None:
            tally.append((needed.count(), chosen.count()))
        scored = own.select("row", "vec_id", "vector").join(small_side(needed), "row") \
            .select("row", "vec_id", "vector", "asking").mapInArrow(_exact(asked), SCORED)
        if best is not None:
            scored = scored.unionByName(best.select("query", "row", "vec_id", "score"))
        known, best = best, settle(_best(scored, k))
        ends = chosen.groupBy("query").agg(
            F.count("*").alias("n"), F.min(F.struct("most", (-F.col("row")).alias("back"))).alias("end"))
        kth = best.filter(F.col("rank") == k).select("query", "score")
        # Queries whose batch was full go on behind its end, up to the kth exact score.
        open_ = ends.filter(F.col("n") == (batch or 0) * k).join(kth, "query", "left").select(
            "query", "end.most", (-F.col("end.back")).alias("row"), "score").toArrow()
        for done in (chosen, needed, known):
            if done is not None:
                drop_settled(done)
        if not open_.num_rows:
            break
        behind = F.broadcast(spark.createDataFrame(open_.rename_columns(["query", "end", "last", "kth"])))
        left = candidates.join(behind, "query").filter(
            ((F.col("most") < F.col("end")) | ((F.col("most") == F.col("end")) & (F.col("row") > F.col("last"))))
            & (F.col("kth").isNull() | (F.col("most") >= F.col("kth").cast("double") - 0.5))
        ).select("query", "row", "most")
    drop_settled(candidates)
    return best


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
    at_once: int = QUERIES_AT_ONCE,
    tally: list | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where ``queries`` holds.

    ``tally`` gets (vectors fetched, exact scores) of every batch.
    """
    spark = vectors.sparkSession
    whole = settle(vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"),
        whole_numbers(F.col(vector_column), scale).alias("vector"),
    ).filter("vector is not null"))
    found, used = None, [whole]
    copies = F.row_number().over(Window.partitionBy("name").orderBy("place"))
    for (dims,) in whole.filter("asks").select(F.size("vector")).distinct().collect():
        own = whole.filter(F.size("vector") == dims)
        ends = {r[0]: (r[1], r[2]) for r in own.select(F.posexplode("vector").alias("d", "x"))
                .groupBy("d").agg(F.min("x"), F.max("x")).collect()}  # one row per dimension
        cells = Cells(*(np.array([ends[d][e] for d in range(dims)]) for e in (0, 1)))
        marked = settle(own.mapInArrow(_approximate(cells), "row long, cells binary"))
        named = own.select(
            "row", F.unhex(F.sha2(F.col("vector").cast("string"), 256)).alias("name"),
            F.struct(F.col("vec_id").isNull(), F.coalesce("vec_id", F.lit(0)), "row").alias("place"),
        )
        # Few names have an end, and the rank is cut to k + 1 before its shuffle.
        ends_at = settle(named.withColumn("nth", copies).filter(F.col("nth") == k + 1)
                         .select("name", F.col("place").alias("end")))
        spare = settle(named.join(small_side(ends_at), "name").filter("place > end").select("row"))
        file = marked.join(small_side(spare), "row", "left_anti")
        used += [marked, ends_at, spare]
        asking = own.filter("asks")
        blocks = -(-asking.count() // at_once)
        for block in range(blocks):
            # A stated set of queries in blocks: about ``at_once`` rows come to the driver.
            rows = asking.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block) \
                .select("row", "vec_id", "vector").toArrow()
            if not rows.num_rows:
                continue
            row = rows.column("row").to_numpy()
            asked = _matrix(rows.column("vector").combine_chunks())
            best = _search(file, own, cells, row, asked, k, tally)
            ids = pa.table({"query": pa.array(np.arange(len(row)), pa.int32()), "query_id": rows.column("vec_id")})
            near = best.join(F.broadcast(spark.createDataFrame(ids)), "query")
            found = near if found is None else found.unionByName(near)
    for done in used:
        drop_settled(done)
    if found is None:
        found = spark.createDataFrame([], f"{SCORED}, rank int, query_id long")
    return found.select("query_id", "rank", "vec_id", "score")
