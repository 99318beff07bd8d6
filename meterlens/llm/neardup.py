"""Near-duplicate documents by one-permutation MinHash.

1. Every text becomes its set of word shingles, as 64-bit hashes, and one permutation
   of them fills ``BINS`` bins; empty bins borrow from the first filled one of a fixed
   random order of their own (optimal densification). Equal sets are one class.
2. Classes that agree on all rows of a band share a bucket. A bucket proposes two stars:
   edges from its first and its last member to all others, in one random order of all
   classes, that of their names. So the pairs stay linear in the bucket, and a class meets
   the same few centres in most of its buckets: its edges repeat and fall together.
3. Edges whose signatures and sizes allow the threshold are confirmed on full sets, and
   confirmed edges are joined to components.
4. A star may miss a link between two outer members. Buckets of four or more classes in
   which components still meet (two stars cover all pairs of three) are gone through in
   blocks of ``BLOCK`` members: full sets of different components are compared, and one
   link for each two components that it joins is returned. So no link is lost but by
   chance: a pair just at 0.8 shares no bucket with a probability of 1e-7, and signatures
   reject it only if five standard deviations off.

Two different sets get one 64-bit class name with a probability of n**2 / 2**65.

Defined cases: a null or empty text (or one of white space) has no set and is a component
of its own; a null document id never is the name of a component if another id is there;
repeated rows are one class; an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.components import components
from meterlens.session import settle

SHINGLE = 5
PERCENT = 80
BIN_BITS = 8
BINS = 1 << BIN_BITS
BANDS, ROWS = 40, 5
BLOCK = 512
DEVIATIONS = 5.0

# Odd multipliers of the shingle hash, one per word of a shingle.
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
# For each bin the order in which it asks others when it is empty.
_ORDERS = np.argsort(np.random.default_rng(21).random((BINS, BINS)), axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text.

    Words stand between ASCII white space, A to Z in lower case; fewer than ``size``
    words are one shingle.
    """
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += hashes[k:len(words) - n + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash in each bin (by leading bits), empty bins densified."""
    bins = (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    source = np.full(BINS, -1)
    source[bins[first]] = first
    empty = np.flatnonzero(source < 0)
    filled = source >= 0
    for ask in (slice(0, 8), slice(8, BINS)):
        if not len(empty):
            break
        orders = _ORDERS[empty, ask]
        found = filled[orders]
        known = found.any(axis=1)
        source[empty[known]] = source[orders[known, found[known].argmax(axis=1)]]
        empty = empty[~known]
    return shingles[source]


def bands(values: np.ndarray) -> np.ndarray:
    """Bucket of each band; the last six bits are the band."""
    rows = values[:BANDS * ROWS].reshape(BANDS, ROWS)
    hashed = _mixed((rows * _MULTIPLIERS[:ROWS]).sum(axis=1, dtype=np.uint64))
    return (hashed & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)


def _signatures(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            n, nodes, buckets, marks = [], [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), size)
                n.append(len(shingles))
                if not len(shingles):
                    nodes.append(None), buckets.append(None), marks.append(None)
                    continue
                values = signature(shingles)
                nodes.append(xxh3_64_intdigest(shingles.tobytes()))
                buckets.append(bands(values).view(np.int64))
                marks.append(values.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()),
                 pa.array([None if v is None else v - (1 << 63) for v in nodes], pa.int64()),
                 pa.array(buckets, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "text_key", "n", "node", "buckets", "marks"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))],
                names=["node", "shingles"],
            )

    return run


def _least_estimate(smaller: np.ndarray, percent: int) -> np.ndarray:
    """Share of equal bins below which sets of such sizes cannot reach the threshold."""
    filled = np.maximum(1.0, BINS * -np.expm1(-smaller / BINS))
    share = percent / 100
    return share - DEVIATIONS * np.sqrt(share * (1 - share) / filled)


def _allowed(percent: int):
    """Keeps the pairs whose signatures allow the threshold."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS)
                for c in ("marks_a", "marks_b")
            )
            smaller = np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            keep = (left == right).mean(axis=1) >= _least_estimate(smaller, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sizes_allow(a, b, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _linked(percent: int):
    """Links between components within a block of a bucket, confirmed on full sets.

    Rows come sorted by (bucket, low, high). Of the links of a row to one component one is
    enough, and components that a link has joined are one from then on, so a block gives
    fewer links than it has rows. Rows that begin in the largest component are not visited:
    every other row is, so of two rows one is visited, unless both began in that one.
    """
    def links(rows: pa.Table) -> Iterator[tuple[int, int]]:
        node, comp, n, own = (rows.column(c).to_numpy() for c in ("node", "component", "n", "own"))
        across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        lists = rows.column("shingles").combine_chunks()
        values = lists.flatten().to_numpy()
        ends = np.cumsum(n)
        # Rows of each shingle: all shingles in order, with the row they come from.
        order = np.argsort(values, kind="stable")
        holder = np.repeat(np.arange(len(n)), n)[order]
        begins = np.searchsorted(values[order], values, "left")
        stops = np.searchsorted(values[order], values, "right")
        names, comp = np.unique(comp, return_inverse=True)
        visited = comp != np.bincount(comp, minlength=len(names)).argmax()
        for r in np.argsort(n, kind="stable"):
            if not visited[r]:
                continue
            small, large = np.minimum(n, n[r]), np.maximum(n, n[r])
            other = (comp != comp[r]) & (small * 100 >= large * percent)
            if across:
                other &= own != own[r]
            if not other.any():
                continue
            at = np.arange(ends[r] - n[r], ends[r])
            common = np.bincount(np.concatenate([
                holder[x:y] for x, y in zip(begins[at], stops[at])
            ]), minlength=len(n))
            for k in np.flatnonzero(other & (common * 100 >= (n + n[r] - common) * percent)):
                if comp[k] != comp[r]:
                    yield int(node[r]), int(node[k])
                    comp[comp == comp[k]] = comp[r]

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for arrived in batches:
            rows = pa.Table.from_batches([arrived])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "low", "high")])
            begin = 0
            for cut in np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1:
                yield batch(list(links(rows.slice(begin, cut - begin))))
                begin = cut
            held = rows.slice(begin)
        if held is not None and held.num_rows:
            yield batch(list(links(held)))

    return run


def _full_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the ``wanted`` classes (node), from the text of one document each."""
    texts = nodes.join(wanted, "node", "left_semi").select("node", "rep.doc_id", "rep.text_key")
    same = docs["doc_id"].eqNullSafe(texts["doc_id"]) & (docs["text_key"] == texts["text_key"])
    # Rows that repeat both id and text give one class several times.
    return settle(
        docs.join(texts, same).select("node", "text")
        .mapInArrow(_sets(size), "node long, shingles array<long>").dropDuplicates(["node"])
    )


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _full_sets(wanted, docs, nodes, size)
    common = F.size(F.array_intersect("left", "right"))
    return (
        pairs
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .filter(common * 100 >= (F.size("left") + F.size("right") - common) * percent)
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document row."""
    if not 0 < shingle <= len(_MULTIPLIERS):
        raise ValueError("shingle must be from 1 to 64 words")
    keyed = docs.select(
        F.col(id_column).alias("doc_id"), F.md5(F.col(text_column).cast("binary")).alias("text_key"),
        F.col(text_column).alias("text"),
    )
    kind = keyed.schema["doc_id"].dataType.simpleString()
    signed = settle(keyed.mapInArrow(
        _signatures(shingle),
        f"doc_id {kind}, text_key string, n long, node long, buckets array<long>, marks binary",
    ))
    nodes = settle(signed.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("rep"),
        F.first("n").alias("n"),
        F.first("buckets").alias("buckets"), F.first("marks").alias("marks"),
    ))
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = settle(
        members.groupBy("bucket").agg(
            F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size")
        ).filter("size > 1")
    )
    placed = settle(members.join(shared, "bucket"))
    star = placed.select("node", F.explode(F.array("first", "last")).alias("center")) \
        .filter("node != center") \
        .select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    light = nodes.select("node", "n", "marks")
    left, right = (light.toDF(k, f"n_{k}", f"marks_{k}") for k in "ab")
    candidates = settle(
        star.join(left, "a").join(right, "b")
        .filter(_sizes_allow(F.col("n_a"), F.col("n_b"), percent))
        .select("a", "b", "n_a", "n_b", "marks_a", "marks_b")
        .mapInArrow(_allowed(percent), "a long, b long")
    )
    first = components(_confirmed(candidates, keyed, nodes, shingle, percent))

    # Where components still meet in a bucket that two stars do not cover.
    rows = placed.filter("size > 3").select("bucket", "size", "node").join(first, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    open_ = rows.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    ).filter("least < most").select("bucket")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = settle(
        rows.join(open_, "bucket").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                "own", "node", "component")
    )
    sets = _full_sets(met.select("node").distinct(), keyed, nodes, shingle)
    links = settle(
        met.join(sets, "node").withColumn("n", F.size("shingles").cast("long"))
        .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(_linked(percent), "a long, b long").distinct()
    )
    named = first.select("node", "component")
    for end in "ab":  # from here on between components
        links = links.join(named.toDF(end, f"of_{end}"), end, "left") \
            .withColumn(end, F.coalesce(f"of_{end}", end)).select("a", "b")
    merged = components(links).toDF("component", "merged")
    placed_nodes = first.select("node", "component").unionByName(
        merged.select(F.col("component").alias("node"), "component").join(first, "node", "left_anti")
    )
    found = settle(
        placed_nodes.join(merged, "component", "left")
        .select("node", F.coalesce("merged", "component").alias("component"))
        .join(nodes.select("node", F.col("rep.doc_id").alias("rep")), "node")
    )
    named = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = nodes.select("node", F.col("rep.doc_id").alias("rep")).join(
        found.select("node", "component").join(named, "component").select("node", "component_id"),
        "node", "left",
    ).select("node", F.coalesce("component_id", "rep").alias("component_id"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return signed.select("doc_id", "n", "node").join(classes, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
