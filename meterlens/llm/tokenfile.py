"""Token ids in compressed binary blocks: static range asymmetric numeral systems.

One frequency table, counted over the whole corpus, is shared by all blocks. A block
holds the ids of whole documents, in order, dealt over interleaved lanes that each
keep a 64-bit coder state and share one stream of 32-bit words. Lane states are stored
every ``CHECKPOINT`` steps with the place in the stream, so parts of a block can be
decoded alone and in parallel; a CRC-32 guards each block and one each part.

Layout of a block, little-endian: ``MRNS``, then uint32 lanes, ids, parts, words, CRC of
all that follows; for each part uint32 first word, uint32 CRC of its ids, uint64 lane
states; then the words. The blocks are rows of a Parquet table, sorted by document, so
Spark's commit protocol covers them; the frequency table lies beside them.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with
equal ids stay rows of their own, in the order of their token bytes; an empty table
gives empty files; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import drop_settled, part_bases, parts_for
from meterlens.llm.tokens import encoder
from meterlens.session import settle, shared_folder

BITS = 18
LOW = 1 << 31
LANES = 1024
CHECKPOINT = 256
BLOCK_IDS = 1 << 20
END_ID = 1
MAGIC = b"MRNS"


class Model:
    """Frequencies scaled to a sum of 2**bits; every id that occurs keeps at least 1."""

    def __init__(self, symbols: np.ndarray, scaled: np.ndarray, bits: int):
        self.bits = bits
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[symbols] = scaled
        self.cum = np.zeros(size, np.uint64)
        self.cum[1:] = np.cumsum(self.freq)[:-1]
        self.slots = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))


def scale_counts(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whole frequencies in proportion to ``counts`` (all positive) that sum to 2**bits."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError("more symbols than the frequency table can tell apart")
    scaled = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    excess = int(scaled.sum()) - total
    order = np.argsort(-scaled, kind="stable")
    while excess:
        for k in order:
            if not excess:
                break
            step = min(excess, max(1, int(scaled[k]) // 64)) if excess > 0 else excess
            step = min(step, int(scaled[k]) - 1)
            scaled[k] -= step
            excess -= step
    return scaled


def encode_block(ids: np.ndarray, model: Model) -> bytes:
    """One self-contained block."""
    n = len(ids)
    lanes = max(1, min(LANES, 1 << max(0, (n // 64).bit_length())))
    steps = -(-n // lanes)
    bits = np.uint64(model.bits)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    parts: list[tuple[int, np.ndarray]] = []
    written = 0
    freq, cum = model.freq[ids], model.cum[ids]
    for step in range(steps - 1, -1, -1):
        at, to = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[:to - at], freq[at:to]
        full = x >= f << np.uint64(63 - model.bits)
        out = x[full]
        words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
        written += len(out)
        x[full] = out >> np.uint64(32)
        quotient = x // f
        x[:] = (quotient << bits) + (x - quotient * f) + cum[at:to]
        if step % CHECKPOINT == 0:
            parts.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = bytearray()
    for k, (before, states) in enumerate(reversed(parts)):
        piece = ids[k * CHECKPOINT * lanes:(k + 1) * CHECKPOINT * lanes]
        body += struct.pack("<II", written - before, zlib.crc32(piece.astype("<u4")))
        body += states.astype("<u8").tobytes()
    body += stream.tobytes()
    head = struct.pack("<IIII", lanes, n, len(parts), len(stream))
    return MAGIC + head + struct.pack("<I", zlib.crc32(head + body)) + bytes(body)


def decode_block(block: bytes, model: Model, part: int | None = None) -> np.ndarray:
    """Ids of a block, or of one of its checkpointed parts."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    lanes, n, parts, n_words, crc = struct.unpack_from("<IIIII", block, 4)
    if zlib.crc32(block[24:], zlib.crc32(block[4:20])) != crc:
        raise ValueError("block checksum differs")
    size = 8 + 8 * lanes
    stream = np.frombuffer(block, "<u4", n_words, 24 + parts * size).astype(np.uint64)
    bits, mask = np.uint64(model.bits), np.uint64((1 << model.bits) - 1)
    out = []
    for k in range(parts) if part is None else [part]:
        read, expected = struct.unpack_from("<II", block, 24 + k * size)
        state = np.frombuffer(block, "<u8", lanes, 32 + k * size).copy()
        first, last = k * CHECKPOINT * lanes, min(n, (k + 1) * CHECKPOINT * lanes)
        ids = np.empty(last - first, np.uint32)
        for at in range(0, len(ids), lanes):
            x = state[:min(lanes, len(ids) - at)]
            slot = x & mask
            symbol = model.slots[slot]
            ids[at:at + len(x)] = symbol
            x[:] = model.freq[symbol] * (x >> bits) + slot - model.cum[symbol]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << np.uint64(32) | stream[read:read + len(low)]
            read += len(low)
        if zlib.crc32(ids.astype("<u4")) != expected:
            raise ValueError("part checksum differs")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = encoder(path).encode, zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], encoder(path).dtype)
        for batch in batches:
            packed, sizes = [], []
            for text in batch.column(1):
                ids = np.concatenate([encode(text.as_py()), end])
                sizes.append(len(ids))
                packed.append(squeeze(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "n", "packed"],
            )

    return run


def _unpack(packed: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and how often this partition has them; rows by vocabulary, not by input."""
    total, held, n_held = np.zeros(0, np.int64), [], 0

    def add() -> None:
        nonlocal total, held, n_held
        found = np.bincount(np.concatenate(held)) if held else np.zeros(0, np.int64)
        if len(found) > len(total):
            total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
        total[:len(found)] += found
        held, n_held = [], 0

    for batch in batches:
        for n, packed in zip(batch.column("n").to_pylist(), batch.column("packed")):
            held.append(_unpack(packed.as_py(), n))
            n_held += n
            if n_held >= BLOCK_IDS:
                add()
    add()
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"]
    )


BLOCKS = ("part int, block int, first_id long, n_ids long, "
          "doc_ids array<long>, sizes array<long>, data binary")


def _encode(symbols: np.ndarray, scaled: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = Model(symbols, scaled, BITS), TaskContext.get().partitionId()
        docs, sizes, held, n, first, block = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            data = encode_block(np.concatenate(held), model)
            values = ([part], [block], [first], [n], [docs], [sizes], [data])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)],
                names=["part", "block", "first_id", "n_ids", "doc_ids", "sizes", "data"],
            )

        for batch in batches:
            for doc, size, packed in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append(doc)
                sizes.append(size)
                held.append(_unpack(packed, size))
                n += size
                if n >= BLOCK_IDS:
                    yield row()
                    first, block = first + n, block + 1
                    docs, sizes, held, n = [], [], [], 0
        if docs:
            yield row()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
) -> None:
    """Write all texts as token blocks below ``path``, in ascending id order."""
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    spark = docs.sparkSession
    ids = settle(narrow.mapInArrow(
        _tokenise(tokenizer_path, end_id), "doc_id long, n long, packed binary"
    ))
    counts = (ids.select("n", "packed").mapInArrow(_count, "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect())  # the vocabulary
    symbols = np.array([r["id"] for r in counts], np.int64)
    scaled = scale_counts(np.array([r["n"] for r in counts], np.float64)) if counts else symbols
    spark.createDataFrame(
        [(int(s), int(f)) for s, f in zip(symbols, scaled)], "id long, freq long"
    ).coalesce(1).write.parquet(f"{path}/model")
    (ids.repartitionByRange(parts_for(ids), "doc_id", F.xxhash64("packed"))
     .sortWithinPartitions("doc_id", "packed")
     .mapInArrow(_encode(symbols, scaled), BLOCKS)
     .write.parquet(f"{path}/blocks"))
    drop_settled(ids)


def _load_model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/model").orderBy("id").collect()  # the vocabulary
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded block by block."""
    blocks = spark.read.parquet(f"{path}/blocks")
    bases = part_bases(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n")
    symbols, scaled = _load_model(spark, path)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(symbols, scaled, BITS)
        for batch in batches:
            for part, first, docs, sizes, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = decode_block(data, model).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                kept = [ids[a:b].astype(np.int32) for a, b in zip(starts, ends)] if keep_ids else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + bases[part] + first),
                     pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                    + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []),
                    names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids,
                )

    return blocks.select("part", "first_id", "doc_ids", "sizes", "data").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long"
        + ", ids array<int>" * keep_ids
    )


def token_folder(spark: SparkSession) -> str:
    """A new folder for a token file in the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/meterlens-tokens-{uuid.uuid4().hex}"
