import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterlens.llm.sharding import jump_hash, shard_documents, write_shards
from tests.llm.conftest import EDGE


def jump(key, shards):
    """The published loop, for one key."""
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@given(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(1, 500))
def test_jump_hash(key, shards):
    assert jump_hash(np.array([key]), shards)[0] == jump(key, shards)


def test_one_more_shard_only_takes():
    keys = np.arange(20_000)
    before, after = jump_hash(keys, 40), jump_hash(keys, 41)
    moved = before != after
    assert (after[moved] == 40).all() and 0.015 < moved.mean() < 0.035
    sizes = np.bincount(before)
    assert sizes.min() > 400 and sizes.max() < 600


def test_shards_of_edge_cases(edge):
    got = shard_documents(edge, 3).collect()
    want = Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", jump(i or 0, 3), jump(i or 0, 4))
        for i, t in EDGE
    )
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_nothing_and_written_shards(spark, nothing, edge, tmp_path):
    assert shard_documents(nothing).collect() == []
    with pytest.raises(ValueError, match="shard"):
        write_shards(edge, str(tmp_path / "no"), 3)
    write_shards(edge.drop("shard").withColumn("_key", F.lit("own")), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r[0] for r in back.select("_key").distinct().collect()} == {"own"}
    assert Counter((r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()) == Counter(
        (i, jump(i or 0, 3)) for i, _ in EDGE)
