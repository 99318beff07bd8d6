import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlens.llm import packing, tokenfile
from meterlens.llm.tokens import encoder
from tests.llm.conftest import EDGE, PATH

ALPHABET = st.sampled_from(list("aBcsStTlLdmrevİΣσ  \n\t'’.,;<|>()%=–é\x1c\x85ß19²日̸̱́H😀_-")) | st.characters(
    exclude_categories=["Cs"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET | st.sampled_from(["<|endoftext|>", "'s ", " we'll"]), max_size=25))
def test_cached_encoding_is_the_library_s(parts):
    text = "".join(parts)
    fast = encoder(PATH)
    assert fast.encode(text).tolist() == fast.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_places_every_id_once(edge, tokenizer):
    got = packing.pack_documents(edge, PATH).collect()
    want = Counter()
    for doc, text in EDGE:
        ids = ids_of(tokenizer, text, packing.END_ID)
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            cut = ids[at:at + packing.CAPACITY]
            want[doc, piece, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_bin.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def plain_best_fit(lengths, capacity):
    """Bins of best-fit decreasing, a document at a time."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= length]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= length
        else:
            left.append(capacity - length)
    return len(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.just(40))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    plan = packing.best_fit_plan(Counter(lengths), capacity)
    used, seen = {}, Counter()
    for length in lengths:
        rows = plan[(plan[:, 0] == length) & (plan[:, 1] <= seen[length])]
        _, first, bin_, offset = max(rows.tolist(), key=lambda r: r[1])
        used.setdefault(bin_ + seen[length] - first, []).append((offset, length))
        seen[length] += 1
    for places in used.values():
        ends = np.cumsum([length for _, length in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(used) == plain_best_fit(lengths, capacity)


def test_sequences_hold_the_ids(edge, tokenizer):
    packed = packing.pack_documents(edge, PATH, keep_ids=True)
    total = sum(len(r.ids) for r in packing.sequences(packed).collect())
    assert total == sum(len(ids_of(tokenizer, t, 0)) for _, t in EDGE)


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, PATH).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 700_001])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).geometric(0.01, n) % 3000).astype(np.int64)
    counts = np.bincount(np.append(ids, [0, 49_000]))
    symbols = np.flatnonzero(counts)
    model = tokenfile.Model(symbols, tokenfile.scale_counts(counts[symbols].astype(float)), tokenfile.BITS)
    assert int(model.freq.sum()) == 1 << tokenfile.BITS
    block = tokenfile.encode_block(ids, model)
    assert (tokenfile.decode_block(block, model) == ids).all()
    if n > 600_000:  # a part alone
        step = tokenfile.CHECKPOINT * tokenfile.LANES
        assert (tokenfile.decode_block(block, model, 1) == ids[step:2 * step]).all()
        assert len(block) < 2 * n
    if n:
        broken = bytearray(block)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            tokenfile.decode_block(bytes(broken), model)


def test_token_file_round_trip(spark, edge, tokenizer):
    path = tokenfile.token_folder(spark)
    tokenfile.write_tokens(edge, path, PATH)
    got = tokenfile.read_tokens(spark, path, keep_ids=True).collect()
    got.sort(key=lambda r: r.start)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)  # ascending, null ids first
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    want = Counter((i, tuple(ids_of(tokenizer, t, 1).tolist())) for i, t in EDGE)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_token_file_of_nothing(spark, nothing):
    path = tokenfile.token_folder(spark)
    tokenfile.write_tokens(nothing, path, PATH)
    assert tokenfile.read_tokens(spark, path).collect() == []


def test_every_character_of_the_plain_blocks(tokenizer):
    """Alone, doubled and inside words, characters get the ids of the library."""
    from meterlens.llm.tokens import Encoder

    encode = Encoder(PATH).encode
    for c in map(chr, [*range(1, 0x250), *range(0x3F0, 0x480), 0x1E9E, 0xFB00, 0x301]):
        for text in (c, f"a{c}b", c * 2, f"Z{c}", f"{c}1.{c}"):
            assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_small_memories_change_nothing(tokenizer, monkeypatch):
    from meterlens.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    encoder = tokens.Encoder(PATH)
    text = "Größe café naïve Слово и 3 more-words, again. " * 5 + " ".join(f"wort{k}é" for k in range(200))
    assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.held <= 1000 and len(encoder) < 10
