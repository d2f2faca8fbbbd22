import heapq
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import frame, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attesta.llm import huffman
from attesta.llm.common import Scratch


def plain_huffman_cost(counts):
    heap = [c for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40))
def test_unlimited_lengths_are_optimal_and_limited_ones_decodable(counts):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, 40)
    assert (lengths * counts).sum() == plain_huffman_cost(counts.tolist()) or (counts > 0).sum() == 0
    short = huffman.code_lengths(counts, 6)
    assert short.max(initial=0) <= 6 and sum(2.0 ** -int(x) for x in short if x) <= 1
    assert ((short > 0) == (counts > 0)).all()


def test_limit_that_cannot_hold_all_ids():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(0, 30), max_size=300), max_size=12))
def test_block_round_trip(texts):
    ids = [np.array(t, np.uint16) for t in texts]
    counts = np.bincount(np.concatenate([*ids, np.array([0, 1], np.uint16)]), minlength=31)
    lengths = huffman.code_lengths(counts, 9)
    codes = huffman.canonical_codes(lengths)
    made = huffman.encode_texts(ids, lengths, codes)
    rows = [(None if i % 3 == 2 else i, len(x), o, p) for i, (x, (o, p)) in enumerate(zip(ids, made, strict=True))]
    content = huffman.join_block(rows) + b"\n" + huffman.join_block(rows) + b"\n"
    blocks = list(huffman.decode_blocks(content, huffman.decode_table(lengths)))
    assert len(blocks) == 2
    for doc_ids, each, flat in blocks:
        assert doc_ids == [r[0] for r in rows] and each.tolist() == [len(x) for x in ids]
        assert flat.tolist() == [v for x in texts for v in x]


def test_damage_is_noticed():
    content = bytearray(huffman.join_block([(1, 0, b"", b"")]) + b"\n")
    content[20] ^= 1
    with pytest.raises(ValueError):
        list(huffman.decode_blocks(bytes(content), huffman.decode_table(np.array([1, 1], np.uint8))))


def test_files_round_trip_in_doc_id_order(spark):
    path, texts = P.path("word_bpe_49k.json"), odd_texts()
    ids = [None, 30, 20, *range(100, 100 + len(texts) - 4), 30]
    scratch = Scratch(spark, "test-ids")
    huffman.write_ids(frame(spark, texts, ids), scratch.path("ids"), path)
    tokenizer = Tokenizer.from_file(path)
    found = huffman.read_ids(spark, scratch.path("ids")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 20, 30, 30, *range(100, 100 + len(texts) - 4)]
    at = 0
    wanted = sorted((x, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for x, t in zip([-1 if i is None else i for i in ids], texts, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in found) == wanted
    for r in found:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
        at += r.n_tokens


def test_empty_table(spark):
    scratch = Scratch(spark, "test-empty-ids")
    huffman.write_ids(frame(spark, []), scratch.path("ids"), P.path("word_bpe_49k.json"))
    assert huffman.read_digests(spark, scratch.path("ids")).collect() == []
