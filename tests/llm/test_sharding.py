import zlib

import numpy as np
from helpers import frame, odd_texts, prose

from attesta.llm import sharding


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_balance_groups_and_odd_rows(spark):
    texts = [prose(i, 20 + i % 90) for i in range(800)] + odd_texts() + ["same text"] * 40
    rows = sharding.assign(frame(spark, texts, [None, *range(1, len(texts))]), shards=4, fine=8, lots=16).collect()
    check(rows, texts, 4)
    load = np.bincount([r.shard for r in rows], [r.size for r in rows], 4)
    assert load.max() <= 1.05 * load.mean()
    for r in rows:
        text = (texts[r.doc_id or 0] or "").encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text)
    assert len({r.shard for r in rows if r.doc_id and texts[r.doc_id] == "same text"}) == 1


def test_a_group_of_a_third_of_all_rows_is_dealt_in_parts(spark):
    texts = [prose(i, 30) for i in range(400)] + [prose(1000, 30)] * 200
    rows = sharding.assign(frame(spark, texts), shards=8, fine=8, lots=16).collect()
    check(rows, texts, 8)
    load = np.bincount([r.shard for r in rows], [r.size for r in rows], 8)
    assert load.max() <= 1.15 * load.mean() and len({r.shard for r in rows if r.doc_id >= 400}) > 1


def test_placement_follows_the_residual_capacity():
    placed = sharding.place(np.array([[4, 4, 1], [4, 4, 1], [1, 1, 1], [1, 1, 1]], float), 2)
    assert placed[0] != placed[1] and placed[2] != placed[3]


def test_empty_table(spark):
    rows = sharding.assign(frame(spark, []))
    assert rows.count() == 0 and rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
