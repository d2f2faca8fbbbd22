import struct

import public_tokenizers as P
import pytest
from helpers import frame, odd_texts, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import harmonic

PATH = P.path("word_bpe_49k.json")


def packed(spark, texts, ids, parts, capacity):
    df = frame(spark, texts, ids).repartition(parts)
    return harmonic.pack(df, PATH, capacity).collect()


def check(rows, texts, ids, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((repr(i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in zip(ids, texts, strict=True))
    # Pieces of one document, put together again; rows that share an id come apart by their starts and sizes.
    by_doc = {}
    for r in rows:
        by_doc.setdefault((repr(r.doc_id), r.doc_tokens), []).append(r)
    for (i, n), own in by_doc.items():
        copies = [w for k, w in want if k == i and len(w) == n]
        assert copies and sum(r.length for r in own) == n * len(copies)
        for r in own:
            assert r.length == len(r.ids) // 4 and list(struct.unpack(f"<{r.length}I", r.ids)) in [w[r.start : r.start + r.length] for w in copies]
        assert sorted(r.start for r in own) == sorted(s for _ in copies for s, _ in harmonic.cuts(n, capacity))
    assert sum(r.length for r in rows) == sum(len(w) for _, w in want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and len({n for _, n in own}) == 1  # a class a bin
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("parts,capacity", [(1, 2048), (7, 64), (3, 8)])
def test_whole_documents_without_padding(spark, parts, capacity):
    texts = [*odd_texts(), "<|endoftext|> it's", prose(9, 30_000), *[prose(k, k % 90) for k in range(60)], *["same text"] * 20]
    ids = [None, None, *range(len(texts) - 2)]
    assert check(packed(spark, texts, ids, parts, capacity), texts, ids, capacity) == 0


@pytest.mark.parametrize("n", [1, 2, 5, 2047, 2048, 2049, 10_000])
def test_cuts(n):
    found = harmonic.cuts(n, 2048)
    assert [s for s, _ in found] == [sum(x for _, x in found[:k]) for k in range(len(found))] and sum(x for _, x in found) == n
    assert all(x & (x - 1) == 0 and x <= 2048 for _, x in found)


def test_leftovers_are_few_and_odd_capacities_are_refused(spark):
    df = frame(spark, [prose(k, 40) for k in range(200)]).repartition(4)
    pieces = harmonic.filled(df, PATH, 256, 1)
    per_task = pieces.where("sequence_id IS NULL").groupBy("task", "length").count().collect()
    assert all(r["count"] < 256 // r.length for r in per_task)
    with pytest.raises(ValueError):
        harmonic.pack(df, PATH, 1000)


def test_empty_table(spark):
    assert harmonic.pack(frame(spark, []), PATH).where(F.lit(True)).collect() == []
