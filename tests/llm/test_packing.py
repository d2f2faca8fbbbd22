import itertools
import random
import zlib

import public_tokenizers as P
import pytest
from helpers import frame, odd_texts
from tokenizers import Tokenizer

from attesta.llm import packing


def optimum(sizes, capacity):
    """The fewest bins, by trying every assignment."""
    for n in range(1, len(sizes) + 1):
        def fits(i, bins):
            if i == len(sizes):
                return True
            tried = set()
            for b in range(n):
                if bins[b] + sizes[i] <= capacity and bins[b] not in tried:
                    tried.add(bins[b])
                    bins[b] += sizes[i]
                    if fits(i + 1, bins):
                        return True
                    bins[b] -= sizes[i]
            return False
        if fits(0, [0] * n):
            return n
    return 0


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_reaches_the_optimum(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 30) for _ in range(11)), reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.bin_completion(counts, 30)
    used = {}
    for n, parts in plan:
        assert sum(s * k for s, k in parts) <= 30
        for s, k in parts:
            used[s] = used.get(s, 0) + n * k
    assert used == counts
    assert sum(n for n, _ in plan) == optimum(sizes, 30)


def test_undominated_fillings_only():
    found = packing.completions({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 6, 10, 10, 50)
    assert (4,) in found and (2,) not in found and (3,) not in found  # 4 fills exactly, so 3 alone is dominated
    assert all(sum(c) <= 4 for c in found)


def test_no_pieces_and_full_pieces():
    assert packing.bin_completion({}) == []
    assert packing.bin_completion({1024: 3}) == [(3, ((1024, 1),))]
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(5, 1024) == [(0, 5)]


def test_pack_matches_the_tokenizer_and_fills_gaplessly(spark):
    texts = odd_texts() + ["it's <|endoftext|> x  \n\n y　 z"]
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(frame(spark, texts, [None, *range(1, len(texts))]), path, capacity=64).collect()
    tokenizer = Tokenizer.from_file(path)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i if i else None], key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 1


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), P.path("byte_bpe_50k.json")).collect() == []
