import collections
import hashlib
import random

import numpy as np
import pytest
from helpers import frame, odd_texts, prose

from attesta.llm import suffix_array as S


@pytest.mark.parametrize("length", [1, 3, 8, 9, 20, 33, 64])
def test_refinement_finds_equal_strings(length):
    rng = np.random.default_rng(length)
    text = rng.integers(0, 2, 700).astype(np.uint8)
    text[500:600] = text[100:200]
    active = np.sort(rng.choice(700 - length + 1, 400, replace=False))
    seen = collections.Counter(bytes(text[i : i + length]) for i in active)
    assert S.refine(text, active, length).tolist() == [seen[bytes(text[i : i + length])] > 1 for i in active]


@pytest.mark.parametrize("k", [1, 2, 3, 7, 64, 100])
def test_gram_hashes_tell_substrings_apart(k):
    data = np.random.default_rng(k).integers(0, 3, 500).astype(np.uint8)
    h = S.gram_hashes(data, k)
    pairs = {(bytes(data[i : i + k]), int(h[i])) for i in range(len(h))}
    assert len(h) == 500 - k + 1 and len(pairs) == len({p for p, _ in pairs}) == len({x for _, x in pairs})


def test_runs_partition_the_windows_and_equal_windows_share_an_anchor():
    r = random.Random(4)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (0, 5, 39, 40, 200, 900)]
    texts.append(b"x" * 30 + texts[-1][100:400] + b"y" * 30)
    whole = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    of, anchor, first, after = S.anchors(np.frombuffer(whole, np.uint8), starts, ends, 40, 10)
    seen, by_window = [], {}
    for t, a, f, e in zip(of, anchor, first, after, strict=True):
        for w in range(f, e):
            seen.append((int(t), int(w)))
            assert by_window.setdefault(whole[w : w + 40], int(a)) == int(a)
    assert sorted(seen) == [(i, w) for i, (s, e) in enumerate(zip(starts, ends, strict=True)) for w in range(s, e - 39)]


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, hot", [(400, 4096), (40, 4096), (40, 3), (8, 5)])
def test_documents_equal_brute_force(spark, length, hot):
    passage = prose(77, 90)
    texts = odd_texts() + [prose(500 + i, 20 + i) + passage + prose(600 + i, 30) for i in range(12)] + [passage[i:] + "é" * 30 for i in range(5)] + ["ab" * 600, "ab" * 700, "é" * 500]
    rows = {r.doc_id: r for r in S.deduplicate(frame(spark, texts), ["doc_id"], length, hot=hot).collect()}
    got = [(rows[i]["__n_bytes"], rows[i]["__n_removed"], rows[i]["__n_spans"], rows[i]["__sha256"]) for i in range(len(texts))]
    assert got == brute(texts, length)
    assert all(hashlib.sha256(bytes(r["__kept"])).hexdigest() == r["__sha256"] for r in rows.values())


def test_null_ids_repeats_clashes_and_empty_table(spark):
    text = prose(1, 100)
    rows = S.deduplicate(frame(spark, [text, text, prose(2, 100)], [None, 5, 5]), ["doc_id", "anchor", "root"]).collect()
    assert sorted((r.doc_id or -1, r["__n_removed"] > 0, r.anchor, r.root) for r in rows) == [(-1, True, 1, "x"), (5, False, 1, "x"), (5, True, 1, "x")]
    assert S.deduplicate(frame(spark, []), ["doc_id"]).count() == 0
