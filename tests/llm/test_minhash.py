import random

import pytest
from helpers import frame, odd_texts, prose

from attesta.llm import minhash
from attesta.llm.common import Scratch


def sets_of(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(texts, k, threshold):
    sets, root = sets_of(texts, k), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= threshold * len(sets[i] | sets[j]) and n:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def varied(seed, base, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"z{r.randrange(10**6)}" for w in base.split())


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    base = prose(1, 150)
    chain = [prose(5, 100)]
    for i in range(12):  # each is near the one before, the ends are far apart
        words = chain[-1].split()
        chain.append(" ".join(words[4:] + prose(50 + i, 4).split()))
    star = [varied(i, base, 0.012 + 0.002 * (i % 8)) for i in range(60)]  # around the threshold to each other
    texts = odd_texts() + chain + star + [base.upper(), base]
    random.Random(0).shuffle(texts)
    roots, sizes = brute(texts, k, 80)
    rows = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), k).collect()}
    assert [rows[i].component_id for i in range(len(texts))] == roots
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_null_ids_repeats_and_empty_table(spark):
    texts = [prose(1, 50), prose(1, 50), prose(1, 50), None, prose(2, 50)]
    rows = minhash.near_duplicates(frame(spark, texts, [None, 7, 7, 9, 3])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.near_duplicates(frame(spark, [None, ""])).count() == 2


def test_stars_reach_the_smallest_id_on_long_paths(spark):
    r = random.Random(2)
    ids = r.sample(range(10_000), 200)
    path = [(ids[i], ids[i + 1]) for i in range(120)] + [(ids[i], ids[i + 1]) for i in range(130, 199)]
    links = spark.createDataFrame(path, "a long, b long")
    rows = {x.member: x.root for x in minhash.components(links, Scratch(spark, "test-stars"), "t").collect()}
    assert {rows[i] for i in ids[:121]} == {min(ids[:121])} and {rows[i] for i in ids[130:]} == {min(ids[130:])} and len(rows) == 191
