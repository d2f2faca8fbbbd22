import random

import numpy as np
from helpers import frame, odd_texts, prose

from attesta.llm import spaced_seeds as S

ITEMS = "item_id long, text string, doc_id long"


def items(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 5) for i, t in zip(ids or range(len(texts)), texts, strict=True)], ITEMS)


def brute(docs, tests):
    """Every diagonal of every pair on which a mask fits, without hashes."""
    found = set()
    for i, d in enumerate(docs):
        dw = S.words_of(d)
        for j, t in enumerate(tests):
            tw = S.words_of(t)
            if len(tw) < 6:
                continue
            for shift in range(-len(tw) + 1, len(dw)):
                lo, hi = max(0, -shift), min(len(tw), len(dw) - shift)
                equal = [tw[x] == dw[x + shift] for x in range(lo, hi)]
                if not any(all(equal[x + p] for p, m in enumerate(mask) if m == "1") for mask in S.MASKS for x in range(len(equal) - len(mask) + 1)):
                    continue
                best = max(((sum(1 if e else -S.PENALTY for e in equal[a:b]), a, b) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)), default=(0, 0, 0), key=lambda x: (x[0], x[2] - x[1], -x[1]))
                _, a, b = best
                if b > a and b - a >= min(S.LEAST_WORDS, len(tw)) and sum(equal[a:b]) >= S.LEAST_SHARE * (b - a):
                    found.add((i, j))
    return found


def test_pairs_equal_brute_force_with_substitutions(spark):
    r = random.Random(1)
    tests = [prose(100 + i, 14 + i) for i in range(6)] + ["too short item", None, ""]
    docs = odd_texts()[:8]
    for i in range(24):
        words = (tests[i % 6]).split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "changed"
        docs.append(f"{prose(200 + i, 12)} {' '.join(words)} {prose(300 + i, 12)}".upper() if i % 5 == 0 else f"{prose(200 + i, 12)} {', '.join(words)} {prose(300 + i, 12)}")
    rows = S.contaminated(frame(spark, docs), items(spark, tests)).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == brute(docs, tests)
    assert len(rows) == len({(x.doc_id, x.item_id) for x in rows})
    one = next(x for x in rows if x.doc_id == 8)
    assert (one.doc_start, one.item_start, one.n_words, one.n_equal) == (12, 0, 14, 14)


def test_slices_of_the_test_set_change_nothing(spark):
    tests = [prose(i, 20) for i in range(9)]
    docs = frame(spark, [prose(50, 10) + " " + t for t in tests])
    whole, cut = (sorted(map(tuple, S.contaminated(docs, items(spark, tests), n).collect())) for n in (1 << 20, 200))
    assert whole == cut and len(whole) == 9


def test_null_ids_repeats_and_empty_tables(spark):
    text = prose(1, 30)
    rows = S.contaminated(frame(spark, [text, text, None], [None, 4, 4]), items(spark, [text, "x"], [None, 2])).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in rows) == [(-1, None), (4, None)]
    assert S.contaminated(frame(spark, []), items(spark, [text])).count() == 0
    assert S.contaminated(frame(spark, [text]), items(spark, [])).count() == 0


def test_best_stretch():
    import numpy as np

    assert S.best_stretch(np.array([1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1], bool)) == (0, 7)
    assert S.best_stretch(np.array([0, 0, 1], bool)) == (2, 3)


def test_any_stretch_of_a_diagonal_counts(spark):
    words = prose(7, 20).split()
    changed = [w if i not in (6, 8, 10, 12, 14) else "changed" for i, w in enumerate(words)]  # 15 of 20 agree, the best score ends after 6
    assert S.best_stretch(np.array([w != "changed" for w in changed])) == (0, 6)
    docs = frame(spark, [f"{prose(8, 12)} {' '.join(changed)} {prose(9, 12)}"])
    rows = S.contaminated(docs, items(spark, [" ".join(words)])).collect()
    assert [(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words, r.n_equal) for r in rows] == [(0, 0, 12, 0, 20, 15)]


def test_verified_stretches_equal_brute_force():
    r = random.Random(3)
    for _ in range(400):
        equal = np.array([r.random() < 0.7 for _ in range(r.randrange(1, 30))])
        least = min(S.LEAST_WORDS, len(equal))
        fit = [b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].sum() >= S.LEAST_SHARE * (b - a)]
        a, b = S.longest_stretch(equal)
        assert b - a == max(fit, default=0)
        found = S.verified(equal, least)
        assert (found is not None) == any(n >= least for n in fit)
        assert found is None or found[1] - found[0] >= least and equal[found[0] : found[1]].sum() >= S.LEAST_SHARE * (found[1] - found[0])
