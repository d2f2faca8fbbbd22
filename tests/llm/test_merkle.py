import hashlib
import random

import pytest
from helpers import frame, prose
from pyspark.sql import functions as F

from attesta.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """(root, siblings of each leaf, lowest first), by hand."""
    sides = [[] for _ in leaves]
    level, at = list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for leaf, k in enumerate(at):
            if (k ^ 1) < len(level):
                sides[leaf].append(level[k ^ 1])
        level = [h("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], sides


def by_hand(rows):
    """rows: (doc_id, lang, text). (doc_id, leaf, subroot, root, siblings) of each, sorted."""
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in langs:
        own = sorted(((r[0], h(encoded(r))) for r in rows if r[1] == lang), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        root, sides = tree([leaf for _, leaf in own])
        subroots.append(root)
        found.append([(i, leaf, root, s) for (i, leaf), s in zip(own, sides, strict=True)])
    root, sides = tree(subroots)
    return sorted(((i, leaf, sub, root, s + sides[k]) for k, own in enumerate(found) for i, leaf, sub, s in own), key=repr)


def run(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, lang string, text string, __tree string, __index long")
    fields = [F.col("doc_id"), F.col("lang"), F.col("text")]
    out = merkle.manifest(df, fields, F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "text": F.col("text"), "lang": F.col("lang")})
    wrong = merkle.leaf_digest(F.col("doc_id"), F.col("lang"), F.concat(F.coalesce("text", F.lit("")), F.lit("!")))
    out = merkle.refolded(merkle.refolded(out, "__leaf", "good").withColumn("wrong", wrong), "wrong", "bad")
    return out.withColumn("proof", merkle.proof_digest()).collect()


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [64, 65, 1, 2], [63, 5, 4161]])
def test_equals_a_tree_built_by_hand(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "PER_TASK", max(2, sum(sizes) // 6))
    r = random.Random(len(sizes))
    rows = [(r.randrange(10**6), [None, "en", "é", "Z", "zz"][k], f"t{i}" if i % 5 else None) for k, n in enumerate(sizes) for i in range(n)]
    got = run(spark, rows)
    assert sorted(((x.doc_id, x["__leaf"], x["__subroot"], x["__root"], x["__siblings"] + x["__top_siblings"]) for x in got), key=repr) == by_hand(rows)
    assert all(x.good == x["__root"] and x.bad != x["__root"] and x.proof == h("".join(x["__siblings"] + x["__top_siblings"])) for x in got)


def test_nulls_ties_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PER_TASK", 3)
    long = prose(5, 200_000)
    rows = [(None, None, None)] * 9 + [(1, "en", "a"), (1, "en", "b"), (1, "en", "b"), (2, "en", ""), (2, "en", None), (3, "en", long), (None, "en", "x"), (4, "", "y"), (5, "-", "z"), (6, "=", "w")]
    got = run(spark, rows)
    assert sorted(((x.doc_id, x["__leaf"], x["__subroot"], x["__root"], x["__siblings"] + x["__top_siblings"]) for x in got), key=repr) == by_hand(rows)
    assert all(x.good == x["__root"] for x in got)
    assert len({x["__leaf"] for x in got if x.doc_id == 2}) == 2


def test_a_changed_sibling_or_place_fails(spark):
    rows = merkle.manifest(frame(spark, [f"t{i}" for i in range(10)]), [F.col("text")], F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id")})
    moved = merkle.refolded(rows.withColumn("__index", F.col("__index").bitwiseXOR(F.lit(1))), "__leaf", "moved")
    assert all(r.moved != r["__root"] for r in moved.collect())
    other = merkle.refolded(rows.withColumn("__siblings", F.transform("__siblings", lambda s: F.reverse(s))), "__leaf", "other")
    assert all(r.other != r["__root"] for r in other.collect())


def test_empty_table(spark):
    assert run(spark, []) == []
