import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import whitening


def table(spark, vectors, parts=1, ids=None):
    rows = [(i, v, "x") for i, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, __whitened string").repartition(parts)


def random_vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ np.diag(np.linspace(2, 0.1, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0]).tolist()


def check(rows, basis, vectors, components=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert basis.n == n and basis.sums == sums.tolist()
    k = min(components, x.shape[1])
    assert np.allclose(basis.values[:k], values[:k], rtol=1e-9) and np.isclose(basis.trace, values.sum(), rtol=1e-9)
    got = {r.vec_id: r for r in rows}
    mine = np.array([got[i]["__whitened"] for i in range(n)])
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((mine * want).sum(0))
    assert np.allclose(mine, want * signs, atol=1e-6)
    for i in range(n):
        assert int(got[i]["__deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], sums, strict=True))
        assert np.allclose(got[i]["__explained"], values[:k] / values.sum(), rtol=1e-9)


@pytest.mark.parametrize("n,d,parts", [(300, 12, 1), (500, 20, 19), (40, 3, 4), (3000, 64, 70)])
def test_equals_an_eigendecomposition(spark, n, d, parts, monkeypatch):
    vectors = random_vectors(n, d)
    rows, basis = whitening.whiten(table(spark, vectors, parts), "embedding", ["vec_id"])
    check(rows.collect(), basis, vectors)
    assert whitening.identity_error(rows) < 1e-8


def test_merging_loses_nothing():
    x = whitening.quantized(np.array(random_vectors(700, 16)).ravel(), 16)
    whole = whitening.summarize(x)
    done = whitening.summarize(x[:5])  # fewer rows than dimensions
    for at in (5, 6, 40, 300):
        done = whitening.merge(done, whitening.summarize(x[at : {5: 6, 6: 40, 40: 300, 300: 700}[at]]))
    assert done[0] == 700 and done[1] == x.sum(0).tolist()
    assert np.allclose(done[2], whole[2], rtol=1e-10)
    assert np.allclose(np.abs((done[3] * whole[3]).sum(1)), 1, atol=1e-8)


def test_unusable_vectors_null_ids_and_repeated_rows(spark):
    vectors = random_vectors(30, 4)
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows, basis = whitening.whiten(table(spark, vectors + vectors[:3] + odd, 3, [*range(30), None, 0, 0, *range(50, 56)]), "embedding", ["vec_id"])
    found = rows.collect()
    assert basis.n == 33 and len(found) == 33 and sorted(r.vec_id is None for r in found)[-1] and {r.vec_id for r in found} == {*range(30), None}
    assert len({tuple(r["__whitened"]) for r in found if r.vec_id in (0, None)}) == 3


def test_no_variance_one_row_and_empty_table(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]):
        rows, _ = whitening.whiten(table(spark, vectors), "embedding", ["vec_id"])
        assert rows.collect() == [] and whitening.identity_error(rows) is None
    rows, _ = whitening.whiten(table(spark, [[float(k), 1.0, 2.0] for k in range(6)]), "embedding", ["vec_id"])
    assert rows.select(F.size("__whitened").alias("k")).distinct().first().k == 1


def test_large_numbers_stay_exact(spark):
    vectors = [[2.0**30 + k, -(2.0**31) * k, 0.5] for k in range(9)]
    rows, basis = whitening.whiten(table(spark, vectors, 2), "embedding", ["vec_id"])
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert basis.sums == sums
    for r in rows.collect():
        assert int(r["__deviation"]) == sum((9 * a - b) ** 2 for a, b in zip(x[r.vec_id], sums, strict=True))
