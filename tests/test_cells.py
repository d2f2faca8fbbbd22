import math

import numpy as np
from pyspark.sql import functions as F

from attesta.functions.scalars import cosine
from attesta.operators import cells

DDL = "name string, v array<double>"


def clustered(n, seed=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((25, 12))
    return [(f"{i:04d}", (centres[i % 25] + 0.1 * r.standard_normal(12)).tolist()) for i in range(n)]


def scan(rows, vector, k):
    score = cosine("v", F.array(*[F.lit(float(x)) for x in vector]))
    return [(r.name, r.score) for r in rows.where("v IS NOT NULL").withColumn("score", score).orderBy(F.desc("score"), "name").limit(k).collect()]


def search(index, vector, k):
    return [(r.name, r.score) for r in cells.nearest(index, vector, k, ["name"]).collect()]


def test_cells_answer_as_a_scan_and_score_little_of_clusters(spark):
    data = clustered(1500)
    odd = [("null", None), ("zero", [0.0] * 12), ("short", [1.0, 2.0]), ("copy-1", data[0][1]), ("copy-2", data[0][1])]
    rows = spark.createDataFrame(data + odd, DDL).repartition(4)
    index = cells.build(rows, "v", cells=40)
    assert index.rows.count() == 1505 and index.sizes[cells.ODD][0] == 3
    for vector, k in ((data[0][1], 5), (data[7][1], 40), (np.random.default_rng(1).standard_normal(12).tolist(), 10)):
        assert search(index, vector, k) == scan(rows, vector, k)
    best = scan(rows, data[0][1], 5)[-1][1]
    assert cells.within(index, data[0][1], math.acos(best)).count() < 150  # a tenth of the rows


def test_cells_of_directions_without_clusters_answer_as_a_scan(spark):
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"{i:04d}", r.standard_normal(16).tolist()) for i in range(300)], DDL)
    index = cells.build(rows, "v")
    vector = r.standard_normal(16).tolist()
    assert search(index, vector, 7) == scan(rows, vector, 7)
    assert len(search(index, vector, 1000)) == 300  # more than there are


def test_cells_of_no_rows_and_of_rows_without_direction(spark):
    none = spark.createDataFrame([], DDL)
    assert search(cells.build(none, "v"), [1.0, 0.0], 3) == []
    odd = spark.createDataFrame([("a", None), ("b", [0.0, 0.0])], DDL)
    assert search(cells.build(odd, "v"), [1.0, 0.0], 3) == scan(odd, [1.0, 0.0], 3)
    same = spark.createDataFrame([(n, [1.0, 1.0]) for n in "edcba"], DDL)  # ties by name
    assert [n for n, _ in search(cells.build(same, "v"), [2.0, 2.0], 3)] == ["a", "b", "c"]
