"""Embedding whitening: principal components by hierarchical SVD merging, then centred and scaled projections.

1. Entries become long integers, so counts and sums are exact at any size.
2. Every task summarises its vectors, a block at a time: their number, sums, and
   all singular values and right vectors of the block centred on its own mean.
   Two summaries merge by stacking ``diag(s) V`` of both and a mean-correction
   row, sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), and another SVD. All dimensions
   are kept, so nothing is lost but rounding; no Gram matrix is formed.
3. Summaries merge in a tree, ``FAN`` at a time, in tasks. The last one, bounded
   by the dimension, comes to the driver, and a map projects every vector.

Defined results. Null vectors, empty ones, and those with null, NaN or infinite
entries are dropped; so are those of another length than most have (the longer on
ties). Null ids and repeated rows count like any other. Components of no variance
(rank below the number asked for) aren't returned: they can't be scaled. One
row, or equal rows only: no rows. Empty table: no rows. Entries of 2^42 and more
in magnitude are an error: they would not be exact. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.llm.common import Scratch, give_back

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
BLOCK, FAN = 2048, 8
#: Variances below this share of the largest are rounding.
NOTHING = 1e-20
SUMMARY = "part long, n long, sums array<long>, singular array<double>, vectors array<double>"

Summary = tuple[int, list[int], np.ndarray, np.ndarray]  # n, sums, singular values, right vectors (a row each)


def quantized(flat: np.ndarray, dimension: int) -> np.ndarray:
    """Rows of long integers: floor(SCALE * c) + SHIFT."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    if x.size and np.abs(x).max() >= 2.0**52:
        raise ValueError("entries of 2^42 and more can't be held exactly")
    return (x.astype(np.int64) + SHIFT).reshape(-1, dimension)


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def summarize(x: np.ndarray) -> Summary:
    n, sums = len(x), x.sum(0)
    return n, sums.tolist(), *_svd((n * x - sums) / n)


def merge(a: Summary, b: Summary) -> Summary:
    n = a[0] + b[0]
    gap = np.array([(p * b[0] - q * a[0]) / (a[0] * b[0]) for p, q in zip(a[1], b[1], strict=True)])  # of exact integers
    stacked = np.vstack([a[2][:, None] * a[3], b[2][:, None] * b[3], gap * (a[0] * b[0] / n) ** 0.5])
    return n, [p + q for p, q in zip(a[1], b[1], strict=True)], *_svd(stacked)


def summaries(vectors: DataFrame, dimension: int) -> DataFrame:
    """SUMMARY, a row per task that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: Summary | None = None
        for batch in batches:
            column = batch.column(0)
            for at in range(0, batch.num_rows, BLOCK):
                own = summarize(quantized(column.slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False), dimension))
                done = own if done is None else merge(done, own)
        if done is not None:
            columns = [[TaskContext.get().partitionId()], [done[0]], [done[1]], [done[2].tolist()], [done[3].ravel().tolist()]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "n", "sums", "singular", "vectors"])
        give_back()

    return vectors.mapInArrow(run, SUMMARY)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    done = None
    for r in group.sort_values("part").itertuples():
        s = np.asarray(r.singular, float)
        own = int(r.n), [int(x) for x in r.sums], s, np.asarray(r.vectors, float).reshape(len(s), -1)
        done = own if done is None else merge(done, own)
    return pd.DataFrame({"part": [int(group.part.min()) // FAN], "n": [done[0]], "sums": [done[1]], "singular": [done[2].tolist()], "vectors": [done[3].ravel().tolist()]})


@dataclass
class Basis:
    """What the fit found: n vectors, their sums, eigenvalues (falling) and eigenvectors of the covariance, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, dimension: int, scratch: Scratch) -> Basis | None:
    """None where there are no vectors. ``vectors``: one column, arrays of ``dimension`` finite numbers."""
    found = scratch.keep(summaries(vectors, dimension), "summaries")
    last = found.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while last:
        found = found.groupBy(F.expr(f"part div {FAN}")).applyInPandas(_merged, SUMMARY)
        last //= FAN
    if found.count() > 1:  # one task only, whose number is 0, or one merged row
        raise RuntimeError("summaries are left unmerged")
    r = found.first()
    s = np.array(r.singular)
    values = s * s / r.n
    return Basis(r.n, list(r.sums), values, np.array(r.vectors).reshape(len(s), -1), float(values.sum()))


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """``rows`` whose vector can be used, and its length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    lengths = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimension = lengths.d if lengths else 0
    return good.where(F.size(vector) == dimension), dimension


def whiten(rows: DataFrame, vector: str, keep: list[str], components: int = COMPONENTS, scratch: Scratch | None = None) -> tuple[DataFrame, Basis | None]:
    """Columns ``keep`` of every usable row with __whitened (an entry a component), __deviation (decimal: the sum of (n x - S)^2, exact), __explained; and the basis."""
    scratch = scratch or Scratch(rows.sparkSession, "whitening")
    good, dimension = usable(rows, vector)
    basis = fit(good.select(F.col(vector).cast("array<double>")), dimension, scratch)
    schema = StructType([*rows.select(*keep).schema.fields, *StructType.fromDDL("__whitened array<double>, __deviation decimal(38,0), __explained array<double>").fields])
    if basis is None:
        return rows.sparkSession.createDataFrame([], schema), None
    real = int((basis.values[:components] > NOTHING * max(basis.values[0], 1)).sum()) if basis.values[0] > 0 else 0
    if not real:
        return rows.sparkSession.createDataFrame([], schema), basis
    n, sums = basis.n, np.array(basis.sums, np.int64)
    share = (basis.values[:real] / basis.trace).tolist()
    scaled = (basis.vectors[:real] / np.sqrt(basis.values[:real])[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantized(batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False), dimension)
            most = int(np.abs(x).max(initial=1))
            if n * most < 1 << 62:
                away = n * x - sums
            else:
                away = n * x.astype(object) - np.array(basis.sums, object)
            if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * dimension < 1 << 63:
                deviation = pa.array((away * away).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = away.astype(object)
                deviation = pa.array([int(v) for v in (exact * exact).sum(1)], pa.decimal128(38, 0))
            out = ((away / n).astype(np.float64) @ scaled).ravel()
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * real)
            shares = pa.array([share] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.ListArray.from_arrays(ends, pa.array(out)), deviation, shares], names=schema.names)

    return scratch.keep(good.select(*keep, F.col(vector).cast("array<double>")).mapInArrow(run, schema), "whitened"), basis


def identity_error(whitened: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of __whitened minus the identity; covariances are centred and merged by Spark's own aggregate."""
    first = whitened.select(F.size("__whitened").alias("k")).first()
    if first is None:
        return None
    at = [F.col("__whitened")[i] for i in range(first.k)]
    entries = [F.abs(F.covar_pop(at[i], at[j]) - F.lit(float(i == j))) for i in range(first.k) for j in range(i + 1)]
    return whitened.agg(F.greatest(*entries, F.lit(0.0)).alias("e")).first().e
