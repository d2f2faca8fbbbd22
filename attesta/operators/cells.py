"""Cells of near vectors: an inverted file whose answers are those of a full scan.

Centres are fitted on a bounded sample; every row goes to its nearest centre and
keeps the angle to it. A search scores the nearest cells until it has k rows.
Their k-th score bounds the angle of any better row, and by the triangle
inequality a row can only be as near as the query's angle to the centre and the
row's own differ: cells and rows beyond that are never scored.

Vectors in clusters leave few cells to score. Where all directions are equally
likely in many dimensions nothing is ruled out, and a search scores every row,
as a scan does. Rows without a direction of the centres' dimension (null, zero,
not finite, of another length) lie in cell -1, which every search scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import cosine
from attesta.operators.components import durable

SAMPLE, CELLS, ROUNDS, ODD, SLACK = 20_000, 4096, 10, -1, 1e-6


def _directions(vectors: list, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows have a direction."""
    out = np.zeros((len(vectors), dimension))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dimension:
            out[i] = np.asarray(v, float)
    out[~np.isfinite(out).all(axis=1)] = 0
    largest = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(largest > 0, largest, 1)  # squares stay finite
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), norm[:, 0] > 0


def _place(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the angle to it; 4,096 rows at a time."""
    cell, near = np.zeros(len(units), np.int32), np.full(len(units), -1.0)
    for at in range(0, len(units), 4096):
        products = units[at : at + 4096] @ centres.T
        cell[at : at + 4096] = products.argmax(axis=1)
        near[at : at + 4096] = products.max(axis=1)
    return cell, np.arccos(np.clip(near, -1, 1))


def fit_centres(rows: DataFrame, column: str, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """``cells`` unit vectors at most (none without a direction), by k-means on the angles of up to ``sample`` vectors, chosen by hash."""
    own = rows.where(F.size(column) > 0).select(F.col(column).cast("array<double>").alias("v"))
    drawn = [r.v for r in own.orderBy(F.xxhash64("v")).limit(sample).collect()]
    if not drawn:
        return np.zeros((0, 0))
    lengths = pd.Series([len(v) for v in drawn]).value_counts()
    units, some = _directions(drawn, int(lengths.index[lengths == lengths.max()].min()))
    units = np.unique(units[some], axis=0)
    if len(units) <= cells:
        return units
    random = np.random.default_rng(11)
    centres = units[random.choice(len(units), cells, replace=False)]
    for _ in range(ROUNDS):
        cell, _ = _place(units, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


@dataclass
class Cells:
    #: The indexed rows with ``__cell`` and ``__angle``, sorted by cell within its files.
    rows: DataFrame
    column: str
    centres: np.ndarray
    #: cell -> rows, greatest angle; as many as there are centres.
    sizes: dict[int, tuple[int, float]]


def build(rows: DataFrame, column: str, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """The index of all ``rows``; by default as many cells as the root of the rows, at most ``CELLS``."""
    cells = cells or max(1, min(CELLS, math.isqrt(rows.count())))
    centres = fit_centres(rows, column, cells, sample)

    @F.pandas_udf("cell int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        units, some = _directions(list(vectors), centres.shape[1])
        if not len(centres):
            return pd.DataFrame({"cell": np.full(len(vectors), ODD, np.int32), "angle": np.zeros(len(vectors))})
        cell, angle = _place(units, centres)
        return pd.DataFrame({"cell": np.where(some, cell, ODD).astype(np.int32), "angle": np.where(some, angle, 0.0)})

    placed = rows.withColumn("__p", place(column)).select(*rows.columns, F.col("__p.cell").alias("__cell"), F.col("__p.angle").alias("__angle"))
    index = durable(placed.repartitionByRange("__cell", "__angle").sortWithinPartitions("__cell", "__angle"))  # scans skip row groups by cell and angle
    sizes = {r["__cell"]: (r.n, r.most) for r in index.groupBy("__cell").agg(F.count("*").alias("n"), F.max("__angle").alias("most")).collect()}  # a row a cell
    return Cells(index, column, centres, sizes)


def _scored(rows: DataFrame, index: Cells, vector: list[float]) -> DataFrame:
    target = F.array(*[F.lit(float(v)) for v in vector])
    return rows.where(F.col(index.column).isNotNull()).withColumn("score", cosine(index.column, target))


def within(index: Cells, vector: list[float], angle: float) -> DataFrame:
    """Indexed rows that can be at most ``angle`` from ``vector``: none that is nearer is left out."""
    units, some = _directions([vector], index.centres.shape[1] if len(index.centres) else len(vector))
    if not some[0] or not len(index.centres):
        return index.rows
    away = np.arccos(np.clip(index.centres @ units[0], -1, 1))
    reach = [(c, float(away[c])) for c, (_, most) in index.sizes.items() if c != ODD and away[c] - most <= angle + SLACK]
    odd = F.col("__cell") == ODD
    met = index.rows.sparkSession.createDataFrame(reach, "__cell int, __away double")  # at most a row a cell
    rows = index.rows.where(F.col("__cell").isin([ODD, *[c for c, _ in reach]])).join(F.broadcast(met), "__cell", "left")
    return rows.where(odd | (F.abs(F.col("__away") - F.col("__angle")) <= angle + SLACK)).select(*index.rows.columns)


def nearest(index: Cells, vector: list[float], k: int, order: list[str]) -> DataFrame:
    """The ``k`` rows with the highest cosine, ties by ``order``, with ``score``: those of a scan over all rows."""
    units, some = _directions([vector], index.centres.shape[1] if len(index.centres) else len(vector))
    reach = math.pi
    if some[0] and len(index.centres):
        away = np.arccos(np.clip(index.centres @ units[0], -1, 1))
        first, held = [], 0
        for c in sorted((c for c in index.sizes if c != ODD), key=lambda c: away[c]):
            if held >= k:
                break
            first.append(c)
            held += index.sizes[c][0]
        if held >= k:
            best = _scored(index.rows.where(F.col("__cell").isin(first)), index, vector).select("score").orderBy(F.desc("score")).limit(k).collect()
            reach = math.acos(max(-1.0, min(1.0, best[-1].score)))
    return _scored(within(index, vector, reach), index, vector).orderBy(F.desc("score"), *order).limit(k).drop("__cell", "__angle")
