"""Vectors of one group that are near by cosine: exact, in blocks of at most ``ROWS`` vectors.

Vectors are ordered by the signs of their products with fixed random directions,
so those of a cluster come together, and are cut into blocks with a centre and a
radius. Two blocks meet unless the angle between their centres less both radii
is beyond that of the threshold; then nothing in them can match. What meets is
multiplied as matrices, and a pair of blocks gives matches only, never its pairs.

Vectors in clusters meet their own cluster. Where all directions are equally
likely nothing rules a block out (64 dimensions and a cosine of 0.85 leave no
exact bound), and the work, not the rows, is then quadratic in a group's
different vectors. Null vectors and groups, entries that are null or not finite,
and zero vectors meet nothing; a shorter vector counts as padded with zeros.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.scalars import cosine
from attesta.operators.components import durable

ROWS, SIGNS, SLACK = 2048, 16, 1e-9


def _units(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; zeros for what meets nothing."""
    rows = [np.asarray(v, float) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    out[~np.isfinite(out).all(axis=1)] = 0
    largest = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(largest > 0, largest, 1)  # squares stay finite
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


@F.pandas_udf(T.IntegerType())
def _cell(vectors: pd.Series) -> pd.Series:
    units = _units(vectors)
    directions = np.random.default_rng(7).standard_normal((units.shape[1], SIGNS))
    return pd.Series((units @ directions > 0) @ (1 << np.arange(SIGNS)), dtype="int32")


def _pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    block = TaskContext.get().partitionId() << 32
    for part in parts:
        for _, own in part.groupby("g", sort=False):
            for at in np.array_split(np.arange(len(own)), math.ceil(len(own) / ROWS)):
                rows = own.iloc[at]
                units = _units(rows.v)
                some = units.any(axis=1)
                if not some.any():
                    continue
                rows, units = rows[some], units[some]
                centre = units.sum(axis=0)
                size = np.linalg.norm(centre)
                radius = math.acos(float(np.clip((units @ (centre / size)).min(), -1, 1))) if size > 0 else math.pi
                first = [centre] + [None] * (len(rows) - 1)
                yield pd.DataFrame({"g": rows.g.to_numpy(), "block": block, "id": rows.id.to_numpy(), "v": rows.v.to_numpy(), "centre": first, "radius": radius})
                block += 1


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, v) with the block of each; a block's first row has its centre."""
    rows = rows.where("g IS NOT NULL AND size(v) > 0").select("g", "id", "v", _cell("v").alias("cell"))
    dealt = rows.repartitionByRange("g", "cell", "id").sortWithinPartitions("g", "cell", "id")
    return durable(dealt.select("g", "id", "v").mapInPandas(_pack, "g string, block long, id long, v array<double>, centre array<double>, radius double"))


def _meetings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """i, j: blocks of one group that may hold a match."""
    a, b = (t.where("centre IS NOT NULL").select("g", F.col("block").alias(n), F.col("centre").alias(f"c{n}"), F.col("radius").alias(f"r{n}")) for t, n in ((left, "i"), (right, "j")))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine("ci", "cj"))))
    return a.join(b, "g").where(angle - F.col("ri") - F.col("rj") <= math.acos(threshold) + 1e-6).select("i", "j")


def _matrix(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> np.ndarray:
    x, y = _units(a.v), _units(b.v)
    n = min(x.shape[1], y.shape[1])
    return x[:, :n] @ y[:, :n].T >= threshold - SLACK


def _forest(hits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> pd.DataFrame:
    """One link for every member but the first of each component of rows and columns that hit one another."""
    left, free, found = hits.any(axis=1), np.ones(len(columns), bool), []
    while left.any():
        root = int(left.argmax())
        now = np.zeros(len(rows), bool)
        now[root] = True
        while now.any():
            left &= ~now
            new = hits[now].any(axis=0) & free
            free &= ~new
            found += [(rows[root], x) for x in (*rows[now], *columns[new])]
            now = hits[:, new].any(axis=1) & left
    out = pd.DataFrame(found, columns=["x", "y"], dtype="int64")
    return out[out.x != out.y]


def _meet(left: DataFrame, right: DataFrame, pairs: DataFrame, found) -> DataFrame:
    a = left.select("id", "v", F.col("block").alias("i")).join(pairs, "i").select("i", "j", "id", "v")
    b = right.select("id", "v", F.col("block").alias("j")).join(pairs, "j").select("i", "j", "id", "v")
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(found, "x long, y long")


def near_vectors(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """x, y: ids of both sides (g string, id long, v array<double>) with vectors of one group whose cosine is at least ``threshold``, above 0.

    Cosines that fall short by rounding (1e-9) are in, for the caller to judge.
    An id of ``left`` may have many vectors; it then comes once a pair of blocks.
    """

    def found(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        hits = _matrix(a, b, threshold)
        ids, code = np.unique(a.id.to_numpy(), return_inverse=True)
        if len(ids) < len(code):
            order = np.argsort(code, kind="stable")
            hits = np.logical_or.reduceat(hits[order], np.searchsorted(code[order], np.arange(len(ids))), axis=0)
        else:
            ids = a.id.to_numpy()
        i, j = np.nonzero(hits)
        return pd.DataFrame({"x": ids[i], "y": b.id.to_numpy()[j]})

    left, right = _blocks(left), _blocks(right)
    return _meet(left, right, _meetings(left, right, threshold), found)


def near_links(rows: DataFrame, threshold: float, some: DataFrame | None = None) -> DataFrame:
    """x, y: links with the same connected components as all pairs of ``near_vectors(rows, rows)``; two blocks give fewer links than they have rows.

    some: only pairs with one of these (some of ``rows``) count.
    """

    def found(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _forest(_matrix(a, b, threshold), a.id.to_numpy(), b.id.to_numpy())

    rows = _blocks(rows)
    if some is not None:
        some = _blocks(some)
        return _meet(some, rows, _meetings(some, rows, threshold), found)
    return _meet(rows, rows.toDF(*rows.columns), _meetings(rows, rows.toDF(*rows.columns), threshold).where("i <= j"), found)
