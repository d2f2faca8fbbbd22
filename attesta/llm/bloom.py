"""Bloom filters built by aggregation on the executors; the driver receives their words only."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALSE_RATE = 0.01


@dataclass
class Filter:
    bits: int
    probes: int
    level: int
    words: np.ndarray

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            for k in range(self.probes):
                x = h1 + np.uint64(self.level * 64 + k + 1) * h2
                x ^= x >> np.uint64(29)
                yield x * np.uint64(0xBF58476D1CE4E5B9) % np.uint64(self.bits)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in self.positions(h1, h2):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def unsigned(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("h1").to_numpy().astype(np.uint64), batch.column("h2").to_numpy().astype(np.uint64)


def fill(keys: DataFrame, n: int, level: int) -> Filter:
    bits = max(64, math.ceil(n * -math.log(FALSE_RATE) / math.log(2) ** 2 / 64) * 64)
    made = Filter(bits, max(1, round(bits / n * math.log(2))), level, np.zeros(bits // 64, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)  # bounded by the caller's check
        for batch in batches:
            for p in made.positions(*unsigned(batch)):
                np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        used = np.flatnonzero(words)
        for at in range(0, len(used), 100_000):
            k = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(words[k].astype(np.int64))], names=["k", "word"])

    for row in keys.select("h1", "h2").mapInArrow(run, "k long, word long").groupBy("k").agg(F.bit_or("word").alias("word")).toLocalIterator():
        made.words[row.k] = row.word & 0xFFFFFFFFFFFFFFFF
    return made


def membership(ids: DataFrame, most_bytes: int = 32 << 20) -> Callable[[str], Column] | None:
    """A test of a column against ``ids`` (one column, distinct): never false for a member, seldom true for another.

    None where the filter would pass ``most_bytes``.
    """
    name = ids.columns[0]
    n = ids.count()
    if n * 10 / 8 > most_bytes:
        return None
    hashed = ids.select(F.xxhash64(name).alias("h1"), F.xxhash64(name, F.lit(1)).bitwiseOR(F.lit(1)).alias("h2"))
    held = fill(hashed, max(n, 1), 0)

    @F.pandas_udf("boolean")
    def inside(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(held.passes(h1.to_numpy().astype(np.uint64), h2.to_numpy().astype(np.uint64)))

    return lambda column: inside(F.xxhash64(column), F.xxhash64(column, F.lit(1)).bitwiseOR(F.lit(1)))


def having(df: DataFrame, column: str, ids: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids`` (one column, distinct), and a few others.

    While the filter for the ids is below ``most_bytes`` nothing is shuffled;
    beyond it a semi join does the same exactly.
    """
    inside = membership(ids, most_bytes)
    return df.join(ids.withColumnRenamed(ids.columns[0], column), column, "left_semi") if inside is None else df.where(inside(column))
