"""URL filters: host and path rules, and exact host lists in a cascade of Bloom filters.

Level 0 encodes the listed keys, level 1 the unlisted keys of the corpus that
pass level 0, level 2 the listed keys that pass level 1, and so on until none
is left. For every key of that universe the first level that a key fails tells
its membership exactly, without a join.

Filters are built by aggregation on the executors; the driver only receives
their words. Keys are cut by hash into as many slices as keep the filters of
one slice under ``MOST_BYTES``; slices are shipped one after another, each
decides its own keys, so what is broadcast at once is bounded for any list.

Defined results. Null url, or none with ``://``: host and path are empty, no
rule fits, and the empty host is not listed: allow. Null page_id and repeated
rows: judged like any other. Empty list or table: no filters, no rows. Extra
columns are ignored. More than ``MOST_LEVELS`` levels: an error, since only
keys with equal hashes can need so many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.bloom import FALSE_RATE, Filter, fill, unsigned
from attesta.llm.common import Scratch, shared_dir

# The rules (verdict, host and path), and the hosts that are blocked where no rule fits.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("cheap-pills", "casino-win", "spam-farm") for top in ("com", "net", "org"))
MOST_BYTES, MOST_LEVELS = 32 << 20, 64


def host_of(url: str = "url") -> Column:
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffixes(host: str) -> list[str]:
    """The host and its parent domains."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def _hash(key: str) -> tuple[int, int]:
    raw = key.encode()
    return xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2) | 1


@dataclass
class Cascade:
    """Slices of levels of filters."""

    slices: list[list[Filter]] = field(default_factory=list)

    @staticmethod
    def listed(levels: list[Filter], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The first failed level decides: an even one says no, an odd one yes; past the last, its own kind."""
        out = np.full(len(h1), len(levels) % 2 == 1)
        open_ = np.ones(len(h1), bool)
        for k, f in enumerate(levels):
            fails = open_ & ~f.passes(h1, h2)
            out[fails] = k % 2 == 1
            open_ &= ~fails
        return out

    def bytes(self) -> int:
        return sum(f.words.nbytes for s in self.slices for f in s)


def hashed(keys: DataFrame, slices: int) -> DataFrame:
    """key, h1, h2 (as signed longs), slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.array([_hash(k) for k in batch.column(0).to_pylist()], np.uint64).reshape(-1, 2)
            part = (pairs[:, 0] >> np.uint64(32)) % np.uint64(slices)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64)), pa.array(part.astype(np.int32))], names=["h1", "h2", "slice"])

    return keys.mapInArrow(run, "h1 long, h2 long, slice int")


def _passing(keys: DataFrame, level: Filter) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.passes(*unsigned(batch))))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def build(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade:
    """The cascade for column ``key`` of ``listed``, exact for every key of ``universe`` and ``listed``."""
    shared_dir(universe.sparkSession)
    listed = listed.select(F.col("key").cast("string")).where("key IS NOT NULL").distinct()
    others = universe.select(F.col("key").cast("string")).where("key IS NOT NULL").distinct().join(listed, "key", "left_anti")
    n = listed.count()
    if not n:
        return Cascade([[]])
    # All levels together take under three times level 0 as long as the universe is below 100 times the list; else by the universe.
    size = max(n * 10 / 8 * 3, others.count() * FALSE_RATE * 10 / 8 * 3)
    slices = max(1, math.ceil(size / most_bytes))
    listed, others = hashed(listed, slices).checkpoint(), hashed(others, slices).checkpoint()
    made = Cascade()
    for s in range(slices):
        inside, outside = listed.where(F.col("slice") == s), others.where(F.col("slice") == s)
        levels: list[Filter] = []
        left = inside.count()
        while left:
            if len(levels) == MOST_LEVELS:
                raise ValueError("listed and unlisted keys with equal hashes")
            levels.append(fill(inside, left, len(levels)))
            inside, outside = _passing(outside, levels[-1]), inside  # what passes is what the next level encodes
            left = inside.count()
        made.slices.append(levels)
    return made


def _inside(levels: list[Filter], s: int, slices: int):
    @F.pandas_udf("boolean")
    def inside(hosts: pd.Series) -> pd.Series:
        own = hosts.unique()
        keys = [suffixes(h) for h in own]
        flat = np.array([_hash(k) for x in keys for k in x], np.uint64).reshape(-1, 2)
        at = np.repeat(np.arange(len(own)), [len(x) for x in keys])
        mine = (flat[:, 0] >> np.uint64(32)) % np.uint64(slices) == s
        hit = np.zeros(len(own), bool)
        np.logical_or.at(hit, at[mine], Cascade.listed(levels, flat[mine, 0], flat[mine, 1]))
        return hosts.map(dict(zip(own, hit.tolist(), strict=True))).astype(bool)

    return inside


def with_listed(rows: DataFrame, cascade: Cascade, host: str, out: str) -> DataFrame:
    """Adds boolean ``out``: the host or a parent domain is listed. With several slices each is a pass of its own, written before the next."""
    rows = rows.withColumn(out, F.lit(False))
    several = len(cascade.slices) > 1
    scratch = Scratch(rows.sparkSession, "url-slices") if several else None
    for s, levels in enumerate(cascade.slices):
        if levels:
            rows = rows.withColumn(out, F.col(out) | _inside(levels, s, len(cascade.slices))(F.col(host)))
            if several:
                rows = scratch.keep(rows, f"slice-{s}")
    return rows


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row."""
    rows = pages.select(F.col("page_id").cast("long"), host_of().alias("host"), path_of().alias("path"))
    # The universe is every host of the corpus with its parent domains.
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    universe = rows.select("host").where("host <> ''").distinct().select(F.explode(parents).alias("key"))
    cascade = build(listed, universe)
    rows = with_listed(rows, cascade, "host", "listed").withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
