"""Shared plumbing of the training-data operators: tables, scratch space, dealing and ranking.

Every operator selects the columns it needs under names of its own (``__``
prefixed where they meet a caller's columns), so extra columns with clashing
names never reach a join.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none (unit tests, the bench) gets a folder of its
    own, which goes when the program ends. On a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="attesta-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    return jsc.getCheckpointDir().get().rstrip("/")


def free_name(columns: list[str], base: str) -> str:
    """``base``, with underscores until no column has that name (case apart)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


class Scratch:
    """Written tables that cut lineage; they survive the loss of executors.

    ``keep(df, name)`` writes a table and reads it back, ``drop(name)`` removes
    it once nothing reads it any more. What a result reads stays in the
    checkpoint folder, as checkpoints do, until ``close()`` or until that folder
    is cleaned: results may be derived from, cached and read again at any time.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        """Remove all tables; results that read them can't be used after."""
        _delete(self.spark, self.base)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession, total_bytes: int, target: int = 32 << 20) -> int:
    """Partitions for ``total_bytes``: the session's number, or more on larger data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / target))


def dense_rank_in(df: DataFrame, keys: list[str], order: list[str], rows: int, out: str, per_task: int = 50_000) -> DataFrame:
    """A gapless number from 0 within each value of ``keys``, without one task per key.

    Each key is dealt into sub-groups by a hash of ``order``; sub-groups are
    numbered by a prefix sum over their counts (a table of keys x sub-groups)
    and rows within their sub-group. A key may hold any share of all rows.
    """
    parts = max(1, math.ceil(rows / per_task))
    dealt = df.withColumn("__sub", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = dealt.groupBy(*keys, "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*keys, "__sub").orderBy(*order)
    ranked = dealt.withColumn("__rn", F.row_number().over(inner))
    return (
        ranked.join(base, [*keys, "__sub"])
        .withColumn(out, (F.col("__base") + F.col("__rn") - 1).cast("long"))
        .drop("__sub", "__base", "__rn")
    )


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for their next task with all that the last one held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: A key is hot if it has more than this share of all rows; so fewer than 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 1000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys`` (distinct ``on``, and ``n``, how many rows each key has of ``total``), inner or left.

    The rows of hot keys are joined where they lie, with a table of fewer than
    ``1 / HOT_SHARE`` rows, whatever the data; the others are shuffled by key.
    ``keys`` is read twice, so it should be a written table.
    """
    most = max(1, total * HOT_SHARE)
    hot = keys.where(F.col(n) > most)  # fewer than 1 / HOT_SHARE keys can have so many rows
    if hot.isEmpty():
        return rows.join(keys, on, how)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col(n) <= most), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
