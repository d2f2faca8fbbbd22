"""Connected components by alternating large-star and small-star, and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, which driver and executors share, and read back; a local session that names none gets one until it ends.

    Tables stay there, as checkpoints do, until that folder is cleaned: results that read them may be read at any time.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="attesta-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    path = f"{sc._jsc.sc().getCheckpointDir().get().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and a sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """member, root (the smallest id reachable) for every id of ``links`` (a, b; longs)."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen, now = None, _digest(edges)
    while now != seen:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen, now = now, _digest(edges)
    return edges.select(F.col("u").alias("member"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("member"), F.col("v").alias("root")).distinct())
