"""Gapless numbers in a total order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.components import durable


def numbered(rows: DataFrame, order: list[str], out: str = "seq") -> DataFrame:
    """``rows`` with ``out``: 1, 2, 3, ... by ``order``; rows that are equal in it follow one another in any order.

    Rows are dealt by ranges of ``order`` and written with their place in the
    range, so every read sees the same ranges; ranges are counted, and only the
    counts, one a range, are added up in one task.
    """
    bits = 33  # those of a place in its partition
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = durable(dealt).withColumn("__range", F.shiftright("__at", bits))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.col("__at").bitwiseAND(F.lit((1 << bits) - 1))
    return placed.join(F.broadcast(base), "__range").withColumn(out, F.col("__base") + place + 1).drop("__range", "__at", "__base")
