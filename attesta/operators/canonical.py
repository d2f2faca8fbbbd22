"""Label canonicalization at the write boundary: registry lookups as joins, unknown labels pass and are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_canonical(df: DataFrame, registry: DataFrame, kind: str, column: str, out: str | None = None) -> DataFrame:
    """``out`` (default: in place): the canonical label, or the trimmed lower-case input; adds ``<out>_known``.

    The registry is small; Spark broadcasts it below its size threshold.
    """
    out = out or column
    names = registry.where(F.col("kind") == kind).select(F.col("label").alias("__label"), F.col("canonical").alias("__canonical"))
    key = F.lower(F.trim(F.col(column)))
    joined = df.withColumn("__key", key).join(names, F.col("__key") == F.col("__label"), "left")
    return joined.withColumn(f"{out}_known", F.col("__canonical").isNotNull()).withColumn(out, F.coalesce("__canonical", "__key")).drop("__key", "__label", "__canonical")


def canonicalize_triples(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical upper-case relation; the second member of a pair turns the endpoints round.

    Adds raw_relation (the input's label, if it has none yet), flipped, relation_known.
    """
    names = registry.where("kind = 'relation'").select(F.col("label").alias("__label"), F.col("canonical").alias("__canonical"), F.col("flip_to").alias("__flip"))
    joined = df.withColumn("__key", F.lower(F.trim("relation"))).join(names, F.col("__key") == F.col("__label"), "left")
    flipped = F.col("__flip").isNotNull()
    raw = F.coalesce(F.nullif(F.col("raw_relation"), F.lit("")), F.col("relation")) if "raw_relation" in df.columns else F.col("relation")
    return (
        joined.withColumn("raw_relation", raw)
        .withColumn("relation_known", F.col("__canonical").isNotNull())
        .withColumn("flipped", flipped)
        .withColumn("relation", F.upper(F.coalesce("__flip", "__canonical", "__key")))
        .withColumns({"subject": F.when(F.col("flipped"), F.col("object")).otherwise(F.col("subject")), "object": F.when(F.col("flipped"), F.col("subject")).otherwise(F.col("object"))})
        .drop("__key", "__label", "__canonical", "__flip")
    )


def unknown_counts(df: DataFrame, registry: DataFrame, columns: dict[str, str]) -> DataFrame:
    """kind, label, n: how often each unknown label occurs, for ``columns`` (column name: registry kind)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lower(F.trim(F.col(c))).alias("label")) for c, kind in columns.items()]))
    labels = df.select(pairs.alias("p")).select("p.kind", "p.label").where("coalesce(label, '') <> ''")
    return labels.join(registry.select("kind", "label"), ["kind", "label"], "left_anti").groupBy("kind", "label").agg(F.count("*").alias("n"))


def vocabulary(registry: DataFrame, kind: str) -> DataFrame:
    return registry.where((F.col("kind") == kind) & (F.col("label") == F.col("canonical"))).select("label", "is_staged", "flip_to", "description").orderBy("label")


def is_label(value: Column) -> Column:
    return value.rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$")
