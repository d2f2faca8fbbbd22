"""Structural contracts of candidate triples and states: every failing rule, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.canonical import is_label


def _filled(name: str) -> Column:
    return F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.lit(f"{name} must be a non-empty string"))


def _label(name: str) -> Column:
    return F.when(~F.coalesce(is_label(F.col(name)), F.lit(False)), F.lit(f"{name} must be lowercase snake_case"))


def _bounded(name: str) -> Column:
    ok = F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")) & F.col(name).between(0, 1)
    return F.when(~ok, F.lit(f"{name} must be a number in [0, 1]"))


def _with_failures(df: DataFrame, rules: list[Column]) -> DataFrame:
    return df.withColumn("failures", F.array_compact(F.array(*rules)))


def check_triples(df: DataFrame) -> DataFrame:
    """Adds ``failures`` in rule order; a valid candidate has none. ``domain`` may be absent (null)."""
    rules = [_filled(c) for c in ("subject", "object", "evidence", "scope_conditions", "source_ref")]
    rules += [_label(c) for c in ("subject_type", "relation", "object_type")] + [_bounded("confidence")]
    if "domain" in df.columns:
        rules.append(F.when(F.col("domain").isNotNull() & ~is_label(F.col("domain")), F.lit("domain must be lowercase snake_case when present")))
    return _with_failures(df, rules)


def check_states(df: DataFrame) -> DataFrame:
    """Adds ``failures``; scope and unit may be empty but not null; ``value`` is trimmed."""
    present = [F.when(F.col(c).isNull(), F.lit(f"{c} must be a string")) for c in ("scope_conditions", "unit")]
    rules = [_filled(c) for c in ("entity", "evidence", "source_ref", "as_of", "value")] + present + [_label(c) for c in ("entity_type", "state_key")] + [_bounded("confidence")]
    return _with_failures(df, rules).withColumn("value", F.trim("value"))


def grounded(candidates: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Adds to ``failures`` where a candidate's reference isn't that of its chunk."""
    refs = chunks.select(F.col("chunk_id").alias("__chunk"), F.col("source_ref").alias("__ref"))
    joined = candidates.join(refs, F.col(chunk_id) == F.col("__chunk"), "left")
    wrong = F.when(~F.coalesce(F.col("source_ref") == F.col("__ref"), F.lit(False)), F.array(F.lit("source_ref must be that of the chunk"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("failures", F.concat("failures", wrong)).drop("__chunk", "__ref")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected records with the candidate as JSON)."""
    ok = F.size("failures") == 0
    valid = checked.where(ok).drop("failures")
    body = [c for c in checked.columns if c != "failures"]
    rejected = checked.where(~ok).select(
        F.to_json(F.struct(*body)).alias("candidate"), "source_ref", "evidence", "scope_conditions", F.lit("rejected").alias("decision"), F.array_join("failures", "; ").alias("reason"),
        F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("guard_class"), F.lit("contract").alias("step"),
    )
    return valid, rejected
