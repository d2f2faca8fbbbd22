"""Inspection of the graph: neighbours, ledger rows and states of an entity, provenance and verdict walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import normalize_name, name_tokens
from attesta.operators.ledger import provenance_columns, row_provenance
from attesta.schemas import IDENTITY, TRIPLE


def edges_for_entity(arrows: DataFrame, ledger: DataFrame, name: str) -> DataFrame:
    """Arrows that touch the entity, with the provenance of their rows: one scan of each table."""
    touches = (F.col("subject") == name) | (F.col("object") == name)
    own, rows = arrows.where(touches), ledger.where(touches)
    return own.join(row_provenance(rows), list(TRIPLE), "left").select(*provenance_columns(own)).orderBy(*TRIPLE)


def neighbours(arrows: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """relation, direction, name, type of the entities next to ``name``, without repeats."""
    out = arrows.where(F.col("subject") == name).select("relation", F.lit("out").alias("direction"), F.col("object").alias("name"))
    back = arrows.where(F.col("object") == name).select("relation", F.lit("in").alias("direction"), F.col("subject").alias("name"))
    return out.unionByName(back).distinct().join(entities.select("name", "type"), "name").select("relation", "direction", "name", "type").orderBy("relation", "direction", "name", "type")


def entity_states(states: DataFrame, name: str, type_: str) -> DataFrame:
    return states.where((F.col("entity") == name) & (F.col("entity_type") == type_)).select("state_key", "value", "unit", "as_of", "confidence", "source_ref").orderBy("state_key", "as_of", "source_ref")


def entity_events(ledger: DataFrame, states: DataFrame, name: str, type_: str | None = None) -> DataFrame:
    """role, relation, source_ref, evidence of the entity's rows: as subject, as object and as measured entity."""
    reported = ledger.where(F.col("subject") == name).select(F.lit("REPORTED").alias("role"), "relation", "source_ref", "evidence", "confidence")
    about = ledger.where(F.col("object") == name).select(F.lit("ABOUT").alias("role"), "relation", "source_ref", "evidence", "confidence")
    own = states.where(F.col("entity") == name) if type_ is None else states.where((F.col("entity") == name) & (F.col("entity_type") == type_))
    state = own.select(F.lit("HAS_STATE_EVENT").alias("role"), F.col("state_key").alias("relation"), "source_ref", "evidence", "confidence")
    return reported.unionByName(about).unionByName(state).distinct().orderBy("role", "relation", "source_ref", "evidence")


def provenance_for_source(ledger: DataFrame, source: str) -> DataFrame:
    return ledger.where(F.col("source_id") == source).select(*IDENTITY, "confidence", "evidence", "created_at", "seq").orderBy("created_at", "seq")


def verdicts_for_source(ledger: DataFrame, verdicts: DataFrame, source: str) -> DataFrame:
    rows = ledger.where(F.col("source_id") == source).select(*IDENTITY)
    return rows.join(verdicts, list(IDENTITY)).orderBy("created_at", "id")


def relation_types(arrows: DataFrame) -> DataFrame:
    """The domain relations in use, without the structural ones."""
    return arrows.select("relation").distinct().orderBy("relation")


def rows_for_domain(ledger: DataFrame, domain: str) -> DataFrame:
    return ledger.where(F.col("domain") == domain).orderBy("created_at", "seq")


def find_entities(entities: DataFrame, name: str, type_: str) -> DataFrame:
    """Entities of the type with that normalized name or alias."""
    wanted = normalize_name(F.lit(name))
    return entities.where((F.col("type") == type_) & ((normalize_name("name") == wanted) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: normalize_name(a) == wanted)))


def containment_candidates(entities: DataFrame, name: str, type_: str, limit: int = 100) -> DataFrame:
    """Entities of the type that share a normalized token, in name or alias, with ``name``; the first ``limit`` by name."""
    pooled = F.array_distinct(F.concat(name_tokens("name"), F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), name_tokens))))
    return entities.where((F.col("type") == type_) & F.arrays_overlap(pooled, name_tokens(F.lit(name)))).orderBy("name").limit(limit)


def structural_corroboration(arrows: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (neighbor, relation) those that are next to ``name``, in either direction."""
    out = arrows.where(F.col("subject") == name).select(F.col("object").alias("neighbor"), "relation")
    back = arrows.where(F.col("object") == name).select(F.col("subject").alias("neighbor"), "relation")
    return pairs.select("neighbor", "relation").distinct().join(out.unionByName(back), ["neighbor", "relation"], "left_semi")


def batches(chunks: DataFrame, size: int) -> DataFrame:
    """Adds ``batch``: runs of ``size`` chunks of a source in order."""
    w = Window.partitionBy("source_id").orderBy("ordinal")
    return chunks.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
