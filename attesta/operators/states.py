"""State measurements: an append-only ledger per (entity, type, key, source) and the current value of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.canonical import with_canonical
from attesta.operators.ledger import dedupe
from attesta.schemas import STATE_IDENTITY

ENTITY = ("entity", "entity_type")
VALUE = ("value", "unit", "as_of", "confidence", "source_ref")


def current_state(states: DataFrame) -> DataFrame:
    """Per entity and key the row with the greatest (as_of as a string, confidence), the first on ties."""
    best = F.max_by(F.struct(*VALUE), F.struct("as_of", "confidence", -F.col("seq")))
    return states.groupBy(*ENTITY, "state_key").agg(best.alias("s")).select(*ENTITY, "state_key", "s.*")


def state_map(current: DataFrame) -> DataFrame:
    """One row per entity: a map from key to value, in key order."""
    entries = F.array_sort(F.collect_list(F.struct("state_key", F.struct(*VALUE).alias("v"))))
    return current.groupBy(*ENTITY).agg(F.map_from_entries(entries).alias("state"))


def state_json(maps: DataFrame) -> DataFrame:
    return maps.withColumn("state", F.to_json("state"))


def plan_states(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with ``action`` create or skip: an identity that is stored or came earlier is skipped."""
    stored = existing.select(*STATE_IDENTITY).distinct().withColumn("__stored", F.lit(True))
    first = dedupe(candidates, STATE_IDENTITY).select("seq").withColumn("__first", F.lit(True))
    joined = candidates.join(stored, list(STATE_IDENTITY), "left").join(first, "seq", "left")
    action = F.when(F.col("__stored").isNull() & F.col("__first").isNotNull(), "create").otherwise("skip")
    return joined.withColumn("action", action).drop("__stored", "__first")


def upsert_states(existing: DataFrame, candidates: DataFrame, registry: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, current maps of the touched entities): keys and types canonicalized first."""
    typed = with_canonical(with_canonical(candidates, registry, "state_key", "state_key"), registry, "entity_type", "entity_type")
    plan = plan_states(existing, typed)
    new = plan.where("action = 'create'").withColumns({"created_at": now, "updated_at": now})
    new = new.withColumns({c: F.lit(None).cast(existing.schema[c].dataType) for c in existing.columns if c not in new.columns})
    after = existing.unionByName(new.select(*existing.columns))
    touched = plan.select(*ENTITY).distinct()
    return after, state_map(current_state(after.join(touched, list(ENTITY), "left_semi")))


def with_unknown_key(states: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.where("kind = 'state_key'").select(F.col("label").alias("state_key")).withColumn("__known", F.lit(True))
    return states.join(known, "state_key", "left").withColumn("unknown_key", F.col("__known").isNull()).drop("__known")
