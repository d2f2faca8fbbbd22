"""Maintenance passes. Each returns the next tables and a one-row report, and changes nothing when repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import differs, join_evidence, source_id
from attesta.operators.canonical import canonicalize_triples
from attesta.operators.ledger import complement
from attesta.operators.numbering import numbered
from attesta.operators.search import without_embedding
from attesta.schemas import IDENTITY, TRIPLE


def backfill_candidates(arrows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Arrows without a ledger row of the same relation; one without a confidence is an error."""
    rows = ledger.select(F.col("subject"), F.upper("relation").alias("relation"), F.col("object")).distinct()
    found = arrows.join(rows, list(TRIPLE), "left_anti")
    return found.withColumn("confidence", F.when(F.col("confidence").isNotNull(), F.col("confidence")).otherwise(F.raise_error(F.concat(F.lit("arrow without confidence: "), F.concat_ws(" ", *TRIPLE))).cast("double")))


def strip_candidates(arrows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Arrows that have rows and still carry evidence or a reference of their own."""
    legacy = arrows.where(F.col("evidence").isNotNull() | F.col("source_ref").isNotNull())
    return legacy.join(ledger.select(*TRIPLE).distinct(), list(TRIPLE), "left_semi")


def migrate_ledger(arrows: DataFrame, ledger: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, arrows, report): a row for every arrow without one, aggregates rewritten only where they differ, legacy values stripped."""
    new = backfill_candidates(arrows, ledger)
    top = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__top"))
    fields = {
        "evidence": join_evidence(F.coalesce("evidence", F.array().cast("array<string>"))), "raw_relation": F.col("relation"), "domain": F.lit(""),
        "source_ref": F.coalesce("source_ref", F.lit("")), "source_id": F.nullif(F.regexp_extract(F.coalesce("source_ref", F.lit("")), r"^([A-Za-z0-9][A-Za-z0-9._-]*):", 1), F.lit("")),
        "evidence_embedding": F.lit(None).cast("array<double>"), "created_at": now, "updated_at": now,
    }
    # Numbers follow the stored ones, in order of the triples.
    rows = numbered(new.withColumns(fields), list(TRIPLE)).crossJoin(F.broadcast(top)).withColumn("seq", F.col("__top") + F.col("seq"))
    after = ledger.unionByName(rows.select(*ledger.columns))
    agg = after.groupBy(*TRIPLE).agg(complement().alias("__confidence"))
    joined = arrows.join(agg, list(TRIPLE), "left")
    moved = F.col("__confidence").isNotNull() & differs("confidence", "__confidence")
    stripped = F.col("__confidence").isNotNull() & (F.col("evidence").isNotNull() | F.col("source_ref").isNotNull())
    next_arrows = joined.withColumns(
        {
            "confidence": F.when(moved, F.col("__confidence")).otherwise(F.col("confidence")),
            "updated_at": F.when(moved, now).otherwise(F.col("updated_at")),
            "evidence": F.when(F.col("__confidence").isNull(), F.col("evidence")),
            "source_ref": F.when(F.col("__confidence").isNull(), F.col("source_ref")),
        }
    ).select(*arrows.columns)
    report = joined.agg(F.count("*").alias("arrows"), F.count_if(moved).alias("confidences_changed"), F.count_if(stripped).alias("stripped")).crossJoin(rows.agg(F.count("*").alias("rows_created")))
    return after, next_arrows, report


#: The triple that a row is stored under, beside its canonical one.
STORED = ("__subject", "__relation", "__object")


def plan_normalization(ledger: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with their canonical triple and ``action``: keep, rewrite or collapse.

    A row that is canonical already keeps its identity; else the first
    rewritten row claims it, and the others collapse into it.
    """
    return plan_canonical(with_canonical(ledger, registry))


def with_canonical(ledger: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows under their canonical triple, with the stored one in STORED."""
    return canonicalize_triples(ledger.withColumns({old: F.col(c) for old, c in zip(STORED, TRIPLE, strict=True)}), registry)


def plan_canonical(canonical: DataFrame) -> DataFrame:
    """As ``plan_normalization``, of rows from ``with_canonical``."""
    same = (F.col("__subject") == F.col("subject")) & (F.col("__relation") == F.col("relation")) & (F.col("__object") == F.col("object"))
    rows = canonical.withColumn("__kept", same)
    w = Window.partitionBy(*IDENTITY).orderBy(F.desc("__kept"), "seq")
    rows = rows.withColumn("__rn", F.row_number().over(w))
    action = F.when(F.col("__rn") > 1, "collapse").when(F.col("__kept"), "keep").otherwise("rewrite")
    return rows.withColumn("action", action).withColumnsRenamed({"__subject": "old_subject", "__relation": "old_relation", "__object": "old_object"}).drop("__kept", "__rn")


def normalize_relations(ledger: DataFrame, arrows: DataFrame, registry: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, arrows, report): rows under canonical triples, emptied arrows gone, targets aggregated anew."""
    plan = plan_normalization(ledger, registry)
    after = plan.where("action <> 'collapse'").withColumn("updated_at", F.when(F.col("action") == "rewrite", now).otherwise(F.col("updated_at"))).select(*ledger.columns)
    moved = plan.where("action <> 'keep'")
    old = moved.select(F.col("old_subject").alias("subject"), F.col("old_relation").alias("relation"), F.col("old_object").alias("object")).distinct()
    filled = after.select(*TRIPLE).distinct()
    emptied = old.join(filled, list(TRIPLE), "left_anti")
    targets = moved.select(*TRIPLE).unionByName(old).distinct().join(filled, list(TRIPLE), "left_semi")
    scope = F.min_by("scope_conditions", F.when((F.col("action") == "rewrite") & (F.trim(F.coalesce("scope_conditions", F.lit(""))) != ""), F.col("seq")))
    scopes = plan.groupBy(*TRIPLE).agg(scope.alias("__scope"))
    agg = after.join(targets, list(TRIPLE), "left_semi").groupBy(*TRIPLE).agg(complement().alias("__confidence"), F.lit(True).alias("__hit")).join(scopes, list(TRIPLE), "left")
    joined = arrows.join(emptied, list(TRIPLE), "left_anti").join(agg, list(TRIPLE), "full_outer")
    hit = F.coalesce("__hit", F.lit(False))
    next_arrows = joined.withColumns(
        {
            "confidence": F.when(hit, F.col("__confidence")).otherwise(F.col("confidence")),
            "scope_conditions": F.coalesce(F.when(hit, F.col("__scope")), F.col("scope_conditions"), F.lit("")),
            "created_at": F.coalesce("created_at", now),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).select(*arrows.columns)
    report = plan.agg(
        F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "rewrite").alias("rewritten"), F.count_if(F.col("action") == "collapse").alias("collapsed"),
        F.count_if(F.col("flipped") & (F.col("action") != "keep")).alias("flipped"),
    ).crossJoin(emptied.agg(F.count("*").alias("arrows_deleted")))
    return after, next_arrows, report


def first_seen(ledger: DataFrame) -> DataFrame:
    """id, first_seen of every source of the ledger."""
    return ledger.where("coalesce(source_ref, '') <> ''").select(source_id("source_ref").alias("id"), "created_at").groupBy("id").agg(F.min("created_at").alias("first_seen"))


def backfill_sources(ledger: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, ledger with source_id, report); a malformed reference is an error."""
    found = first_seen(ledger)
    new = found.join(sources.select("id"), "id", "left_anti")
    linked = ledger.withColumn("source_id", F.when(F.coalesce("source_ref", F.lit("")) != "", source_id("source_ref")))
    unlinked = ledger.where("coalesce(source_ref, '') <> '' AND source_id IS NULL")
    report = new.agg(F.count("*").alias("sources_created")).crossJoin(found.join(sources.select("id"), "id", "left_semi").agg(F.count("*").alias("sources_present"))).crossJoin(unlinked.agg(F.count("*").alias("rows_linked")))
    return sources.unionByName(new.select("id", "first_seen")), linked, report


def backfill_embeddings(rows: DataFrame, embed: Column) -> DataFrame:
    """All rows, with a vector where there was none and evidence to embed; the model sees those rows only."""
    todo = without_embedding(rows).withColumn("evidence_embedding", embed)
    done = rows.where(~(F.col("evidence_embedding").isNull() & (F.coalesce("evidence", F.lit("")) != "")))
    return done.unionByName(todo.select(*rows.columns))
