"""The evidence ledger: write plans, upserts as snapshots, and arrows derived by complement aggregation.

A ledger row is identified by (subject, relation, object, source_ref). All
plans are pure: they return DataFrames and write nothing. ``seq`` orders rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import clamp
from attesta.schemas import IDENTITY, TRIPLE

MODES = ("keep-first", "refresh")


def repeat_mode(value: str | None) -> str:
    mode = (value or MODES[0]).strip().casefold()
    if mode not in MODES:
        raise ValueError(f"repeat mode must be one of {', '.join(MODES)}")
    return mode


def complement(confidence: Column | str = "confidence") -> Column:
    """1 - product(1 - c) of clamped confidences; combines partially before the shuffle."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return clamp(1 - F.product(1 - clamp(c)))


def complement_of(values: Column | str) -> Column:
    """The same over an array; an empty one gives 0."""
    return clamp(1 - F.aggregate(F.col(values) if isinstance(values, str) else values, F.lit(1.0), lambda s, c: s * (1 - clamp(c))))


def arrows(ledger: DataFrame) -> DataFrame:
    """One row per triple: confidence over all its rows, the newest non-empty scope and the newest reference; without the fields whose columns the ledger lacks."""
    scope = F.max_by("scope_conditions", F.when(F.coalesce(F.trim("scope_conditions"), F.lit("")) != "", F.col("seq")))
    fields = {
        ("confidence",): complement().alias("confidence"),
        ("scope_conditions", "seq"): F.coalesce(scope, F.lit("")).alias("scope_conditions"),
        (): F.count("*").alias("n_rows"),
        ("source_ref", "seq"): F.max_by("source_ref", "seq").alias("source_ref"),
        ("created_at",): F.min("created_at").alias("created_at"),
    }
    return ledger.groupBy(*TRIPLE).agg(*[value for needs, value in fields.items() if set(needs) <= set(ledger.columns)])


def ordered_evidence(value: str = "evidence", order: str = "seq") -> Column:
    """All values of a group in ledger order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda x: x[value])


def dedupe(rows: DataFrame, keys: tuple[str, ...] = IDENTITY, order: str = "seq", last: bool = False) -> DataFrame:
    """The first (or last) row of each identity by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc() if last else F.col(order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def plan_writes(existing: DataFrame, candidates: DataFrame, mode: str = "keep-first") -> DataFrame:
    """Candidates (in seq order) against stored rows: each with ``action`` create, update or skip.

    keep-first: an identity that is stored, or comes earlier in the batch, is
    skipped. refresh: the last candidate of an identity is the one that counts,
    as an update of a stored row or as a create; the others are skipped.
    """
    mode = repeat_mode(mode)
    stored = existing.select(*IDENTITY).distinct().withColumn("__stored", F.lit(True))
    w = Window.partitionBy(*IDENTITY).orderBy(F.col("seq") if mode == "keep-first" else F.col("seq").desc())
    ranked = candidates.withColumn("__rn", F.row_number().over(w)).join(stored, list(IDENTITY), "left")
    wins = F.col("__rn") == 1
    hit = F.coalesce("__stored", F.lit(False))
    action = F.when(wins & ~hit, "create").when(wins & hit & F.lit(mode == "refresh"), "update").otherwise("skip")
    return ranked.withColumn("action", action).drop("__rn", "__stored")


def planned_arrows(existing: DataFrame, plan: DataFrame) -> DataFrame:
    """The arrow of every triple that the plan touches, skips included: confidence over stored rows with refreshed values and creates.

    scope_conditions: of the newest create (or, in a refresh, update), also if
    empty; null where the batch only skips. A writer leaves the stored scope
    alone where this is null or empty.
    """
    values = plan.where("action <> 'skip'")
    touched = plan.select(*TRIPLE).distinct()
    kept = existing.join(touched, list(TRIPLE), "left_semi").join(values.select(*IDENTITY), list(IDENTITY), "left_anti")
    rows = kept.select(*TRIPLE, "confidence").unionByName(values.select(*TRIPLE, "confidence"))
    scope = values.groupBy(*TRIPLE).agg(F.max_by("scope_conditions", "seq").alias("scope_conditions"))
    return rows.groupBy(*TRIPLE).agg(complement().alias("confidence")).join(scope, list(TRIPLE), "left")


def apply_plan(existing: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    """The next ledger snapshot: creates appended, updates in place (created_at and, without a new one, the embedding stay)."""
    columns = existing.columns
    values = plan.where("action <> 'skip'")
    new = values.where("action = 'create'").withColumns({"created_at": now, "updated_at": now})
    missing = [c for c in columns if c not in new.columns]
    new = new.withColumns({c: F.lit(None).cast(existing.schema[c].dataType) for c in missing}).select(*columns)
    changed = values.where("action = 'update'")
    fields = [c for c in ("confidence", "evidence", "evidence_embedding", "scope_conditions", "domain", "raw_relation") if c in changed.columns and c in columns]
    updates = changed.select(*IDENTITY, F.struct(*fields).alias("__new"))
    joined = existing.join(updates, list(IDENTITY), "left")
    hit = F.col("__new").isNotNull()
    for c in fields:
        value = F.coalesce(F.col(f"__new.{c}"), F.col(c)) if c == "evidence_embedding" else F.col(f"__new.{c}")
        joined = joined.withColumn(c, F.when(hit, value).otherwise(F.col(c)))
    touched = plan.where("action = 'skip'").select(*IDENTITY).distinct().withColumn("__seen", F.lit(True))
    joined = joined.join(touched, list(IDENTITY), "left").withColumn("updated_at", F.when(hit | F.col("__seen"), now).otherwise(F.col("updated_at")))
    return joined.select(*columns).unionByName(new)


def merge_arrows(stored: DataFrame, planned: DataFrame, now: Column) -> DataFrame:
    """The next arrow snapshot: aggregates replace, an empty scope leaves the stored one."""
    new = planned.select(*TRIPLE, F.col("confidence").alias("__confidence"), F.col("scope_conditions").alias("__scope"), F.lit(True).alias("__hit"))
    joined = stored.join(new, list(TRIPLE), "full_outer")
    scope = F.when(F.coalesce(F.trim("__scope"), F.lit("")) != "", F.col("__scope")).otherwise(F.coalesce("scope_conditions", F.lit("")))
    return joined.withColumns(
        {
            "confidence": F.coalesce("__confidence", "confidence"),
            "scope_conditions": F.when(F.col("__hit"), scope).otherwise(F.col("scope_conditions")),
            "created_at": F.coalesce("created_at", now),
            "updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at")),
        }
    ).select(*stored.columns)


def upsert_edges(stored: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """The path without a ledger: the last edge of a triple replaces confidence, evidence, scope and reference."""
    last = dedupe(edges, TRIPLE, last=True)
    fields = ("confidence", "evidence", "scope_conditions", "source_ref")
    new = last.select(*TRIPLE, F.struct(*fields).alias("__new"))
    joined = stored.join(new, list(TRIPLE), "full_outer")
    hit = F.col("__new").isNotNull()
    out = {c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(out | {"created_at": F.coalesce("created_at", now), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(*stored.columns)


def reduce_edges(edges: DataFrame) -> DataFrame:
    """Fold edges of a triple in order: a source counts once, and after the first row only if it has a reference.

    Evidence is united in order (a row without any gives its reference); the
    newest non-empty reference, scope and domain stay.
    """
    first = F.row_number().over(Window.partitionBy(*TRIPLE).orderBy("seq"))
    by_source = F.row_number().over(Window.partitionBy(*TRIPLE, F.coalesce("source_ref", F.lit(""))).orderBy("seq"))
    rows = edges.withColumns({"__first": first, "__nth": by_source})
    has_ref = F.coalesce("source_ref", F.lit("")) != ""
    counts = (F.col("__first") == 1) | (has_ref & (F.col("__nth") == 1))

    def newest(c: str) -> Column:
        return F.coalesce(F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))), F.lit("")).alias(c)

    own = F.when(F.size("evidence") > 0, F.col("evidence")).when(has_ref, F.array("source_ref")).otherwise(F.array().cast("array<string>"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", own.alias("e")))), lambda x: x["e"])
    return rows.groupBy(*TRIPLE).agg(
        complement(F.when(counts, F.col("confidence")).otherwise(F.lit(0.0))).alias("confidence"),
        F.array_distinct(F.flatten(ordered)).alias("evidence"),
        newest("source_ref"), newest("scope_conditions"), newest("domain"),
    )


def assemble_delta(candidates: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new edges, changed edges with previous_confidence): reduced candidates against stored arrows."""
    reduced = reduce_edges(candidates)
    old = existing.select(*TRIPLE, F.col("confidence").alias("previous_confidence"))
    joined = reduced.join(old, list(TRIPLE), "left")
    return joined.where("previous_confidence IS NULL").drop("previous_confidence"), joined.where("previous_confidence IS NOT NULL")


def edge_lookup(arrows_: DataFrame, ledger: DataFrame, triples: DataFrame) -> DataFrame:
    """Named triples only: the arrow with the references and evidence of its rows in ledger order.

    Without rows the arrow's own evidence and reference stand in.
    """
    named = arrows_.join(triples.select(*TRIPLE).distinct(), list(TRIPLE), "left_semi")
    rows = ledger.join(triples.select(*TRIPLE).distinct(), list(TRIPLE), "left_semi")
    return named.join(row_provenance(rows), list(TRIPLE), "left").select(*provenance_columns(named))


def row_provenance(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*TRIPLE).agg(ordered_evidence("source_ref").alias("__refs"), ordered_evidence("evidence").alias("__evidence"))


def provenance_columns(arrows_: DataFrame) -> list[Column]:
    """The rows' newest reference and all evidence, else the legacy values of the arrow."""
    refs = F.filter("__refs", lambda r: r.isNotNull())
    legacy_ref = F.col("source_ref") if "source_ref" in arrows_.columns else F.lit(None).cast("string")
    legacy = F.col("evidence") if "evidence" in arrows_.columns else F.lit(None).cast("array<string>")
    return [
        *TRIPLE, "confidence", "scope_conditions",
        F.coalesce(F.try_element_at(refs, F.lit(-1)), legacy_ref, F.lit("")).alias("source_ref"),
        F.coalesce(F.filter("__evidence", lambda e: e.isNotNull()), legacy, F.array().cast("array<string>")).alias("evidence"),
    ]
