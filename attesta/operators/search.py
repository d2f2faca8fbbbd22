"""Exact vector search: cosine in the JVM, TakeOrdered for the pool, joins for the survivors only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import cosine, element_id, scaled_score

POOL, TOP_K, EVIDENCE_K, THRESHOLD = 100, 5, 10, 0.60


def _vector(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def score_of(column: str, vector: list[float], scaled: bool = False) -> Column:
    raw = cosine(column, _vector(vector))
    return scaled_score(raw) if scaled else raw


def pool(df: DataFrame, column: str, vector: list[float], order: list[str], size: int = POOL, scaled: bool = False) -> DataFrame:
    """The ``size`` rows with the highest score; ties by ``order``."""
    scored = df.where(F.col(column).isNotNull()).withColumn("score", score_of(column, vector, scaled))
    return scored.orderBy(F.desc("score"), *order).limit(size)


def similar_entities(entities: DataFrame, vector: list[float], top_k: int = TOP_K, threshold: float = THRESHOLD, scaled: bool = False) -> DataFrame:
    """element_id, name, type, score: over-fetch, threshold on the raw result, then top k."""
    hits = pool(entities, "embedding", vector, ["name", "type"], scaled=scaled).where(F.col("score") >= threshold)
    return hits.orderBy(F.desc("score"), "name", "type").limit(top_k).select(element_id("name", "type").alias("element_id"), "name", "type", "score")


def search_by_type(entities: DataFrame, vector: list[float], type_: str, limit: int = EVIDENCE_K, prefilter: bool = True) -> DataFrame:
    """The nearest entities of one type. prefilter=False filters after the top k, and so may lose matches."""
    rows = entities.where(F.col("type") == type_) if prefilter else entities
    return pool(rows, "embedding", vector, ["name", "type"], limit).where(F.col("type") == type_).select("name", "type", "score")


def _wired(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Subject and object entities of each hit, null where there is none."""
    for side in ("subject", "object"):
        own = entities.select(
            F.col("name").alias(f"__{side}"),
            F.struct(element_id("name", "type").alias("element_id"), F.col("name").alias("name"), F.col("type").alias("type")).alias(f"{side}_entity"),
        )
        hits = hits.join(own, F.col(side) == F.col(f"__{side}"), "left").drop(f"__{side}")
    return hits


def search_events(ledger: DataFrame, entities: DataFrame, vector: list[float], top_k: int = TOP_K, threshold: float = THRESHOLD, scaled: bool = False) -> DataFrame:
    """Evidence rows by similarity: top k first, wiring of their endpoints after. Several indexes are united before."""
    order = ["subject", "relation", "object", "source_ref"]
    hits = pool(ledger, "evidence_embedding", vector, order, scaled=scaled).where(F.col("score") >= threshold)
    hits = hits.orderBy(F.desc("score"), *order).limit(top_k)
    return _wired(hits, entities).select(
        element_id(*order).alias("element_id"), F.lit("ExtractionEvent").alias("label"), "relation", "evidence", "source_ref", "confidence", "score",
        F.col("subject_entity").alias("subject"), F.col("object_entity").alias("object"),
    ).orderBy(F.desc("score"), "element_id")


def search_evidence(ledger: DataFrame, entities: DataFrame, vector: list[float], limit: int = EVIDENCE_K) -> DataFrame:
    """The ``limit`` nearest evidence rows that have a relation, without a threshold."""
    rows = ledger.where("relation IS NOT NULL")
    return search_events(rows, entities, vector, limit, -2.0)


def without_embedding(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose evidence still lacks its vector."""
    todo = rows.where(F.col("evidence_embedding").isNull() & (F.coalesce("evidence", F.lit("")) != ""))
    return todo if limit is None else todo.orderBy("seq").limit(limit)


def render_hits(df: DataFrame, as_json: bool = False) -> DataFrame:
    if as_json:
        return df.select(F.to_json(F.struct("*")).alias("value"))
    cells = [F.coalesce(F.format_number(c, 4) if t == "double" else F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
