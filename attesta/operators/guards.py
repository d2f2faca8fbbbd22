"""Shape guards: which endpoints of a candidate triple aren't names. Classification only, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import fold, split_items

# The classes in check order, the qualitative terms and the patterns.
CLASSES = ("numeric_endpoint", "qualitative_endpoint", "deictic", "self_loop", "description_in_name", "clause", "list", "compound_actor")
QUALITATIVE = ("elevated", "high", "low", "stable", "weak", "strong", "rising", "falling", "improved", "deteriorated", "ample", "tight")
CLAUSE_WORDS, LIST_ITEMS = 7, 3
NUMERIC = r"(?i)^\s*[$€£]?\s*[-+]?\d[\d.,]*\s*(%|percent|bn|billion|million|trillion|m|k)?\b"
DEICTIC = (
    r"(?i)^(the |this |that |these |those )?(previous|next|following|above|current|prior|foregoing|aforementioned)\b"
    r"|^(it|they|them|he|she|this|that|speaker|the speaker|the video|the author)$"
)
PARENTHESIS, POSSESSIVE = r"\([^)]+\)", r"(?U)\b\w+'s\b"


def endpoint_classes(endpoint: Column, clause_words: int = CLAUSE_WORDS, list_items: int = LIST_ITEMS, qualitative: tuple[str, ...] = QUALITATIVE) -> Column:
    """The classes of one endpoint; null has none."""
    words = F.size(F.filter(F.split(F.trim(endpoint), r"\s+"), lambda w: w != ""))
    shape = F.when(words >= clause_words, F.lit("clause")).when(F.size(split_items(endpoint)) >= list_items, F.lit("list")).when(fold(endpoint).contains(" and "), F.lit("compound_actor"))
    found = F.array_compact(
        F.array(
            F.when(endpoint.rlike(NUMERIC), F.lit("numeric_endpoint")),
            F.when(fold(F.trim(endpoint)).isin(*qualitative), F.lit("qualitative_endpoint")),
            F.when(endpoint.rlike(DEICTIC), F.lit("deictic")),
            F.when(endpoint.rlike(PARENTHESIS) | endpoint.rlike(POSSESSIVE), F.lit("description_in_name")),
            shape,
        )
    )
    return F.coalesce(found, F.array().cast("array<string>"))


def is_self_loop(subject: Column, object_: Column) -> Column:
    s = fold(F.trim(F.coalesce(subject, F.lit(""))))
    return (s != "") & (s == fold(F.trim(F.coalesce(object_, F.lit("")))))


def classify(df: DataFrame, **thresholds) -> DataFrame:
    """Adds guard_classes (the subject's, the object's new ones, then self_loop), primary_class and flagged_endpoint."""
    df = df.withColumns({"__s": endpoint_classes(F.col("subject"), **thresholds), "__o": endpoint_classes(F.col("object"), **thresholds)})
    loop = F.when(is_self_loop(F.col("subject"), F.col("object")), F.array(F.lit("self_loop"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("guard_classes", F.concat(F.array_union("__s", "__o"), loop))
    df = df.withColumn("primary_class", F.try_element_at("guard_classes", F.lit(1)))
    return df.withColumn("flagged_endpoint", F.when(F.col("primary_class").isNotNull(), flagged_endpoint(F.col("primary_class"), F.col("__s"), F.col("__o")))).drop("__s", "__o")


def flagged_endpoint(guard: Column, subject_classes: Column, object_classes: Column) -> Column:
    """The subject wins; a self loop is the object's."""
    return F.when(guard == "self_loop", "object").when(F.array_contains(subject_classes, guard), "subject").when(F.array_contains(object_classes, guard), "object").otherwise("subject")
