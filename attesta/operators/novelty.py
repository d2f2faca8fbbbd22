"""Novelty gates: one decision per distinct claim, shared by its repeats; only novel claims go on."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import claim, state_claim

#: claims -> [(choice, {label: probability})], in order; an exception aborts the run.
Classifier = Callable[[list[str]], list[tuple[str, dict[str, float]]]]
CHOICES = ("novel", "known", "trivial")


def with_claims(df: DataFrame, state: bool = False) -> DataFrame:
    return df.withColumn("claim", state_claim("entity", "state_key", "value") if state else claim("subject", "relation", "object", "claim" if "claim" in df.columns else None))


def unique_claims(df: DataFrame) -> DataFrame:
    """Each claim once, at its first place."""
    return df.groupBy("claim").agg(F.min("seq").alias("seq"))


def counted_claims(df: DataFrame) -> DataFrame:
    """Each claim once, with the number ``n`` of its candidates."""
    return df.groupBy("claim").agg(F.count("*").alias("n"))


def classify(claims: DataFrame, classifier: Classifier) -> DataFrame:
    """claim, choice, probabilities. Write the result once: a model must not be asked again by a retry."""

    @F.pandas_udf("choice string, probabilities map<string,double>")
    def decide(texts: pd.Series) -> pd.DataFrame:
        found = classifier(texts.tolist())
        return pd.DataFrame({"choice": [c for c, _ in found], "probabilities": [p for _, p in found]})

    return claims.select("claim", decide.asNondeterministic()("claim").alias("v")).select("claim", "v.*")


def gate(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows whose claim is novel; a claim without a verdict is an error."""
    joined = df.join(verdicts.select("claim", "choice"), "claim", "left")
    checked = joined.withColumn("choice", F.coalesce("choice", F.raise_error(F.concat(F.lit("no verdict for: "), F.col("claim"))).cast("string")))
    return checked.where("choice = 'novel'").drop("choice")


def gate_counts(df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: candidates, unique claims, kept and dropped candidates. ``df``: candidates, or claims counted already."""
    counted = df if "n" in df.columns else counted_claims(df)
    joined = counted.join(verdicts.select("claim", "choice"), "claim")

    def total(rows: Column | None = None) -> Column:
        return F.coalesce(F.sum("n" if rows is None else F.when(rows, F.col("n"))), F.lit(0))

    novel = F.col("choice") == "novel"
    return joined.agg(total().alias("candidates"), F.count_distinct("claim").alias("unique_claims"), total(novel).alias("kept"), total(~novel).alias("dropped"))


def mean_probabilities(verdicts: DataFrame) -> DataFrame:
    """label, p: the mean over all decisions; one that lacks a label counts 0 for it."""
    total = verdicts.agg(F.count("*").alias("n"))
    return verdicts.select(F.explode("probabilities").alias("label", "p")).groupBy("label").agg(F.sum("p").alias("s")).crossJoin(F.broadcast(total)).select("label", (F.col("s") / F.col("n")).alias("p"))
