"""A training corpus from raw documents: five stages, each calling one operator and working on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import minhash, packing, spaced_seeds, suffix_array, toxicity
from attesta.llm.common import Scratch, free_name, read_table

#: Passages of about fifty words are cut where they repeat: the shortest such passage in bytes.
REPEAT_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below the threshold, each row by its own text (null: as empty), whatever its doc_id.

    The model is trained on a sample of the labelled rows of the documents table.
    """
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id, one of those on ties; rows without a doc_id come last.

    Rows are told apart by a number of their own, so repeated rows and copies
    without a doc_id are reduced too, and rows that only share a doc_id with a copy stay.
    """
    scratch = Scratch(spark, "stage-minhash")
    key = free_name(docs.columns, "__row")
    rows = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")  # written once, so numbers stay
    groups = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), scratch=scratch).select(F.col("doc_id").alias("__member"), F.col("component_id").alias("__group"))
    several = groups.groupBy("__group").agg(F.count("*").alias("__n")).where("__n > 1").select("__group")
    grouped = scratch.keep(groups.join(several, "__group"), "grouped")
    ids = rows.select(F.col(key).alias("__member"), F.col("doc_id").cast("long").alias("__id")).join(grouped, "__member")
    first = ids.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__member"))["__member"].alias("__member"))
    losers = scratch.keep(grouped.select("__member").join(first.select("__member"), "__member", "left_anti"), "losers")
    return rows.join(losers, rows[key] == losers["__member"], "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that passages of REPEAT_BYTES share; a character cut in two goes whole. n_chars follows the text."""
    scratch = Scratch(spark, "stage-suffix-array")
    found = suffix_array.deduplicate(docs, docs.columns, length=REPEAT_BYTES, scratch=scratch)
    changed = F.col("__n_removed") > 0
    new = {"text": F.col("__kept_text"), "n_chars": F.length("__kept_text")}
    columns = [F.when(changed, new[c]).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in docs.columns]
    return found.select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no passage of the benchmark. Each row is judged by its own text, whatever doc_id it has or shares."""
    scratch = Scratch(spark, "stage-spaced-seeds")
    key = free_name(docs.columns, "__row")
    rows = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")  # written once, so numbers stay
    found = spaced_seeds.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    leaks = scratch.keep(found.select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return rows.join(leaks, rows[key] == leaks["__leak"], "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 1024 tokens; a null text is packed as empty, a null doc_id like any other."""
    scratch = Scratch(spark, "stage-packing")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch=scratch)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizing, training and hashing have no SQL form; tests hold the stages against planted cases and their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
