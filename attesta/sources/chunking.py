"""Documents to chunks: Markdown by headings, pages by paragraphs joined across page breaks; folder scans."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A paragraph that ends so goes on over the page; a paragraph that starts so doesn't continue one.
CONTINUATION_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "than", "that", "the", "to", "with")
CONTINUATION_MARKS = (",", ";", ":", "-", "—")
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
NUMBERED = r"(?i)^(chapter\s+\d+|\d+(?:\.\d+)*\s+\S.+)$"

Pages = Callable[[bytes], list[str]]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """source_id (the file name), text of a file, or of the .md and .markdown files right in a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}", recursiveFileLookup=False)
    return files.select(F.col("_metadata.file_name").alias("source_id"), F.col("value").alias("text")).orderBy("source_id")


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """Names in a folder that a scan leaves out."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"))
    return files.where(~F.lower("name").rlike(r"\.(md|markdown)$")).orderBy("name")


def source_kind(path: str) -> str:
    for kind, ends in (("markdown", (".md", ".markdown")), ("pdf", (".pdf",))):
        if path.lower().endswith(ends):
            return kind
    raise ValueError(f"unsupported source: {path}")


def read_pages(spark: SparkSession, path: str, extract: Pages) -> DataFrame:
    """source_id, pages array of PDF files by an injected text extractor."""

    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(extract)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.col("_metadata.file_name").alias("source_id"), pages("content").alias("pages"))


def _with_refs(chunks: DataFrame) -> DataFrame:
    """chunk_id and source_ref from source_id and ordinal (from 1)."""
    chunk_id = F.concat(F.lit("chunk-"), F.col("ordinal").cast("string"))
    return chunks.withColumn("chunk_id", chunk_id).withColumn("source_ref", F.concat_ws(":", "source_id", "chunk_id")).select("source_id", "ordinal", "chunk_id", "text", "section_path", "pages", "source_ref")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row: as a variable it isn't copied to every place that reads it."""
    return F.transform(F.array(value), use)[0]


def chunk_markdown(docs: DataFrame) -> DataFrame:
    """A chunk per heading (with its body), and one for text before the first.

    section_path: a heading of level n comes after the first n - 1 entries of
    the path before it, however deep those were. The work on a document's lines
    stays in its row and grows with their number: nothing is shuffled.
    """

    def heads(lines: Column) -> Column:
        marks = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title")))
        return F.filter(marks, lambda h: h["level"] > 0)

    def path(acc: Column, h: Column) -> Column:
        return _let(F.element_at(acc, -1), lambda last: F.concat(acc, F.array(F.concat(F.slice(last, F.lit(1), F.least(h["level"] - 1, F.size(last))), F.array(h["title"])))))

    root = F.from_json(F.lit("[[]]"), "array<array<string>>")

    def parts(lines: Column, found: Column) -> Column:
        cuts = F.concat(F.array(F.lit(0)), F.transform(found, lambda h: h["at"]), F.array(F.size(lines)))
        return _let(cuts, lambda c: F.transform(F.aggregate(found, root, path), lambda p, k: F.struct(_bare(F.array_join(F.slice(lines, c[k] + 1, c[k + 1] - c[k]), "\n")).alias("text"), p.alias("path"))))

    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")
    chunks = F.filter(_let(lines, lambda x: _let(heads(x), lambda h: parts(x, h))), lambda c: c["text"] != "")
    each = docs.select("source_id", F.posexplode(chunks).alias("pos", "c"))
    return _with_refs(each.select("source_id", (F.col("pos") + 1).cast("int").alias("ordinal"), "c.text", F.col("c.path").alias("section_path"), F.array().cast("array<int>").alias("pages")))


def continues(text: Column, following: Column) -> Column:
    """Does the last paragraph of a page go on with the first of the next?"""
    starts_anew = (text == "") | (following == "") | following.rlike(NUMBERED)
    marked = F.lit(False)
    for mark in CONTINUATION_MARKS:
        marked = marked | text.endswith(mark)
    return ~starts_anew & (marked | text.rlike(rf"(?i)\b(?:{'|'.join(CONTINUATION_WORDS)})$"))


def chunk_pages(docs: DataFrame) -> DataFrame:
    """A chunk per paragraph of ``pages`` (array of page texts), joined to the one before where it continues it across a break."""

    def paragraphs(page: Column, i: Column) -> Column:
        parts = F.filter(F.transform(F.split(page, r"\n\s*\n"), _bare), lambda p: p != "")
        return F.transform(parts, lambda p: F.struct(p.alias("text"), (i + 1).cast("int").alias("page")))

    flat = docs.select("source_id", F.flatten(F.transform("pages", paragraphs)).alias("p"))

    def joins(i: Column) -> Column:
        """Whether a paragraph goes on with the one before depends on these two only."""
        before, own = F.get("p", i - 1), F.get("p", i)
        return F.coalesce((before["page"] == own["page"] - 1) & continues(before["text"], own["text"]), F.lit(False))

    places = F.when(F.size("p") > 0, F.sequence(F.lit(0), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    cut = flat.select("source_id", "p", F.filter(places, lambda i: ~joins(i)).alias("starts"))
    cut = cut.select("source_id", "p", "starts", F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("p"))).alias("ends"))
    parts = F.transform("starts", lambda a, k: F.slice("p", a + 1, F.col("ends")[k] - a))
    rows = cut.select("source_id", F.posexplode(parts).alias("pos", "c"))
    return _with_refs(rows.select("source_id", (F.col("pos") + 1).cast("int").alias("ordinal"), F.array_join("c.text", "\n").alias("text"), F.array().cast("array<string>").alias("section_path"), F.col("c.page").alias("pages")))


def number_chunks(rows: DataFrame, order: str) -> DataFrame:
    """Ordinals from 1 per source by ``order``, then ids and references."""
    w = Window.partitionBy("source_id").orderBy(order)
    return _with_refs(rows.withColumn("ordinal", F.row_number().over(w)))


def batch_text(chunks: DataFrame) -> DataFrame:
    """source_id, batch, text: the chunks of a batch under their ids, in order."""
    part = F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), F.array_join("section_path", " > "), F.lit("\n"), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("t")))), lambda x: x["t"])
    return chunks.groupBy("source_id", "batch").agg(F.array_join(ordered, "\n\n").alias("text"))
