"""Token-id files under a canonical, length-limited Huffman code from global counts.

Writing. Texts are tokenized once, into a table of packed ids; their counts (a
vector of vocabulary size per task, summed) give code lengths of at most
``MAX_BITS`` by package-merge; the encoded texts are dealt by ranges of doc_id,
sorted and written as blocks. Nothing but the counts and one bound per file
reaches the driver.

File format, one folder per corpus:
  codebook/  one row: the code length of every id, a byte each (canonical codes follow).
  blocks/    part files in ascending doc_id order; each is a run of blocks, each
             followed by a line feed (the separator of Spark's text writer, whose
             commit protocol makes a lost executor harmless).
Block: magic ``HTB1`` | u32 bytes after this field | u32 documents | u32 ids |
  u32 payload bytes | i64 doc_ids | u8 has_id | u32 ids of each | u32 bytes of each |
  u32 bit offset in its document of every STRIDE-th id | payload, a document at
  whole bytes | u32 crc32 of all before.
Blocks decode independently, and the bit offsets let a table-driven decoder run
all strides of a block side by side.

Defined results. Null text: the end id alone. Null doc_id: sorts first. Repeated
rows: each is written. Empty table: a code book of zeros and no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, shuffle_width
from attesta.llm.tokens import PieceEncoder, word_bpe

END_ID, VOCABULARY, MAX_BITS, STRIDE = 1, 49_408, 18, 128
BLOCK_IDS, FILE_BYTES = 1 << 18, 24 << 20
MAGIC = b"HTB1"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    # Each level's merged list, as which entries are coins (True) or packages of the level below.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([coins, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(coins))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_coin in reversed(levels):
        n = int(is_coin[:take].sum())
        depth[:n] += 1  # the cheapest n coins of this level
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one more than the one before."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code = last = 0
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every window of ``bits`` bits: the id it starts with and that code's length."""
    bits = max(1, int(lengths.max(initial=1)))
    codes = canonical_codes(lengths)
    ids, sizes = np.zeros(1 << bits, np.uint16), np.ones(1 << bits, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    end = int(spans.sum())
    ids[:end], sizes[:end] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    assert not len(order) or int(codes[order[-1]]) << (bits - int(lengths[order[-1]])) == end - int(spans[-1])
    return ids, sizes, bits


def encode_texts(ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(bit offsets of every STRIDE-th id as u32, payload) of each text; a payload begins and ends at whole bytes."""
    each = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint16)
    size = lengths[flat].astype(np.int64)
    ends = np.append(0, np.cumsum(size))
    first = np.append(0, np.cumsum(each))
    bits = ends[first[1:]] - ends[first[:-1]]
    base = np.append(0, np.cumsum((bits + 7) // 8))  # byte where each text starts
    inside = ends[:-1] - np.repeat(ends[first[:-1]], each)  # bit offset in the own text
    at = inside + np.repeat(base[:-1] * 8, each)
    window = codes[flat].astype(np.uint64) << (np.uint64(32) - (size + (at & 7)).astype(np.uint64))
    n = int(base[-1]) + 4
    payload = np.zeros(n)
    for k in range(4):
        part = (window >> np.uint64(24 - 8 * k)) & np.uint64(255)
        payload += np.bincount((at >> 3) + k, weights=part.astype(np.float64), minlength=n)[:n]
    raw = payload.astype("u1").tobytes()
    return [(inside[first[i] : first[i + 1] : STRIDE].astype("<u4").tobytes(), raw[base[i] : base[i + 1]]) for i in range(len(ids))]


def join_block(texts: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A block of encoded texts: (doc_id, number of ids, bit offsets, payload)."""
    payload = b"".join(t[3] for t in texts)
    body = struct.pack("<III", len(texts), sum(t[1] for t in texts), len(payload))
    body += np.array([t[0] or 0 for t in texts], "<i8").tobytes() + np.array([t[0] is not None for t in texts], "u1").tobytes()
    body += np.array([t[1] for t in texts], "<u4").tobytes() + np.array([len(t[3]) for t in texts], "<u4").tobytes()
    body += b"".join(t[2] for t in texts) + payload
    head = MAGIC + struct.pack("<I", len(body) + 4)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def decode_blocks(content: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, number of ids of each text, all ids) of every block of a file."""
    symbol, size, bits = table
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        (rest,) = struct.unpack_from("<I", content, at + 4)
        end = at + 8 + rest
        if zlib.crc32(content[at : end - 4]) != struct.unpack_from("<I", content, end - 4)[0]:
            raise ValueError(f"damaged block at byte {at}")
        n_docs, _, n_bytes = struct.unpack_from("<III", content, at + 8)
        p = at + 20
        doc_ids = np.frombuffer(content, "<i8", n_docs, p)
        known = np.frombuffer(content, "u1", n_docs, p + 8 * n_docs)
        each = np.frombuffer(content, "<u4", n_docs, p + 9 * n_docs).astype(np.int64)
        held = np.frombuffer(content, "<u4", n_docs, p + 13 * n_docs).astype(np.int64)
        p += 17 * n_docs
        lanes = -(-each // STRIDE)
        bit = np.frombuffer(content, "<u4", int(lanes.sum()), p) + np.repeat((np.cumsum(held) - held) * 8, lanes)
        p += 4 * len(bit)
        # All strides run side by side; the last of a text is cut to its ids.
        full = np.full(len(bit), STRIDE, np.int64)
        full[np.cumsum(lanes)[lanes > 0] - 1] = ((each - 1) % STRIDE + 1)[lanes > 0]
        raw = np.zeros(n_bytes + 4 * STRIDE + 8, np.uint32)
        raw[:n_bytes] = np.frombuffer(content, "u1", n_bytes, p)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.empty((STRIDE, len(bit)), np.uint16)
        for k in range(STRIDE):
            seen = (window[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - bits)
            out[k] = symbol[seen]
            bit += size[seen]
        flat = out.T[np.arange(STRIDE) < full[:, None]]
        yield [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], each, flat
        at = end
        if content[at : at + 1] != b"\n":
            raise ValueError(f"no separator at byte {at}")
        at += 1


def _ids(encoder: PieceEncoder, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    end = end_id.to_bytes(2, "little")
    return (np.frombuffer(ids + end, "<u2") for ids in encoder.batches(t.as_py() for t in texts))


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n, ids (packed, unsigned 16-bit, with the end id) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = list(_ids(encoder, part.column(1), end_id))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, ids binary")


def global_counts(ids: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """How often each id occurs in the whole corpus: one vector per task, summed in bands of ids."""
    band = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                joined = b"".join(batch.column(0).slice(at, 500).to_pylist())
                total += np.bincount(np.frombuffer(joined, "<u2"), minlength=size)
        starts = list(range(0, size, band)) if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[s : s + band].tolist() for s in starts], pa.list_(pa.int64()))], names=["start", "n"])

    partial = ids.select("ids").mapInArrow(run, "start int, n array<long>")
    summed = partial.select("start", F.posexplode("n").alias("k", "n")).where("n > 0").groupBy((F.col("start") + F.col("k")).alias("id")).agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in summed.collect():  # at most one row per id of the vocabulary
        counts[row.id] = row.n
    return counts


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, scratch: Scratch | None = None) -> None:
    """Write ``folder``/codebook and ``folder``/blocks for all documents.

    Texts are tokenized once. They are encoded where they lie, and the encoded
    texts, which are a fraction of the text, are what travels to the files.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "huffman")
    ids = scratch.keep(tokenized(docs, vocabulary, end_id), "packed-ids")
    lengths = code_lengths(global_counts(ids))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                made = encode_texts([np.frombuffer(x, "<u2") for x in part.column("ids").to_pylist()], lengths, codes)
                columns = [part.column("__file"), part.column("doc_id"), part.column("n"), pa.array([o for o, _ in made], pa.binary()), pa.array([x for _, x in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["__file", "doc_id", "n", "offsets", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "offsets", "payload")), strict=True):
                held.append(row)
                n += row[1]
                if n >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([join_block(held)], pa.binary())], names=["block"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([join_block(held)], pa.binary())], names=["block"])

    # File bounds from quantiles of doc_id, so that the encoder runs once; equal doc_ids share a file.
    whole = ids.agg(F.sum("n")).first()[0] or 0
    files = shuffle_width(spark, whole * 3 // 2, FILE_BYTES)
    cuts = ids.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], 10_000)).first()[0] if files > 1 else None
    cuts = sorted(set(cuts or []))
    file = _place(cuts) if cuts else F.lit(0)
    encoded = ids.withColumn("__file", file).mapInArrow(encode, "__file int, doc_id long, n long, offsets binary, payload binary")
    dealt = encoded.repartitionById(len(cuts) + 1, "__file").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "payload")
    dealt.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.text(f"{folder}/blocks")
    scratch.drop("packed-ids")


def _place(cuts: list[int]):
    """How many of the sorted cuts lie below doc_id (a handful per file of the output)."""

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts), ids.fillna(cuts[0]).to_numpy(), "left").astype(np.int32))

    return place(F.col("doc_id"))


def read_ids(spark: SparkSession, folder: str, scratch: Scratch | None = None) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, ids (unsigned 16-bit, little-endian)."""
    return _read(spark, folder, "doc_id long, n_tokens long, ids_crc32 long, ids binary", with_ids=True, scratch=scratch)


def read_digests(spark: SparkSession, folder: str, scratch: Scratch | None = None) -> DataFrame:
    """As ``read_ids`` without the ids themselves."""
    return _read(spark, folder, "doc_id long, n_tokens long, ids_crc32 long", with_ids=False, scratch=scratch)


def _read(spark: SparkSession, folder: str, schema: str, with_ids: bool, scratch: Scratch | None) -> DataFrame:
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codebook").first().lengths, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                local = 0
                for doc_ids, each, flat in decode_blocks(content.as_py(), table):
                    ends = np.cumsum(each, dtype=np.int64)
                    parts = np.split(flat, ends[:-1])
                    columns = [
                        pa.array([file] * len(doc_ids), pa.int32()),
                        pa.array(local + ends - each),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(each),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
                    ] + ([pa.array([x.tobytes() for x in parts], pa.binary())] if with_ids else [])
                    local += int(ends[-1])
                    yield pa.RecordBatch.from_arrays(columns, names=["__file", "__local", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    files = spark.read.format("binaryFile").load(f"{folder}/blocks")
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    rows = files.select(number.alias("file"), "content").mapInArrow(run, f"__file int, __local long, {schema}")
    scratch = scratch or Scratch(spark, "token-ids")
    rows = scratch.keep(rows, "rows")
    # One row per file: where it starts in the corpus.
    per_file = rows.groupBy("__file").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    names = [c.split()[0] for c in schema.split(", ")]
    placed = rows.join(base, "__file").withColumn("start", (F.col("__base") + F.col("__local")).cast("long"))
    return placed.select("doc_id", "start", *names[1:])

