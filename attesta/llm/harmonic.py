"""Harmonic packing: reciprocal-capacity classes, each of whose bins takes a fixed number of pieces.

Class k holds pieces of capacity / k tokens, k of which fill a bin. Documents
may be cut freely here, so each is cut to lengths of its classes: as many full
sequences as it has, then the powers of two of the rest, largest first. With k
a power of two every bin of k pieces is full to the last token.

Every task fills bins of its own, class by class, while it tokenizes; it holds
back fewer than ``capacity`` tokens a class. What is left in a task when it ends,
under k pieces a class, is ranked over all tasks within its class and fills bins
by k again. The last, fewer than k pieces of a class share out into bins of 1, 2,
4, ... pieces, whose lengths are powers of two and so need no padding either.

No class, length or worker meets in one task; only leftovers, under 2 * capacity
pieces a task, are shuffled.

Defined results. Null or empty text: the end token alone. Null doc_id: packed
like any other row. Repeated rows: each is packed. Very long texts: cut into
full sequences. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, dense_rank_in, give_back
from attesta.llm.tokens import word_bpe

CAPACITY, END_ID = 2048, 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task long, rank long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full sequences, then the powers of two of the rest, largest first."""
    out = [(s, capacity) for s in range(0, n - n % capacity, capacity)]
    at, rest = n - n % capacity, n % capacity
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((at, length))
        at, rest = at + length, rest - length
    return out


def filled(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """PIECES: pieces of bins that a task filled have their place, leftovers a null sequence_id and a rank among those of the task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_bpe(vocabulary), end_id.to_bytes(2, "little")  # two bytes an id, until they are given out
        task = TaskContext.get().partitionId()
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "task", "rank"]
        held: dict[int, list[tuple]] = {}
        ready: list[tuple] = []
        bins = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ready, size
            columns = dict(zip(names, zip(*ready, strict=True), strict=True))
            wide = np.frombuffer(b"".join(columns["ids"]), "<u2").astype("<u4")
            ends = np.append(0, np.cumsum(columns["length"])).astype(np.int32) * 4
            ids = pa.Array.from_buffers(pa.binary(), len(ready), [None, pa.py_buffer(ends), pa.py_buffer(wide)])
            out = pa.RecordBatch.from_arrays([ids if c == "ids" else pa.array(columns[c], pa.int64()) for c in names], names=names)
            ready, size = [], 0
            return out

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.column(batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 2
                for start, length in cuts(n, capacity):
                    bin_ = held.setdefault(length, [])
                    bin_.append((doc_id, start, length, ids[2 * start : 2 * (start + length)], n))
                    if len(bin_) * length == capacity:
                        number = (task << 33) + bins
                        ready += [(*piece, number, k * length, task, None) for k, piece in enumerate(bin_)]
                        bins, size = bins + 1, size + 4 * capacity
                        held[length] = []
                if size >= 4 << 20:
                    yield flush()
        ready += [(*piece, None, None, task, k) for bin_ in held.values() for k, piece in enumerate(bin_)]
        if ready:
            yield flush()
        held.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def share_out(leftovers: DataFrame, capacity: int) -> DataFrame:
    """``leftovers`` of all tasks with their places: by k in each class, the last of a class by powers of two."""
    counts = {r.length: r.n for r in leftovers.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a class: 12 for 2048
    if not counts:
        return leftovers
    ranked = dense_rank_in(leftovers.drop("sequence_id", "offset"), ["length"], ["task", "rank"], sum(counts.values()), "__r")
    each = F.create_map(*[F.lit(x).cast("long") for pair in counts.items() for x in pair])
    ranked = ranked.withColumns({"__k": F.expr(f"{capacity} div length"), "__n": each[F.col("length")]})
    ranked = ranked.withColumns({"__bin": F.expr("__r div __k"), "__in": F.expr("__r % __k"), "__last": F.expr("__n % __k")})
    # Of __last pieces, that at __in lies in the bin of the highest bit in which the two differ.
    tail = F.expr("__bin = __n div __k")
    bit = F.when(tail, F.expr("length(bin(__in ^ __last))")).otherwise(0)
    place = F.when(tail, F.expr("__in & (shiftleft(1L, __bit - 1) - 1)")).otherwise(F.col("__in"))
    ranked = ranked.withColumn("__bit", bit)
    number = F.expr("-1 - ((__bin * 64 + length(bin(length))) * 64 + __bit)")  # below 0, tasks' own bins are not
    return ranked.withColumns({"sequence_id": number.cast("long"), "offset": (place * F.col("length")).cast("long")})


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset for every piece.

    ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    scratch = scratch or Scratch(docs.sparkSession, "harmonic")
    pieces = scratch.keep(filled(docs, vocabulary, capacity, end_id), "pieces")
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    left = share_out(pieces.where("sequence_id IS NULL"), capacity)
    return pieces.where("sequence_id IS NOT NULL").select(*columns).unionByName(left.select(*columns))
