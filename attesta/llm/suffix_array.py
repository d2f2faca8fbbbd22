"""Suffix-array deduplication: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Suffix sorting needs strings that may be equal to be in one task, and nothing
else. So the corpus is cut by content first:

1. Anchors. Every window of LENGTH bytes has a smallest hash among its GRAM-byte
   substrings (the rightmost on ties); that place is the window's anchor. Equal
   windows have equal anchors, so windows are compared within an anchor's hash
   only.
2. Anchors whose hash occurs once are done: all their windows are unique. For
   the others the stretch of text that their windows span travels to the task
   of the hash; equal stretches of different places settle one another.
3. Bucket-pointer refinement. The stretches of a task, in blocks of bounded
   size, get buckets by their first 8 bytes (the initial q-grams); buckets are
   refined by sorting on the bucket identifier found ``h`` bytes later, doubling
   ``h``, with every update reused by the next refinement, until buckets stand
   for LENGTH bytes. Windows alone in a bucket drop out on the way. A bucket
   with two places is a repeat.
4. A hash with more stretches than ``HOT`` is refined across tasks instead: its
   windows are aggregated by their identifiers at offsets 0, 1/3 and 2/3 (each
   the hash of a third), so no task takes the whole group.

Repeated windows return to their documents as runs of starts, whose union of
LENGTH-byte covers is removed. A text that occurs several times as a whole goes
whole. Texts in which nothing repeats, and those too short for a window, are
told by a Bloom filter and never shuffled. Keys that hold more than a thousandth
of the rows are joined where the rows lie.

Defined results. Null or empty text: nothing to remove, the digest of nothing.
Null doc_id: takes part, as a place of its own. Repeated rows: copies of one
text. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.bloom import having, membership
from attesta.llm.common import Scratch, free_name, give_back, join_counted

LENGTH, GRAM = 400, 64
HOT, BLOCK_BYTES = 4096, 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte substring: a polynomial by doubling, then mixed."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power = None, 0, data.astype(np.uint64) + np.uint64(1)
        base, width = _B, 1
        while True:  # binary decomposition of k: spans of 1, 2, 4, ... bytes
            if k & width:
                if out is None:
                    out = power[:n].copy()
                else:
                    out = out * np.uint64(pow(_B, width, 1 << 64)) + power[done : done + n]
                done += width
            if done == k:
                break
            power = power[:-width] * np.uint64(base) + power[width:]
            base, width = base * base & _MASK, width * 2
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(27)
    return out


_PLACE = (1 << 24) - 1


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end: (text, hash, first window, window after the last).

    Fewer than 2^24 bytes. The order of substrings is that of the upper 40 bits
    of their hashes, the rightmost first on ties: equal windows agree on it.
    """
    none = np.empty(0, np.int64)
    h = gram_hashes(data, gram)
    w = length - gram + 1
    n = len(h) - w + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    key = (h & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(h), dtype=np.uint64))
    table = np.concatenate([key, np.full(-len(key) % w, _MASK, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    place = _PLACE - (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(_PLACE)).astype(np.int64)
    # Windows inside one text, in runs of one anchor.
    valid = np.maximum(np.minimum(ends - length + 1, n) - starts, 0)
    text = np.repeat(np.arange(len(starts)), valid)
    window = np.arange(int(valid.sum())) + np.repeat(starts - np.append(0, np.cumsum(valid)[:-1]), valid)
    own = place[window]
    fresh = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])) if len(own) else none
    last = np.append(fresh[1:], len(own)) - 1 if len(fresh) else none
    return text[fresh], h[own[fresh]], window[fresh], window[last] + 1


def refine(text: np.ndarray, active: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``length``-byte strings at ``active`` are in a bucket with another: bucket-pointer refinement.

    Every active place has ``length`` bytes before the end of ``text``.
    """
    n = len(text)
    h = min(8, length)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    q = np.zeros(n, np.uint64)
    for i in range(h):
        q = (q << np.uint64(8)) | padded[i : i + n]
    bucket = np.unique(q, return_inverse=True)[1].astype(np.int64)  # identifiers are ranks: they sort like the text
    alive = np.arange(len(active))
    while True:
        counts = np.bincount(bucket[active[alive]], minlength=1)
        alive = alive[counts[bucket[active[alive]]] > 1]
        if h == length or not len(alive):
            out = np.zeros(len(active), bool)
            out[alive] = True
            return out
        step = min(h, length - h)
        # Only places that a live window still points at are refined.
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, active[alive], 1)
        np.add.at(cover, active[alive] + length - h - step + 1, -1)
        want = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        pointed = bucket[want] * np.int64(n) + bucket[want + step]
        bucket[want] = np.unique(pointed, return_inverse=True)[1]  # reused by the next refinement
        h += step


STRETCH = "text_id binary, anchor long, stretch long, first long, after long"


def stretches(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per run of windows: the anchor's hash, the hash of the bytes that the run spans, and its window starts."""
    piece = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        def table(held: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
            whole = b"".join(raw for _, raw, _ in held)
            ends = np.cumsum([len(raw) for _, raw, _ in held])
            starts = ends - [len(raw) for _, raw, _ in held]
            of, anchor, first, after = anchors(np.frombuffer(whole, np.uint8), starts, ends, length, gram)
            digest = np.array([xxh3_64_intdigest(whole[a : b + length - 1]) for a, b in zip(first.tolist(), after.tolist(), strict=True)], np.uint64)
            shift = np.array([base for _, _, base in held], np.int64)[of] - starts[of]
            ids = pa.array([k for k, _, _ in held], pa.binary()).take(pa.array(of))
            columns = [ids, *(pa.array(x.astype(np.int64)) for x in (anchor, digest, first + shift, after + shift))]
            return pa.RecordBatch.from_arrays(columns, names=["text_id", "anchor", "stretch", "first", "after"])

        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                for at in range(0, max(len(raw) - length + 1, 0), piece):
                    held.append((key, raw[at : at + piece + length - 1], at))
                    size += len(held[-1][1])
                    if size >= 1 << 18:
                        yield table(held)
                        held, size = [], 0
        if held:
            yield table(held)
        held = []
        give_back()

    return texts.select("text_id", "text").mapInArrow(run, STRETCH)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


RUNS = "text_id binary, first long, after long"


def _sorted_repeats(rows: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Runs of repeated windows in the unsettled stretches; a hash's stretches are in one task and one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple]) -> pa.RecordBatch:
            text = np.frombuffer(b"".join(raw for *_, raw in held), np.uint8)
            at, active = 0, []
            for *_, raw in held:
                active.append(np.arange(at, at + len(raw) - length + 1))
                at += len(raw)
            found = np.split(refine(text, np.concatenate(active), length), np.cumsum([len(a) for a in active])[:-1])
            out = [(key, first + a, first + b) for (key, first, settled, _), flags in zip(held, found, strict=True) if not settled for a, b in _runs(flags)]
            columns = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["text_id", "first", "after"])

        held, size, last = [], 0, None
        for batch in batches:
            c = [batch.column(x) for x in ("anchor", "text_id", "first", "settled", "bytes")]
            for anchor, key, first, settled, raw in zip(*(x.to_pylist() for x in c), strict=True):
                if size >= block_bytes and anchor != last:
                    yield solve(held)
                    held, size = [], 0
                held.append((key, first, settled, raw))
                size += len(raw)
                last = anchor
        if held:
            yield solve(held)
        held = []
        give_back()

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, RUNS)


def _hot_repeats(rows: DataFrame, length: int) -> DataFrame:
    """The same for hashes with very many stretches: windows are dealt by their identifiers, a row each."""
    third = -(-length // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(x).to_pylist() for x in ("anchor", "text_id", "first", "settled", "bytes")]
            for anchor, key, first, settled, raw in zip(*c, strict=True):
                part = gram_hashes(np.frombuffer(raw, np.uint8), third)
                n = len(raw) - length + 1
                with np.errstate(over="ignore"):
                    ids = (part[:n] * np.uint64(31) ^ part[third : third + n]) * np.uint64(0xBF58476D1CE4E5B9) ^ part[length - third : length - third + n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array(ids.astype(np.int64)), pa.array([key] * n, pa.binary()), pa.array(np.arange(first, first + n)), pa.array([settled] * n)],
                    names=["anchor", "window", "text_id", "first", "settled"],
                )

    windows = rows.mapInArrow(run, "anchor long, window long, text_id binary, first long, settled boolean")
    again = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.where("NOT settled").join(again, ["anchor", "window"]).select("text_id", "first", (F.col("first") + 1).alias("after"))


def repeated_windows(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """text_id, first, after: runs of starts of strings that start elsewhere too. ``texts``: text_id (equal for equal texts), text."""
    found = scratch.keep(stretches(texts, length, gram), "stretches")
    again = scratch.keep(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    near = scratch.keep(join_counted(found, again, ["anchor"], "n", found.count()).drop("n"), "again")
    scratch.drop("stretches", "anchors")
    by_bytes = near.groupBy("anchor", "stretch").agg(F.count("*").alias("places"), F.min(F.struct("text_id", "first", "after")).alias("one"))
    by_bytes = scratch.keep(by_bytes, "by-bytes")
    several = by_bytes.where("places > 1").select("anchor", "stretch", "places")
    settled = join_counted(near, several, ["anchor", "stretch"], "places", near.count()).select("text_id", "first", "after").distinct()
    # A hash with one stretch only is settled altogether; the others are sorted, each distinct stretch once.
    kinds = scratch.keep(by_bytes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    open_ = join_counted(by_bytes, kinds, ["anchor"], "kinds", by_bytes.count()).select("anchor", "one.*", (F.col("places") > 1).alias("settled"), (F.col("kinds") > hot).alias("hot"))
    open_ = scratch.keep(open_, "open")
    per_text = open_.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "first", "after", "settled", "hot")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "text_id", "first", "settled", "hot", "bytes"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows, size = [], 0
            for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                for r in runs.as_py():
                    rows.append((r["anchor"], key, r["first"], r["settled"], r["hot"], raw[r["first"] : r["after"] + length - 1]))
                    size += len(rows[-1][-1])
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        give_back()

    asked = scratch.keep(open_.select("text_id").distinct(), "asked")
    once = having(texts, "text_id", asked).groupBy("text_id").agg(F.first("text").alias("text")).join(per_text, "text_id").select("text_id", "text", "runs")
    cuts = once.mapInArrow(cut, "anchor long, text_id binary, first long, settled boolean, hot boolean, bytes binary")
    runs = _sorted_repeats(cuts.where("NOT hot"), length, block_bytes)
    if not kinds.where(F.col("kinds") > hot).isEmpty():
        cuts = scratch.keep(cuts, "cuts")
        runs = _sorted_repeats(cuts.where("NOT hot"), length, block_bytes).unionByName(_hot_repeats(cuts.where("hot"), length))
    return settled.unionByName(runs)


def remaining(raw: bytes, runs: list[tuple[int, int]], length: int) -> list[bytes]:
    """The stretches of bytes outside every repeated string, one more than were removed."""
    keep, at = [], 0
    end = None
    for first, after in sorted(runs):
        if end is None or first > end:
            if end is not None:
                at = end
            keep.append(raw[at:first])
            end = after - 1 + length
        else:
            end = max(end, after - 1 + length)
    keep.append(raw[end or 0 :])
    return keep


def text_ids(docs: DataFrame, text: str, text_id: str) -> DataFrame:
    """All columns of ``docs`` with its text (null: empty) and an identifier, equal for equal texts, under the given names."""
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(text_id, F.unhex(F.md5(F.encode(own, "utf-8")))).withColumn(text, own)


def deduplicate(docs: DataFrame, keep: list[str], length: int = LENGTH, with_text: bool = True, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """Columns ``keep`` of every row with __n_bytes, __n_removed, __n_spans, __sha256 and, if asked for, __kept (binary) and __kept_text.

    The text is that of the kept stretches, each decoded by itself; what a cut
    leaves of a character goes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix-array")
    t, k, r, n = (free_name(docs.columns, name) for name in ("__text", "__text_id", "__runs", "__rows"))
    own = text_ids(docs.select(*dict.fromkeys([*keep, "text"])), t, k).select(*keep, t, k)
    texts = own.select(F.col(k).alias("text_id"), F.col(t).alias("text")).where(F.octet_length("text") >= length)
    found = repeated_windows(texts, scratch, length, min(GRAM, max(1, length // 4)), hot)
    whole = scratch.keep(texts.groupBy(F.col("text_id").alias(k)).agg(F.count("*").alias(n)).where(F.col(n) > 1), "whole")
    per_text = found.groupBy(F.col("text_id").alias(k)).agg(F.collect_list(F.struct("first", "after")).alias(r))
    per_text = per_text.join(whole.select(k), k, "left_anti").select(k, F.lit(1).cast("long").alias(n), r)
    # A text that occurs again as a whole needs no runs, so a hot key's row is small.
    marks = scratch.keep(per_text.unionByName(whole.withColumn(r, F.lit(None).cast("array<struct<first:bigint,after:bigint>>"))), "marks")
    scratch.drop("again", "by-bytes", "kinds", "open", "asked", "cuts", "whole")
    inside = membership(marks.select(k))
    maybe = (F.octet_length(t) >= length) & (F.lit(True) if inside is None else inside(k))
    marked = join_counted(own.where(maybe), marks, [k], n, own.count(), "left")
    extra = "__n_bytes long, __n_removed long, __n_spans long, __sha256 string" + (", __kept binary, __kept_text string" if with_text else "")
    schema = docs.select(*keep).schema
    for part in extra.split(", "):
        schema = schema.add(*part.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a batch's texts are held a few times over
                part, out = batch.slice(at, 256), []
                for text, runs, rows in zip(part.column(t), part.column(r), part.column(n), strict=True):
                    raw = text.as_py().encode()
                    whole = rows.is_valid and not runs.is_valid
                    parts = [b"", b""] if whole else remaining(raw, [(x["first"], x["after"]) for x in runs.as_py() or ()], length)
                    left = b"".join(parts)
                    out.append((len(raw), len(raw) - len(left), len(parts) - 1, hashlib.sha256(left).hexdigest(), left, "".join([p.decode("utf-8", "ignore") for p in parts])))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()][: 4 + 2 * with_text]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)] if out else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=schema.names)
        give_back()

    size, raw = F.octet_length(t).cast("long"), F.encode(t, "utf-8")
    columns = [size.alias("__n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("__n_removed", "__n_spans")), F.sha2(raw, 256).alias("__sha256")]
    as_they_are = own.where(~maybe).select(*keep, *columns, *([raw.alias("__kept"), F.col(t).alias("__kept_text")] if with_text else []))
    return as_they_are.unionByName(marked.select(*keep, t, r, n).mapInArrow(run, schema))
