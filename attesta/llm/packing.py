"""Best-fit packing: documents into token sequences by bin completion branch-and-bound.

Shape of the job. Texts are tokenized once into light piece rows (full pieces
and one remainder per document). What the packer needs to know about the
corpus is how many pieces there are of each length, at most ``capacity``
numbers however large the corpus, so the search runs on that histogram, on the
driver, over patterns with multiplicities. Pieces are then ranked within their
length (in parallel, also for a length that holds a third of all rows) and the
rank decides the place. The plan that is shipped has one entry per pattern and
length: bounded by the capacity, not by the data.

Defined results. Null text: the end token alone. Null doc_id: packed like any
other row. Repeated rows: each is packed. Empty table: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, dense_rank_in
from attesta.llm.tokens import byte_bpe

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many bins, ((length, how often), ...)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full pieces at the end, the odd one first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_bpe(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                texts = (t.as_py() for t in part.column(1))
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.batches(texts), strict=True):
                    ids += end
                    rows += [
                        (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        for k, (start, length) in enumerate(cut(len(ids) // 4, capacity))
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram; bins with equal contents move together."""
    open_bins: dict[int, list[list]] = {}  # residual -> [[bins, contents]]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = [r for r in open_bins if r >= size]
            if fits:
                room = min(fits)
                group = open_bins[room][-1]
                n = min(left, group[0])
                group[0] -= n
                if not group[0]:
                    open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                contents = group[1]
            else:
                room, contents = capacity, ()
                n = -(-left // (capacity // size))  # the bins that this size fills alone
            open_bins.setdefault(room - size, []).append([n, (*contents, size)])
            left -= n
    done: dict[tuple[int, ...], int] = {}
    for groups in open_bins.values():
        for n, contents in groups:
            done[contents] = done.get(contents, 0) + n
    return [(n, tuple((s, c.count(s)) for s in sorted(set(c), reverse=True))) for c, n in sorted(done.items(), reverse=True)]


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on bins: the total, or what large items force (two-class bound)."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in {s for s in counts if s <= capacity // 2} | {0}:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        halves = sum(n for s, n in counts.items() if capacity / 2 < s <= capacity - k)
        room = sum((capacity - s) * n for s, n in counts.items() if capacity / 2 < s <= capacity - k)
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        best = max(best, alone + halves + max(0, -(-(small - room) // capacity)))
    return best


def completions(counts: dict[int, int], largest: int, capacity: int, slack: int, limit: int) -> list[tuple[int, ...]]:
    """The ``limit`` undominated fillings around the largest item that waste least (at most ``slack``), those with larger items first on ties.

    A filling is dominated, and left out, if another item still fits or if one
    of its items can be exchanged for a larger one that fits. The sums that the
    items from each size on can make are bit sets, so no branch ends in vain.
    """
    left = dict(counts)
    left[largest] -= 1
    room = capacity - largest
    sizes = sorted((s for s, n in left.items() if n and s <= room), reverse=True)
    full = (1 << (room + 1)) - 1
    reach = [1]  # from the last size on: bit x is set if x can be made
    for s in reversed(sizes):
        sums, n, step = reach[-1], min(left[s], room // s), 1
        while n > 0:
            take = min(step, n)
            sums |= (sums << (s * take)) & full
            n, step = n - take, step * 2
        reach.append(sums)
    reach.reverse()
    found: list[tuple[int, ...]] = []

    def grow(at: int, rest: int, chosen: tuple[int, ...], waste: int) -> None:
        if not rest:
            have = {x: chosen.count(x) + (x == largest) for x in {*chosen, largest}}
            spare = lambda x: counts.get(x, 0) > have.get(x, 0)
            if not waste or not any(spare(x) and (x <= waste or any(c < x <= c + waste for c in set(chosen))) for x in sizes):
                found.append(chosen)
            return
        for k in range(at, len(sizes)):
            s = sizes[k]
            if s > rest or not reach[k] >> rest & 1:
                if s <= rest:
                    return
                continue
            for n in range(min(left[s], rest // s), 0, -1):
                if reach[k + 1] >> (rest - n * s) & 1:
                    grow(k + 1, rest - n * s, chosen + (s,) * n, waste)
                    if len(found) >= limit:
                        return

    for waste in range(min(slack, room) + 1):
        if reach[0] >> (room - waste) & 1:
            grow(0, room - waste, (), waste)
            if len(found) >= limit:
                break
    return found


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 4_000, branch: int = 4) -> list[Pattern]:
    """Branch-and-bound over completions of the largest item; best-fit solutions are the incumbents.

    Each node takes the largest length left, tries its ``branch`` least wasteful
    undominated fillings in order and uses one as often as the counts allow.
    Paths that always take the first filling come first, then those with one
    other choice, the earliest such choices first, and so on. A branch ends where
    the waste so far passes what an improvement on the incumbent can afford. The remainder under some nodes is also packed best-fit,
    which keeps the incumbent good. The search ends at the waste bound, which
    proves the optimum, or after ``nodes``.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    fixed: list[Pattern] = []
    if counts.get(capacity):
        fixed.append((counts.pop(capacity), ((capacity, 1),)))
    if not counts:
        return fixed
    best = best_fit(counts, capacity)
    best_bins = sum(n for n, _ in best)
    least = waste_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    # A path is a chain of (pattern, the chain before), so that a node costs no copy of it or of the counts.
    waves: list[list[tuple[tuple | None, int, int]]] = [[(None, 0, 0)]]
    spent = 0

    def unrolled(path: tuple | None) -> list[Pattern]:
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]

    while waves and best_bins > least and spent < nodes:
        this, later = waves.pop(), []
        for path, bins, waste in this:
            left = dict(counts)
            for times, parts in unrolled(path):
                for size, each in parts:
                    left[size] -= times * each
            left = {size: n for size, n in left.items() if n}
            while best_bins > least and spent < nodes and waste <= (best_bins - 1) * capacity - total:
                spent += 1
                if not left:
                    best, best_bins = unrolled(path), bins
                    break
                if spent % 64 == 0:
                    rest = best_fit(left, capacity)
                    if (n := bins + sum(k for k, _ in rest)) < best_bins:
                        best, best_bins = unrolled(path) + rest, n
                largest = max(left)
                spare = (best_bins - 1) * capacity - total - waste
                children = []
                for filling in completions(left, largest, capacity, spare, branch):
                    use = {s: (largest, *filling).count(s) for s in {largest, *filling}}
                    empty = capacity - largest - sum(filling)
                    times = min(left[s] // c for s, c in use.items())
                    if empty:
                        times = max(1, min(times, spare // empty))
                    children.append(((times, tuple(sorted(use.items(), reverse=True))), times, times * empty))
                if not children:
                    break
                later += [((pattern, path), bins + times, waste + lost) for pattern, times, lost in children[1:]]
                pattern, times, lost = children[0]
                for size, each in pattern[1]:
                    left[size] -= times * each
                    if not left[size]:
                        del left[size]
                path, bins, waste = (pattern, path), bins + times, waste + lost
        if later:
            waves.append(later)
    return fixed + best


def place(pieces: DataFrame, plan: list[Pattern], rows: int) -> DataFrame:
    """Give each piece its sequence and offset: its rank within its length picks the pattern."""
    spans: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, per bin, first bin, offset)
    taken: dict[int, int] = {}
    first_bin = 0
    for times, parts in plan:
        offset = 0
        for size, each in parts:
            spans.setdefault(size, []).append((taken.get(size, 0), each, first_bin, offset))
            taken[size] = taken.get(size, 0) + times * each
            offset += size * each
        first_bin += times
    lookup = {s: np.array(x, np.int64).T for s, x in spans.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    start, each, base, shift = lookup[int(length[own[0]])]
                    k = np.searchsorted(start, rank[own], "right") - 1
                    inside = rank[own] - start[k]
                    sequence[own] = base[k] + inside // each[k]
                    offset[own] = shift[k] + inside % each[k] * length[own]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = dense_rank_in(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], rows, "__rank")
    return ranked.mapInArrow(run, PLACED)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = 4_000, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = bin_completion(counts, capacity, nodes)
    return place(pieces, plan, sum(counts.values()))
