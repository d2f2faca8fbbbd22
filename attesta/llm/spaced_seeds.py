"""Benchmark decontamination by spaced-seed hashing.

Test items and training texts are sequences of words (lower case, ASCII
punctuation counts as white space). Fixed masks choose some positions of a
window and ignore the others, so a window still hashes alike after
substitutions at ignored positions. Training windows are probed against the
hashes of the test items; every hit fixes a diagonal (test position against
training position), and its words are compared one by one. A document is
contaminated by an item if any stretch of such a diagonal has at least
LEAST_WORDS words (or the item's length, if shorter) and a share of LEAST_SHARE
of them agrees. Of these, the stretch with the best score of the diagonal (a
match counts 1, a substitution costs PENALTY) is reported if it is one of them,
else the longest. An overlap whose substitutions leave no mask whole anywhere
is not found.

The corpus is read in one map without a shuffle. What travels to the executors
is a slice of the test items of at most SLICE_CHARS characters; a larger test
set is taken in as many slices, one map each.

Defined results. Null or empty text or item: no windows, no rows. Items of
fewer than six words are too short to be told from chance and match nothing.
Null doc_id or item_id: reported as null. Repeated rows: each is reported.
Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The masks, 1 for a position that counts. Six positions each, for scattered and for clustered substitutions.
MASKS = ("111111", "1110111", "11011011", "11110011", "110101011", "1110000111")
PENALTY, LEAST_WORDS, LEAST_SHARE = 2.0, 10, 0.75
SLICE_CHARS = 8 << 20
SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_NONE = np.empty(0, np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    get = known.get
    out = list(map(get, words))
    if None in out:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        out = list(map(get, words))
    return np.array(out, np.uint64)


def windows(ids: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A hash per window of the positions that the mask chooses."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for c in (i for i, m in enumerate(mask) if m == "1"):
            h ^= ids[c : c + n]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h


class Seeds:
    """The hashed windows of test items, with a bit map in front of them."""

    def __init__(self, items: list[tuple[int | None, str]]):
        known: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [hashes(words_of(t), known) for _, t in items]
        found = [(h, np.full(len(h), k), np.arange(len(h))) for k, w in enumerate(self.words) for m, mask in enumerate(MASKS) for h in (windows(w, mask, m),)]
        every = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.item = (np.concatenate([f[1] for f in found]) if found else _NONE)[order]
        self.at = (np.concatenate([f[2] for f in found]) if found else _NONE)[order]
        size = 1 << max(16, math.ceil(math.log2(32 * len(every) + 1)))
        self.mask = np.uint64(size - 1)
        self.bits = np.zeros(size, bool)
        self.bits[self.hash & self.mask] = True

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(training position, item, item position) of every equal window."""
        out = []
        for m, mask in enumerate(MASKS):
            h = windows(ids, mask, m)
            at = np.flatnonzero(self.bits[h & self.mask])
            if len(at):
                lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
                n = hi - lo
                which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                out.append((np.repeat(at, n), self.item[which], self.at[which]))
        if not out:
            return _NONE, _NONE, _NONE
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """[start, end) of the stretch with the best score (matches 1, substitutions -PENALTY), the longest and first on ties."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -PENALTY))])
    low = np.minimum.accumulate(total)
    gain = total - low
    first_low = np.maximum.accumulate(np.where(np.concatenate([[True], low[1:] < low[:-1]]), np.arange(len(low)), 0))
    ends = np.flatnonzero(gain == gain.max())
    end = int(ends[np.argmax(ends - first_low[ends])])
    return int(first_low[end]), end


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """[start, end) of the longest stretch with a share of LEAST_SHARE of matches, the first on ties; (0, 0) if there is none."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - LEAST_SHARE, -LEAST_SHARE))])
    later = np.maximum.accumulate(total[::-1])[::-1]  # the highest total from here on never rises
    ends = np.searchsorted(-later, -total, "right") - 1
    start = int(np.argmax(ends - np.arange(len(total))))
    return (start, int(ends[start])) if ends[start] > start else (0, 0)


def verified(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """The stretch that counts as an overlap, or None where no stretch of ``least`` words has a share of LEAST_SHARE of matches."""
    if equal.sum() < LEAST_SHARE * least:
        return None
    a, b = best_stretch(equal)
    if b - a < least or equal[a:b].sum() < LEAST_SHARE * (b - a):
        a, b = longest_stretch(equal)
    return (a, b) if b - a >= least else None


def overlaps(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: Seeds) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start in the text, start in the item, words, equal words): the verified stretch of each contaminated pair with most equal words."""
    at, item, own = seeds.hits(ids)
    if not len(at):
        return []
    text = np.searchsorted(ends, at, "right")
    diagonals = np.unique(np.stack([text, item, at - own], 1), axis=0)
    best: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
    for t, k, d in diagonals.tolist():
        words = seeds.words[k]
        lo, hi = max(0, starts[t] - d), min(len(words), ends[t] - d)
        if hi <= lo:
            continue
        equal = words[lo:hi] == ids[lo + d : hi + d]
        if stretch := verified(equal, min(LEAST_WORDS, len(words))):
            a, b = stretch
            same = int(equal[a:b].sum())
            row = (t, k, int(lo + a + d - starts[t]), int(lo + a), b - a, same)
            if (t, k) not in best or (same, -row[2]) > (best[t, k][5], -best[t, k][2]):
                best[t, k] = row
    return sorted(best.values())


def contaminated(docs: DataFrame, items: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """A row per contaminated pair: doc_id, item_id and its best verified stretch, in words."""
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    slices = max(1, math.ceil((tests.agg(F.sum(F.length("text"))).first()[0] or 0) / slice_chars))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for s in range(slices):
        part = tests if slices == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s)
        seeds = Seeds(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))  # at most about slice_chars
        found = own.mapInArrow(_scan(seeds), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def table(doc_ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
            if len(known) > 1_000_000:
                known.clear()
            ends = np.cumsum([len(w) for w in words])
            starts = ends - [len(w) for w in words]
            ids = hashes([w for x in words for w in x], known)
            rows = [(doc_ids[t], seeds.ids[k], *rest) for t, k, *rest in overlaps(ids, starts, ends, seeds)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], names=names)

        doc_ids, words, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                words.append(words_of(text.as_py()))
                n += len(words[-1])
                if n >= 100_000:
                    yield table(doc_ids, words)
                    doc_ids, words, n = [], [], 0
        if doc_ids:
            yield table(doc_ids, words)

    return run
