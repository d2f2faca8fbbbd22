"""MinHash near-duplicates: universal hash minima, banding, verification on full sets, connected components.

1. Every whole text becomes the set of its word shingles (as 64-bit hashes) and
   ``HASHES`` minima under universal hashes. Texts with equal sets are one
   class; only the smallest doc_id of a class goes on, so copies cost nothing.
2. Bands of ``ROWS`` minima make bucket keys. ``BANDS`` bands miss a pair at the
   threshold with a probability below 1e-6.
3. Buckets are not expanded into pairs. In each, the member that meets most
   others over all its buckets is the hub, and the others are linked to the hub
   if their full sets are similar enough. Components of these links are found.
4. What is left are buckets whose members lie in different components: there
   every member outside the bucket's largest component is held against the
   members of other components, in blocks and in the first bucket that the two
   share. Their exact distances to the hub (by the triangle inequality), the
   signature estimate and the smallest ``LOWEST`` hashes of both sets discard
   what can't reach the threshold where it is met, so no refuted pair becomes a
   row; for sets of up to ``LOWEST`` shingles the last is an exact bound. The
   rest is again confirmed on full sets: first each one's likeliest partners,
   then, where those didn't join it, all others. Pairs within one component
   can't change the result and are skipped; no pair that could is.
5. Components by alternating large-star and small-star on the links.

Equality of shingles is equality of 64-bit hashes; links are decided on whole
sets of them. Signatures, sets and links stay distributed.

Defined results. Null, empty or blank text: an empty set, linked with nothing
(also not with other empty texts). Null doc_id: kept, its own component (null).
Rows that share a doc_id are each placed by their own text. Empty table: no
rows. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.bloom import having
from attesta.llm.common import Scratch, give_back, join_counted

SHINGLE, THRESHOLD = 5, 80
ROWS, BANDS = 6, 48
HASHES = ROWS * BANDS
#: Estimates below this share of equal signature bytes can't belong to a pair at the threshold: five standard deviations.
SURELY_BELOW = 0.68
BLOCK, LIKELIEST = 512, 3
#: How many of a set's smallest hashes tell pairs apart more finely; larger sets are estimated, less five standard deviations.
LOWEST = 512
LOWEST_MARGIN = 5 * (0.8 * 0.2 / LOWEST) ** 0.5


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes of the k-word shingles of a text (A-Z lower-cased); the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    ids = np.array([known[w] if w in known else known.setdefault(w, digest(w)) for w in words], np.uint64)
    n = max(1, len(ids) - k + 1)
    h = np.full(n, 0x9E3779B97F4A7C15 + min(k, len(ids)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(ids))):
            h = (h ^ ids[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return np.unique(h)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of a*x + b (mod 2^32) over the set, for every (a, b)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):  # a block stays in cache
        out = np.minimum(out, (a[:, None] * x[None, at : at + 512] + b[:, None]).min(1))
    return out


SKETCH = "doc_id long, n_shingles long, set_id binary, signature binary, bands array<long>"


def sketch(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        lift = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, sets, signs, bands = [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py(), k)
                    sizes.append(len(s))
                    if not len(s):
                        sets.append(None)
                        signs.append(None)
                        bands.append(None)
                        continue
                    sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                    m = minima(s, a, b)
                    signs.append((m ^ (m >> np.uint32(16))).astype(np.uint8).tobytes())
                    with np.errstate(over="ignore"):
                        key = lift.copy()
                        for column in m.reshape(BANDS, ROWS).T:
                            key[:, 0] = (key[:, 0] ^ column) * np.uint64(0xFF51AFD7ED558CCD)
                            key[:, 0] ^= key[:, 0] >> np.uint64(29)
                    bands.append(key[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_id", "signature", "bands"],
                )
        give_back()

    return docs.mapInArrow(run, SKETCH)


def lowest(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set_id, low: the smallest LOWEST hashes (their upper 32 bits) of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [(xxhash.xxh3_128_digest(s.tobytes()), (s[:LOWEST] >> np.uint64(32)).astype("<u4").tobytes()) for s in (shingles(t.as_py(), k) for t in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], names=["doc_id", "set_id", "low"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id binary, low binary")


def similar(low: np.ndarray, size: int, lows: list[np.ndarray], sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Of sets given by their smallest hashes: which may be as similar as the threshold, and how similar they look (-1: they can't be)."""
    out = np.full(len(lows), -1.0)
    for k, (other, n) in enumerate(zip(lows, sizes.tolist(), strict=True)):
        if size <= LOWEST and n <= LOWEST:
            common = int(np.isin(other, low).sum())  # cut hashes can only meet more often
            if 100 * common >= threshold * (size + n - common):
                out[k] = common / max(1, size + n - common)
        else:
            both = np.union1d(low, other)[:LOWEST]
            share = float((np.isin(both, low) & np.isin(both, other)).mean())
            if share >= threshold / 100 - LOWEST_MARGIN:
                out[k] = share
    return out


def confirm(pairs: DataFrame, docs: DataFrame, k: int, threshold: int, scratch: Scratch, name: str) -> DataFrame:
    """a, b, common, whole (the sizes of intersection and union of the full sets), linked: 100 * common >= threshold * whole.

    A document that is in many pairs is dealt into parts with few pairs each.
    The texts that pairs need are picked out by a Bloom filter, so the corpus is
    not shuffled; joins are merges at every size.
    """
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__parts"))
    dealt = pairs.hint("merge").join(hot, "a").withColumn("__salt", F.pmod(F.xxhash64("b"), F.col("__parts")).cast("int"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = scratch.keep(having(docs, "doc_id", scratch.keep(needed, f"needed-{name}")), f"texts-{name}")
    left = texts.join(hot.hint("merge"), texts["doc_id"] == hot["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__salt"), F.col("text").alias("text_a"))
    right = dealt.hint("merge").join(texts, dealt["b"] == texts["doc_id"]).select("a", "__salt", "b", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)
        for batch in batches:
            sizes = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, own = a, shingles(ta.as_py(), k)
                other = shingles(tb.as_py(), k)
                common = len(np.intersect1d(own, other, assume_unique=True))
                sizes.append((common, len(own) + len(other) - common))
            columns = [pa.array([c for c, _ in sizes], pa.int64()), pa.array([w for _, w in sizes], pa.int64()), pa.array([100 * c >= threshold * w for c, w in sizes], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=["a", "b", "common", "whole", "linked"])
        give_back()

    tested = scratch.keep(right.hint("merge").join(left, ["a", "__salt"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, common long, whole long, linked boolean").distinct(), name)
    scratch.drop(f"texts-{name}")
    return tested


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and two sums of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """member, root: the smallest id reachable, for every id of ``links`` (a, b), by alternating large-star and small-star."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    seen = _digest(edges)
    for step in range(1, 200):
        # Large-star: larger neighbours of a node are tied to its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small, f"{name}-{step}")
        now = _digest(after)
        ends, seen = now == seen, now
        scratch.drop(f"{name}-{step - 1}")
        edges = after
        if ends:
            break
    else:
        raise RuntimeError("components did not settle in 199 rounds")
    return edges.select(F.col("u").alias("member"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("member"), F.col("v").alias("root")).distinct())


def _hubs(members: DataFrame) -> DataFrame:
    """bucket, a: the hub of each bucket, the member that meets most others over all its buckets (then the smallest id)."""
    size = members.groupBy("bucket").agg(F.count("*").alias("n"))
    met = members.join(size, "bucket").groupBy("doc_id").agg(F.sum("n").alias("met"))
    ranked = members.join(met, "doc_id")
    return ranked.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("least"))).alias("h")).select("bucket", (-F.col("h.least")).alias("a"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their root, the bucket's size ``n`` and its largest component ``main``."""
    placed = members.join(roots.withColumnRenamed("member", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    sides = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sides.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).where("k > 1 AND n > 2")
    return placed.join(mixed, "bucket")


def _leftover(rows: DataFrame, sketches: DataFrame, threshold: int, best: int | None) -> DataFrame:
    """(a, b): pairs of one bucket and different components that nothing rules out.

    ``rows``: of ``_mixed``, with each one's exact distance (1 - Jaccard) to the
    bucket's hub. Distances obey the triangle inequality, so two members whose
    distances to the hub differ by more than the threshold allows can't be
    linked; signatures and lowest hashes rule out more.
    best: of each member outside the largest component only the so many likeliest
    partners in each other component and block; None: all.
    """
    rows = rows.withColumn("__odd", F.col("root") != F.col("main.root"))
    n_odd = F.col("n") - F.col("main.n")
    odd_blocks, all_blocks = F.ceil(n_odd / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), odd_blocks).cast("int"), F.pmod(F.xxhash64("doc_id"), all_blocks).cast("int")
    # Odd members meet every block of the bucket, every member meets every block of odd members.
    first = rows.where("__odd").select("bucket", "doc_id", "root", "away", own[0].alias("i"), F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("j"), F.lit(True).alias("odd"))
    second = rows.select("bucket", "doc_id", "root", "away", F.explode(F.sequence(F.lit(0), odd_blocks - 1)).alias("i"), own[1].alias("j"), F.lit(False).alias("odd"))
    blocks = first.unionByName(second).join(sketches, "doc_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        odd, rest = group[group.odd], group[~group.odd]
        if odd.empty or rest.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        bucket = int(group.bucket.iloc[0])
        signature = np.frombuffer(b"".join(rest.signature), np.uint8).reshape(len(rest), HASHES)
        bands = np.stack(rest.bands.to_numpy()).astype(np.int64)
        low = [np.frombuffer(x, "<u4") for x in rest.low]
        size, root, ids, away = rest.n_shingles.to_numpy(), rest.root.to_numpy(), rest.doc_id.to_numpy(), rest.away.to_numpy()
        reach = 1 - threshold / 100 + 1e-9
        a, b = [], []
        for x in odd.itertuples():
            near = np.flatnonzero((root != x.root) & (np.abs(away - x.away) <= reach) & (100 * np.minimum(size, x.n_shingles) >= threshold * np.maximum(size, x.n_shingles)))
            near = near[(signature[near] == np.frombuffer(x.signature, np.uint8)).mean(1) >= SURELY_BELOW]
            if len(near):  # a pair is held together in the first bucket that it shares
                shared = bands[near] == np.asarray(x.bands, np.int64)
                near = near[bands[near, shared.argmax(1)] == bucket]
            if len(near):
                equal = similar(np.frombuffer(x.low, "<u4"), x.n_shingles, [low[k] for k in near.tolist()], size[near], threshold)
                near, equal = near[equal >= 0], equal[equal >= 0]
                if best is not None and len(near) > best:
                    order = np.argsort(-equal, kind="stable")
                    nth = pd.Series(root[near[order]]).groupby(root[near[order]]).cumcount().to_numpy()
                    near = near[order[nth < best]]
                for y in ids[near]:
                    a.append(min(x.doc_id, y))
                    b.append(max(x.doc_id, y))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64").drop_duplicates()

    return blocks.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    sketches = scratch.keep(sketch(own, k), "sketches")
    classes = sketches.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("class_id"), F.min_by(F.struct("n_shingles", "signature", "bands"), "doc_id").alias("s"), F.count("*").alias("copies"))
    reps = classes.select(F.col("class_id").alias("doc_id"), "set_id", "s.*")
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = scratch.keep(buckets.join(shared, "bucket").distinct(), "members")
    hubs = scratch.keep(_hubs(members), "hubs")
    at_hub = members.join(hubs, "bucket")
    stars = confirm(at_hub.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), own, k, threshold, scratch, "stars")
    distance = stars.select("a", F.col("b").alias("doc_id"), (1 - F.col("common") / F.col("whole")).alias("away"))
    placed = at_hub.join(distance, ["a", "doc_id"], "left").select("bucket", "doc_id", F.coalesce("away", F.lit(0.0)).alias("away"))
    placed = scratch.keep(placed, "placed")  # the hub itself is at distance 0
    links = stars.where("linked").select("a", "b")
    roots = scratch.keep(components(links, scratch, "star"), "star-roots")
    own_sketches = reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # The likeliest partners first: what they join needs no further pairs.
    for step, best in enumerate((LIKELIEST, None)):
        mixed = scratch.keep(_mixed(placed, roots), f"mixed-{step}")
        asked = scratch.keep(mixed.select("doc_id").distinct(), f"asked-{step}")
        fine = own_sketches.join(lowest(having(own, "doc_id", asked), k).distinct(), ["doc_id", "set_id"]).drop("set_id")
        more = _leftover(mixed, fine, threshold, best).join(tested, ["a", "b"], "left_anti")
        more = scratch.keep(more, f"leftover-{step}")
        scratch.drop(f"mixed-{step}", f"asked-{step}")
        tested = tested.unionByName(more)
        if not more.isEmpty():
            links = links.unionByName(confirm(more, own, k, threshold, scratch, f"links-{step}").where("linked").select("a", "b"))
            roots = scratch.keep(components(links, scratch, f"roots-{step}"), f"all-roots-{step}")
    # Classes take the root of their representative; copies of one doc_id with different sets share a node.
    found = classes.select("set_id", "class_id", "copies").join(roots.withColumnRenamed("member", "class_id"), "class_id", "left").select("set_id", F.coalesce("root", "class_id").alias("root"), "copies")
    found = scratch.keep(found, "found")
    own_rows = sketches.select("doc_id", "n_shingles", "set_id")
    several = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    placed = join_counted(own_rows.where(several), found, ["set_id"], "copies", sketches.count()).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    out = placed.unionByName(own_rows.where(~several).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
