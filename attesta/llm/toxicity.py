"""Toxicity: a counterfactual-regularised classifier of whole texts.

Features are the words of a text and their prefixes (so that inflected forms
share weight), present or absent. Learning goes in two steps: document
frequencies per class over the labelled sample choose the features (by
aggregation), and a logistic regression is fitted on them. Its loss has a
second term: for every labelled sentence that holds an identity term, the
sentence is repeated with the term swapped for the others of its group, and the
squared change of the score is penalised. A group's name then can't carry
weight of its own, however often it meets toxic labels.

Labelled rows are read up to ``sample`` (by hash of doc_id, so any table gives
the same rows in any order); everything that is scored is scored whole.

Defined results. Null or empty text: no features, the score of the intercept.
Null doc_id: held out is false, scored. Repeated rows: each is scored. A label
that is null, or whose doc_id repeats with both labels: the row is left out, or
both rows are used. No labels at all: every score is 0. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import Scratch, give_back

# Identity terms by group; a term is swapped for the others of its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("mexican", "chinese", "indian", "american", "german", "french", "spanish", "turkish", "polish", "russian"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"), ("musulmanes", "cristianos", "judíos"),
)
STRIP = " \t\n\r\x0b\x0c.,;:!?…|*%&$#<>\"'()[]{}«»“”‘’-_/\\"
PREFIXES, THRESHOLD = (4, 5, 6), 0.3
SAMPLE, MOST_FEATURES, LEAST_DOCS, LEAST_G = 20_000, 4_096, 3, 8.0
L2, COUNTERFACTUAL, STEPS = 1e-3, 4.0, 400


def words_of(text: str | None) -> set[str]:
    return {w for w in (x.strip(STRIP) for x in set((text or "").lower().split())) if w}


def features_of(word: str) -> list[str]:
    """The word itself and its prefixes; an identity term has no prefixes, so that a swap changes it alone."""
    if word in _IDENTITY:
        return [word]
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


_IDENTITY = frozenset(t for g in IDENTITY_GROUPS for t in g)


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float

    def scorer(self, most: int = 60_000):
        """A function from text to score; answers per word are kept, for at most 2 * ``most`` words."""
        weights, known, older = self.weights, {}, {}
        index = {f: i for i, f in enumerate(weights)}
        value = np.array([*weights.values(), 0.0])

        def score(text: str | None) -> float:
            nonlocal known, older
            found: set[int] = set()
            for raw in set((text or "").lower().split()):
                ids = known.get(raw)
                if ids is None:
                    ids = older.get(raw)
                    if ids is None:
                        word = raw.strip(STRIP)
                        ids = tuple(i for f in features_of(word) if (i := index.get(f)) is not None) if word else ()
                    if len(known) >= most:
                        known, older = {}, known
                    if len(raw) <= 64:
                        known[raw] = ids
                if ids:
                    found.update(ids)
            z = self.intercept + float(value[sorted(found)].sum()) if found else self.intercept
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, y of at most about ``sample`` labelled rows outside the held-out part, chosen by hash of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("y")).dropna()
    own = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2).distinct()
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # The sample is bounded by its parameter, so it goes to the texts, not the texts to it.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")


def select_features(rows: DataFrame, most: int, least: int) -> list[str]:
    """The features whose presence tells the classes apart best, by the G statistic, above what chance gives; identity terms come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(seen: dict[str, list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([t for _, t in seen.values()], pa.int64())], names=["f", "n", "t"])

        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in words_of(text.as_py()) for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[y >= 0.5] += 1
                if len(seen) >= 100_000:  # partial counts: they are summed below
                    yield table(seen)
                    seen = {}
        yield table(seen)
        seen = {}
        give_back()

    counts = rows.select("text", "y").mapInArrow(run, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") + F.col("t") >= least)
    whole = rows.agg(F.sum(F.when(F.col("y") < 0.5, 1).otherwise(0)).alias("n"), F.sum(F.when(F.col("y") >= 0.5, 1).otherwise(0)).alias("t")).first()
    if not whole.n or not whole.t:
        return sorted(_IDENTITY)
    total = whole.n + whole.t
    both = F.col("n") + F.col("t")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = part(F.col("n"), both * (whole.n / total)) + part(F.col("t"), both * (whole.t / total))
    best = counts.withColumn("g", g).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "f").limit(most).select("f").collect()  # top-k by design
    return sorted({r.f for r in best} | _IDENTITY)


def swapped(sentence: set[str]) -> list[set[str]]:
    """The sentence with each identity term replaced by each other term of its group."""
    return [(sentence - {term}) | {other} for group in IDENTITY_GROUPS for term in group if term in sentence for other in group if other != term]


def _sparse(words: set[str], index: dict[str, int]) -> list[int]:
    return sorted({index[f] for w in words for f in features_of(w) if f in index})


def fit(rows: list[tuple[list[int], float]], pairs: list[tuple[list[int], list[int]]], n: int, l2: float = L2, penalty: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Minimise log loss + l2 |w|^2 + penalty * mean squared change of the score over the pairs (Adam, full batches)."""
    y = np.array([v for _, v in rows])
    at, of = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows]), np.array([i for f, _ in rows for i in f], np.int64)
    pa_, po = np.repeat(np.arange(len(pairs)), [len(a) for a, _ in pairs]), np.array([i for a, _ in pairs for i in a], np.int64)
    qa, qo = np.repeat(np.arange(len(pairs)), [len(b) for _, b in pairs]), np.array([i for _, b in pairs for i in b], np.int64)
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        error = sigmoid(b + np.bincount(at, w[of], len(rows))) - y
        grad = np.bincount(of, error[at], n) / len(rows) + 2 * l2 * w
        grad_b = error.mean()
        if pairs:
            s, t = sigmoid(b + np.bincount(pa_, w[po], len(pairs))), sigmoid(b + np.bincount(qa, w[qo], len(pairs)))
            # Where a sigmoid is flat its change says nothing of the weights: the logits' change is held down too.
            delta = s - t
            dz = np.bincount(pa_, w[po], len(pairs)) - np.bincount(qa, w[qo], len(pairs))
            gs, gt = 2 * penalty * (delta * s * (1 - s) + 0.05 * dz), 2 * penalty * (delta * t * (1 - t) + 0.05 * dz)
            grad += (np.bincount(po, gs[pa_], n) - np.bincount(qo, gt[qa], n)) / len(pairs)
            grad_b += float((2 * penalty * delta * (s * (1 - s) - t * (1 - t))).mean())
        g = np.append(grad, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:n], b - float(move[n])
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = MOST_FEATURES, least: int = LEAST_DOCS, penalty: float = COUNTERFACTUAL) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(labelled_sample(docs, labels, sample), "sample")
    chosen = select_features(rows, features, least)
    index = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: its features, and those of its sentences with identity terms before and after each swap."""
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                pairs = []
                if not _IDENTITY.isdisjoint(words_of(text)):
                    for line in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
                        own = words_of(line)
                        pairs += [(_sparse(own, index), _sparse(other, index)) for other in swapped(own)]
                out.append((_sparse(words_of(text), index), [x for p in pairs for x in p]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.list_(pa.int32())))], names=["doc_id", "y", "own", "pairs"])
        give_back()

    found = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, own array<int>, pairs array<array<int>>")
    found = sorted(found.collect(), key=lambda r: (r.doc_id, r.y, r.own))  # bounded by the sample and the features
    scratch.drop("sample")
    if not found:
        return Model({}, -30.0)
    pairs = [(r.pairs[i], r.pairs[i + 1]) for r in found for i in range(0, len(r.pairs), 2)]
    w, b = fit([(r.own, r.y) for r in found], pairs, len(chosen), penalty=penalty)
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, b)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every row (all by default) and ``__score`` of its whole text; only texts go to Python."""
    keep = docs.columns if keep is None else keep

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = model.scorer()
        for texts in batches:
            yield pa.array([one(t.as_py()) for t in texts], pa.float64())
        give_back()

    return docs.select(*keep, of(F.col("text").cast("string")).alias("__score"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
