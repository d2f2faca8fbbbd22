"""Ranked fan-out: seeds of a query, the edges around them, and the strongest directions, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import cosine, normalize_name, state_claim
from attesta.operators.ledger import provenance_columns, row_provenance
from attesta.schemas import TRIPLE

TOP_K, BREADTH, THRESHOLD = 5, 20, 0.60


def positive(value: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def exact_seeds(entities: DataFrame, text: str) -> DataFrame:
    """name, type, seed_score 1.0: the normalized name or an alias is the normalized text."""
    wanted = normalize_name(F.lit(text))
    named = (normalize_name("name") == wanted) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: normalize_name(a) == wanted)
    return entities.where(named & (wanted != "")).select("name", "type", F.lit(1.0).alias("seed_score"))


def semantic_seeds(entities: DataFrame, vector: list[float], threshold: float = THRESHOLD) -> DataFrame:
    score = cosine("embedding", F.array(*[F.lit(float(v)) for v in vector]))
    scored = entities.where("embedding IS NOT NULL").select("name", "type", score.alias("seed_score"))
    return scored.where(F.col("seed_score") >= threshold)


def match_seeds(spark: SparkSession, entities: DataFrame, text: str, embed=None, threshold: float = THRESHOLD) -> tuple[DataFrame, str | None]:
    """(seeds, notice). An exact match needs no embedding; without one, and without a vector, there are no seeds."""
    exact = exact_seeds(entities, text)
    if not exact.isEmpty():
        return exact, None
    vector = embed(text) if embed else None
    if vector is None:
        return exact, "embedding unavailable: exact names and aliases only"
    return semantic_seeds(entities, vector, threshold), None


def edges_around(arrows: DataFrame, names: DataFrame) -> DataFrame:
    """seed, neighbor and arrow of every edge that touches ``names`` (column seed), in either direction; a self loop once."""
    out = arrows.join(names, arrows["subject"] == names["seed"]).select(names["*"], F.col("object").alias("neighbor"), *[arrows[c] for c in arrows.columns], F.lit("out").alias("direction"))
    back = arrows.where("subject <> object").join(names, F.col("object") == names["seed"]).select(names["*"], F.col("subject").alias("neighbor"), *[arrows[c] for c in arrows.columns], F.lit("in").alias("direction"))
    return out.unionByName(back)


def directions(seeds: DataFrame, arrows: DataFrame, ledger: DataFrame | None = None, top_k: int = TOP_K, breadth: int = BREADTH) -> DataFrame:
    """rank, seed, relation, neighbor, confidence, seed_score, scope_conditions (and, with a ledger, source_ref, evidence).

    Of each seed the ``breadth`` strongest edges count (by confidence, relation,
    neighbour); of each (seed, relation, neighbour) the best; the first ``top_k``
    by confidence, seed score and neighbour are returned. Provenance is looked
    up for the survivors only.
    """
    positive(top_k, "top_k"), positive(breadth, "breadth")
    names = seeds.groupBy(F.col("name").alias("seed")).agg(F.max("seed_score").alias("seed_score"))
    edges = edges_around(arrows.select(*TRIPLE, "confidence", "scope_conditions"), names)
    strongest = Window.partitionBy("seed").orderBy(F.desc("confidence"), "relation", "neighbor", "direction")
    edges = edges.withColumn("__n", F.row_number().over(strongest)).where(F.col("__n") <= breadth)
    best = Window.partitionBy("seed", "relation", "neighbor").orderBy(F.desc("confidence"), F.desc("seed_score"), "__n")
    edges = edges.withColumn("__m", F.row_number().over(best)).where("__m = 1").drop("__n", "__m")
    order = [F.desc("confidence"), F.desc("seed_score"), F.col("neighbor"), F.col("seed"), F.col("relation")]
    top = edges.orderBy(*order).limit(top_k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top_k rows
    if ledger is None:
        return ranked.select("rank", "seed", "relation", "neighbor", "confidence", "seed_score", "scope_conditions")
    rows = ledger.join(F.broadcast(ranked.select(*TRIPLE).distinct()), list(TRIPLE), "left_semi")  # at most top_k triples
    columns = provenance_columns(ranked)
    own = [c for c in columns if not isinstance(c, str)]
    return ranked.join(row_provenance(rows), list(TRIPLE), "left").select("rank", "seed", "relation", "neighbor", "confidence", "seed_score", "scope_conditions", *own)


def seed_states(seeds: DataFrame, current: DataFrame) -> DataFrame:
    """The current states of the seeds, with a sentence each."""
    joined = seeds.select("name", "type").join(current, (F.col("name") == F.col("entity")) & (F.col("type") == F.col("entity_type")))
    return joined.select("name", "type", "state_key", "value", "unit", "as_of", "confidence", "source_ref", state_claim("name", "state_key", "value").alias("claim")).orderBy("name", "type", "state_key")


def render_markdown(rows: list, notice: str | None = None) -> str:
    """Directions (collected, top_k at most) as a list."""
    lines = [f"> {notice}"] if notice else []
    lines += [f"{r['rank']}. {r['seed']} -[{r['relation']} {r['confidence']:.2f}]- {r['neighbor']}" + (f" ({r['scope_conditions']})" if r["scope_conditions"] else "") for r in rows]
    return "\n".join(lines or ["no directions"])


def strongest_edges(arrows: DataFrame, preference: tuple[str, ...] = ()) -> DataFrame:
    """node, edge (all columns of the arrow): the outgoing edge of each subject with the highest confidence, then by preferred relation and object."""
    order = F.coalesce(*[F.when(F.col("relation") == r, F.lit(i)) for i, r in enumerate(preference)], F.lit(len(preference)))
    best = F.min_by(F.struct(*arrows.columns), F.struct((-F.col("confidence")).alias("c"), order.alias("o"), "object"))
    return arrows.groupBy(F.col("subject").alias("node")).agg(best.alias("edge"))


def _joined(left: DataFrame, step: DataFrame) -> DataFrame:
    """Paths of ``left`` (node, path, end) with what ``step`` adds at their ends, up to the first node that a path meets again."""
    more = step.select(F.col("node").alias("end"), F.col("path").alias("__more"), F.col("end").alias("__end"))
    both = left.join(more, "end", "left").withColumn("__all", F.when(F.col("__more").isNull(), F.col("path")).otherwise(F.concat("path", "__more")))
    nodes = F.concat(F.array("node"), F.transform("__all", lambda e: e["object"]))
    both = both.withColumn("__nodes", nodes)
    # A node has one strongest edge, so from a node met again on everything repeats.
    first = F.filter("__all", lambda e, i: F.array_position("__nodes", e["object"]) == i + 2)
    cut = F.size("__first") < F.size("__all")
    return both.withColumn("__first", first).select("node", F.col("__first").alias("path"), F.when(~cut, F.col("__end")).alias("end"))


def strongest_paths(arrows: DataFrame, hops: int, preference: tuple[str, ...] = (), starts: DataFrame | None = None) -> DataFrame:
    """start, hop (from 1), the columns of the arrow taken, and path_confidence, the least of the path, for every start that has an edge.

    Pointer doubling: paths of 1, 2, 4, ... edges from every node are joined from
    paths half as long, and those that make up ``hops`` are joined in turn, so
    the plan has about 2 log2(hops) joins for all starts at once. A path is an
    array of ``hops`` edges at most and ends at a node seen before. starts: only
    these (column start).
    """
    left = positive(hops, "hops")
    best = strongest_edges(arrows, preference)
    once = best.select("node", F.array("edge").alias("path"), F.col("edge.object").alias("end"))
    none = F.slice("path", 1, 0)
    step = once.where(F.col("node") != F.col("end"))  # a self loop leads nowhere
    found = step.select("node", none.alias("path"), F.col("node").alias("end"))
    if starts is not None:
        found = found.join(starts.select(F.col("start").alias("node")).distinct(), "node", "left_semi")
    while left:
        if left & 1:
            found = _joined(found, step)
        left >>= 1
        if left:
            step = _joined(step, step)
    least = F.array_min(F.transform("path", lambda e: e["confidence"]))
    rows = found.select(F.col("node").alias("start"), least.alias("path_confidence"), F.posexplode("path").alias("hop", "edge"))
    return rows.select("start", (F.col("hop") + 1).alias("hop"), "edge.*", "path_confidence")


def follow_path(arrows: DataFrame, start: str, hops: int, preference: tuple[str, ...] = ()) -> list[dict]:
    """The strongest outgoing edge, hop by hop, from one start: at most ``hops`` rows, by one plan; ends at a node seen before."""
    at = arrows.sparkSession.createDataFrame([(start,)], "start string")
    rows = strongest_paths(arrows, hops, preference, at).orderBy("hop").collect()
    return [{c: r[c] for c in arrows.columns} for r in rows]


def path_confidence(path: list[dict]) -> float | None:
    return min((p["confidence"] for p in path), default=None)
