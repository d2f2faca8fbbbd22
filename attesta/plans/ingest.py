"""The write path: chunks, scan, extraction, guards, gates, resolution, delta, review and commit.

Every model is an injected callable. Stages that call one are written to the
work folder before they are used, so a lost task can't ask the model again and
get another answer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import source_id
from attesta.operators import contracts, dispatch, factcheck, guards, ledger, novelty, resolution, states
from attesta.operators.canonical import canonicalize_triples, with_canonical
from attesta.operators.numbering import numbered
from attesta.plans.scan import Cluster, Inventory, anchor_entities, anchor_verbs, render_roster, scan, scan_pass, verb_menu  # noqa: F401  parts of the write path
from attesta.schemas import TRIPLE, TRIPLES
from attesta.schemas import STATES as STATE_SCHEMA
from attesta.store import Store

#: chunk {chunk_id, text, source_ref, section_path, and after a scan verb_menu, entity_roster} -> [(tool, arguments)], tools propose_triple and propose_state.
Extract = Callable[[dict], list[tuple[str, dict]]]
TOOLS = ("propose_triple", "propose_state")


def prompt(chunk: dict, roster: str = "", verbs: str = "") -> str:
    """What extraction is asked about a chunk, with the roster and menu of its source's scan unless others are given."""

    def hint(name: str, sep: str) -> str:
        found = chunk.get(name)
        return sep.join(found) if found is not None else ""

    path = " > ".join(chunk.get("section_path") if chunk.get("section_path") is not None else [])
    roster, verbs = roster or hint("entity_roster", "; "), verbs or hint("verb_menu", ", ")
    parts = [f"source_ref: {chunk['source_ref']}", f"section: {path}" if path else "", f"known entities: {roster}" if roster else "", f"relations: {verbs}" if verbs else "", chunk["text"]]
    return "\n".join(p for p in parts if p)


def extract(chunks: DataFrame, model: Extract) -> DataFrame:
    """chunk_id, source_id, ordinal, pos, tool, arguments (JSON): one model call per chunk, in chunk order within a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for c in part.to_dict("records"):
                for pos, (tool, arguments) in enumerate(model(c)):
                    if tool not in TOOLS:
                        continue
                    body = json.dumps(arguments) if isinstance(arguments, dict) else None
                    out.append((c["chunk_id"], c["source_id"], c["ordinal"], pos, tool, body))
            yield pd.DataFrame(out, columns=["chunk_id", "source_id", "ordinal", "pos", "tool", "arguments"])

    hints = [c for c in ("verb_menu", "entity_roster") if c in chunks.columns]
    return chunks.select("source_id", "ordinal", "chunk_id", "text", "section_path", "source_ref", *hints).mapInPandas(run, "chunk_id string, source_id string, ordinal int, pos int, tool string, arguments string")


@dataclass
class Extraction:
    triples: DataFrame
    states: DataFrame
    rejected: DataFrame


def validate(calls: DataFrame, chunks: DataFrame) -> Extraction:
    """Contracts and grounding: valid triples and states with ``seq`` in call order, everything else rejected."""
    keys = ["source_id", "chunk_id", "ordinal", "pos"]
    order = Window.partitionBy("source_id").orderBy("ordinal", "pos")
    numbered = calls.withColumn("seq", F.row_number().over(order).cast("long"))
    refs = chunks.select("source_id", "chunk_id", F.col("source_ref").alias("__ref"))

    def side(tool: str, schema, check) -> tuple[DataFrame, DataFrame]:
        rows = numbered.where(F.col("tool") == tool).withColumn("a", F.from_json("arguments", schema)).select(*keys, "seq", "a.*").join(refs, ["source_id", "chunk_id"], "left")
        checked = check(rows)
        wrong = F.when(~F.coalesce(F.col("source_ref") == F.col("__ref"), F.lit(False)), F.array(F.lit("source_ref must be that of the chunk"))).otherwise(F.array().cast("array<string>"))
        return contracts.split_valid(checked.withColumn("failures", F.concat("failures", wrong)).drop("__ref"))

    triples, bad_triples = side("propose_triple", TRIPLES, contracts.check_triples)
    measured, bad_states = side("propose_state", STATE_SCHEMA, contracts.check_states)
    return Extraction(triples, measured, bad_triples.unionByName(bad_states))


@dataclass
class Models:
    extract: Extract
    decide: dispatch.Decide | None = None
    classify: novelty.Classifier | None = None
    embed: resolution.Embedder | None = None
    inventory: Inventory | None = None
    cluster: Cluster | None = None


@dataclass
class Delta:
    """What an ingest proposes. Nothing is written before it is approved."""

    new_edges: DataFrame
    changed_edges: DataFrame
    entities: DataFrame
    candidates: DataFrame
    states: DataFrame
    rejected: DataFrame
    aliases: DataFrame
    ambiguous: DataFrame
    stats: dict[str, int] = field(default_factory=dict)
    embed: resolution.Embedder | None = None
    work: str = ""
    #: What the scan pass offered and the verbs that it found new; None without one.
    hints: DataFrame | None = None
    staged: DataFrame | None = None


def _candidates_with_names(triples: DataFrame, resolved: DataFrame) -> DataFrame:
    """Endpoints replaced by their canonical names; ambiguous ones stand for themselves."""
    names = resolved.select(F.col("session").alias("__s"), F.col("seq").alias("__q"), F.coalesce("canonical", "mention").alias("__n"))
    for offset, side in ((0, "subject"), (1, "object")):
        triples = triples.join(names.withColumnsRenamed({"__n": f"__{side}"}), (F.col("source_id") == F.col("__s")) & (2 * F.col("seq") + offset == F.col("__q")), "left").drop("__s", "__q")
        triples = triples.withColumn(side, F.coalesce(f"__{side}", side)).drop(f"__{side}")
    return triples


def propose(spark: SparkSession, chunks: DataFrame, tables: dict[str, DataFrame], registry: DataFrame, models: Models, work: str) -> Delta:
    """All stages up to review; each run writes to a folder of its own in ``work``."""
    work = f"{work.rstrip('/')}/{uuid.uuid4().hex}"

    def once(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    chunks = once(chunks, "chunks")
    offered, hints, staged = chunks, None, None
    if models.inventory:
        embed = resolution.embedding_udf(models.embed)("mention") if models.embed else None
        scanned = scan_pass(chunks, tables["entities"], tables["arrows"], registry, models.inventory, once, models.cluster, embed)
        hints, staged = scanned.hints, scanned.staged
        offered = once(chunks.join(hints.select("source_id", "verb_menu", render_roster("entity_roster").alias("entity_roster")), "source_id", "left"), "offered")
    calls = once(extract(offered, models.extract), "calls")
    found = validate(calls, chunks)
    guarded = guards.classify(found.triples)
    clean, flagged = guarded.where("primary_class IS NULL"), guarded.where("primary_class IS NOT NULL")
    own = [*TRIPLES.fieldNames(), "source_id", "seq"]
    triples, measured, rejected = (clean if models.decide else guarded).select(*own), found.states, found.rejected
    if models.decide:  # without a decision model nothing is reshaped, so flagged candidates go on as they are
        decided = once(dispatch.decide(dispatch.with_chunk(flagged, chunks), models.decide), "decisions")
        done = dispatch.execute(decided)
        last = F.lit(1 << 30)  # repaired candidates come after the extracted ones
        order = Window.partitionBy("source_id").orderBy(*TRIPLE)
        src = F.substring_index("source_ref", ":", 1)
        repaired = done.triples.withColumn("source_id", src).withColumn("seq", (last + F.row_number().over(order)).cast("long"))
        triples = triples.unionByName(repaired.select(*own))
        extra = done.states.withColumn("source_id", src)
        measured = measured.unionByName(extra.withColumn("seq", (last + F.row_number().over(Window.partitionBy("source_id").orderBy("entity", "state_key", "value"))).cast("long")), allowMissingColumns=True)
        rejected = rejected.unionByName(done.rejected)
    if models.classify:
        for state in (False, True):
            rows = novelty.with_claims(measured if state else triples, state)
            verdicts = once(novelty.classify(novelty.unique_claims(rows), models.classify), f"novelty-{'states' if state else 'triples'}")
            kept = novelty.gate(rows, verdicts).drop("claim")
            triples, measured = (triples, kept) if state else (kept, measured)
    triples = once(triples, "triples")
    measured = once(measured, "states")

    # Resolution: subject before object, in candidate order, types canonical.
    ends = triples.select(
        F.col("source_id").alias("session"),
        F.explode(F.array(F.struct((2 * F.col("seq")).alias("seq"), F.col("subject").alias("mention"), F.col("subject_type").alias("type")), F.struct((2 * F.col("seq") + 1).alias("seq"), F.col("object").alias("mention"), F.col("object_type").alias("type")))).alias("m"),
    ).select("session", "m.seq", "m.mention", "m.type")
    typed = with_canonical(ends, registry, "entity_type", "type")
    vector = resolution.embedding_udf(models.embed)("mention") if models.embed else F.lit(None).cast("array<double>")
    mentions = once(typed.withColumn("embedding", vector).select("session", "type", "seq", "mention", "embedding"), "mentions")
    resolved = once(resolution.resolve(mentions, tables["entities"]), "resolutions")

    named = canonicalize_triples(_candidates_with_names(triples, resolved), registry)
    domains = with_canonical(named.withColumn("domain", F.coalesce("domain", F.lit(""))), registry, "domain", "domain")
    candidates = once(domains.drop("domain_known", "relation_known", "flipped"), "candidates")
    edges = candidates.withColumn("evidence", F.array("evidence"))
    new, changed = ledger.assemble_delta(edges, tables["arrows"])
    return Delta(new, changed, created_entities(resolved, mentions), candidates, measured, rejected, resolution.alias_deltas(resolved), resolution.ambiguities(resolved), embed=models.embed, work=work, hints=hints, staged=staged)


def created_entities(resolved: DataFrame, mentions: DataFrame) -> DataFrame:
    """name, type, no aliases and the vector of the first mention that created it; queued mentions stand for themselves, without one."""
    own = mentions.select("session", "seq", F.col("embedding").cast("array<double>").alias("__own"))
    rows = resolved.where("outcome <> 'resolve'").join(own, ["session", "seq"], "left").withColumn("__vector", F.when(F.col("outcome") == "create", F.col("__own")))
    first = F.min_by("__vector", F.struct(F.col("__vector").isNull(), "session", "seq"))
    found = rows.groupBy(F.coalesce("canonical", "mention").alias("name"), "type").agg(first.alias("embedding"))
    return found.select("name", "type", F.array().cast("array<string>").alias("aliases"), "embedding")


def edit_confidence(delta: Delta, triple: tuple[str, str, str], confidence: float) -> Delta:
    """The reviewer's value for one new edge; its raw candidates collapse to the first one, with that value."""
    if not 0 <= confidence <= 1:
        raise ValueError("confidence must be in [0, 1]")
    hit = F.lit(True)
    for c, v in zip(TRIPLE, triple, strict=True):
        hit = hit & (F.col(c) == v)
    w = Window.partitionBy(*TRIPLE).orderBy("source_id", "seq")
    rows = delta.candidates.withColumn("__hit", hit).withColumn("__rn", F.row_number().over(w)).where("NOT __hit OR __rn = 1")
    delta.candidates = rows.withColumn("confidence", F.when(F.col("__hit"), F.lit(confidence)).otherwise(F.col("confidence"))).drop("__hit", "__rn")
    delta.new_edges = delta.new_edges.withColumn("confidence", F.when(hit, F.lit(confidence)).otherwise(F.col("confidence")))
    return delta


def first_new_edge(delta: Delta) -> tuple[str, str, str] | None:
    """The triple of the earliest candidate that makes a new edge."""
    row = delta.candidates.join(delta.new_edges.select(*TRIPLE), list(TRIPLE), "left_semi").orderBy("source_id", "seq").select(*TRIPLE).first()
    return None if row is None else tuple(row)


def review(delta: Delta, ask: Callable[[str], str | None]) -> tuple[str, Delta]:
    """(approve or reject, the delta as edited): asks until it is decided; closed input (None, or an end of file) rejects."""
    try:
        while (answer := ask("approve, reject or edit the first new edge's confidence? ")) is not None:
            answer = answer.strip().lower()
            if answer in ("a", "approve"):
                return "approve", delta
            if answer in ("r", "reject"):
                return "reject", delta
            if answer in ("e", "edit") and (edge := first_new_edge(delta)):
                value = ask(f"new confidence of {' '.join(edge)} (0.0 to 1.0): ")
                try:
                    delta = edit_confidence(delta, edge, float(value))
                except (TypeError, ValueError):
                    continue  # no number, or outside the range: ask again
    except EOFError:
        pass
    return "reject", delta


def rejection_records(delta: Delta, reason: str = "rejected in review") -> DataFrame:
    """Every candidate of a rejected delta as a record."""
    body = F.to_json(F.struct(*[c for c in delta.candidates.columns]))
    null = F.lit(None).cast("string")
    return delta.candidates.select(body.alias("candidate"), "source_ref", "evidence", "scope_conditions", F.lit("rejected").alias("decision"), F.lit(reason).alias("reason"), null.alias("verdict"), null.alias("guard_class"), F.lit("review").alias("step"))


def _with_vectors(delta: Delta, rows: DataFrame, wanted: Column, name: str) -> DataFrame:
    """``rows`` with evidence_embedding where there is evidence and the row is wanted (null if the embedder fails); written before it is used twice."""
    if delta.embed is None:
        return rows
    text = F.when(wanted & (F.coalesce("evidence", F.lit("")) != ""), F.col("evidence"))
    out = rows.withColumn("evidence_embedding", resolution.embedding_udf(delta.embed)(text))
    out.write.mode("overwrite").parquet(f"{delta.work}/{name}")
    return rows.sparkSession.read.schema(out.schema).parquet(f"{delta.work}/{name}")


def _with_sources(rows: DataFrame) -> DataFrame:
    """``rows`` with the source of each reference; one outside the grammar is an error, so that nothing of the delta is written."""
    own = F.when(F.coalesce("source_ref", F.lit("")) != "", source_id("source_ref"))
    checked = rows.where(F.coalesce(own, F.lit("")) >= "")  # a filter, which also rows that keep no source_id go through
    return checked.withColumn("source_id", F.coalesce(own, F.col("source_id")))


def _with_state_entities(delta: Delta, entities: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The states under the names that their entities resolve to, and the entities to create (None without states).

    States come after the triples: their entities resolve, in a session per source, against ``entities``, which
    holds what the triples made. An ambiguous one stands for itself.
    """
    if delta.states.isEmpty():
        return delta.states, None
    vector = resolution.embedding_udf(delta.embed)("entity") if delta.embed else F.lit(None).cast("array<double>")
    typed = with_canonical(delta.states, registry, "entity_type", "entity_type")
    mentions = typed.select(F.col("source_id").alias("session"), F.col("entity_type").alias("type"), "seq", F.col("entity").alias("mention"), vector.alias("embedding"))
    mentions.write.mode("overwrite").parquet(f"{delta.work}/state-mentions")
    mentions = delta.states.sparkSession.read.schema(mentions.schema).parquet(f"{delta.work}/state-mentions")
    resolution.resolve(mentions, entities).write.mode("overwrite").parquet(f"{delta.work}/state-resolutions")
    resolved = delta.states.sparkSession.read.schema(resolution.RESULT).parquet(f"{delta.work}/state-resolutions")
    names = resolved.select(F.col("session").alias("__s"), F.col("seq").alias("__q"), F.coalesce("canonical", "mention").alias("__n"))
    rows = delta.states.join(names, F.col("source_id").eqNullSafe(F.col("__s")) & (F.col("seq") == F.col("__q")), "left")
    return rows.withColumn("entity", F.coalesce("__n", "entity")).drop("__s", "__q", "__n"), created_entities(resolved, mentions)


def commit(store: Store, delta: Delta, registry: DataFrame, now: Column, mode: str = "keep-first") -> dict[str, int]:
    """One snapshot of everything the delta touches; returns counts of what it did."""
    stored = store.table("ledger")
    top = stored.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = numbered(_with_sources(delta.candidates), ["source_id", "seq"]).withColumn("seq", F.lit(top) + F.col("seq"))
    plan = _with_vectors(delta, ledger.plan_writes(stored, rows, mode), F.col("action") != "skip", "planned-rows")
    after = ledger.apply_plan(stored, plan, now)
    arrows = ledger.merge_arrows(store.table("arrows"), ledger.planned_arrows(stored, plan), now)
    measured = store.table("state_events")
    top_state = measured.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    aliases = delta.aliases.withColumn("embedding", F.lit(None).cast("array<double>"))
    entities = resolution.upsert_entities(store.table("entities"), delta.entities.unionByName(aliases), now)
    measured_rows, people = _with_state_entities(delta, entities, registry)
    in_order = numbered(_with_sources(measured_rows), ["source_id", "seq"]).withColumn("seq", F.lit(top_state) + F.col("seq"))
    states_after, _ = states.upsert_states(measured, _with_vectors(delta, in_order, F.lit(True), "measured-rows"), registry, now)
    if people is not None:
        entities = resolution.upsert_entities(entities, people, now)
    found = after.where("coalesce(source_ref, '') <> ''").groupBy(F.col("source_id").alias("id")).agg(F.min("created_at").alias("first_seen")).where("id IS NOT NULL")
    sources = store.table("sources").unionByName(found.join(store.table("sources").select("id"), "id", "left_anti"))
    counts = {r.action: r.n for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    store.commit({"ledger": after, "arrows": arrows, "state_events": states_after, "entities": entities, "sources": sources, "rejected": store.table("rejected").unionByName(delta.rejected)})
    return {"rows_created": counts.get("create", 0), "rows_updated": counts.get("update", 0), "rows_skipped": counts.get("skip", 0)}


def review_and_commit(store: Store, delta: Delta, decision: str, registry: DataFrame, now: Column, mode: str = "keep-first") -> dict[str, int]:
    """approve or reject; only an explicit approval writes to the graph."""
    if decision == "approve":
        return commit(store, delta, registry, now, mode)
    if decision == "reject":
        store.append("rejected", rejection_records(delta).unionByName(delta.rejected))
        return {"rows_created": 0, "rows_updated": 0, "rows_skipped": 0}
    raise ValueError("decision must be approve or reject")


def statistics(delta: Delta) -> DataFrame:
    """One row of counts for the transcript of a run."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(delta.candidates, "candidates")
    for name in ("new_edges", "changed_edges", "entities", "states", "rejected", "ambiguous"):
        out = out.crossJoin(one(getattr(delta, name), name))  # single rows
    calls = (F.lit(0).alias("scan_calls"), F.lit(0).alias("cluster_calls"))
    if delta.hints is None:
        return out.select("*", *calls)
    return out.crossJoin(delta.hints.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scan_calls", "cluster_calls")]))


def advisory(store_before: DataFrame, delta: Delta) -> str | None:
    return factcheck.notice(delta.candidates, store_before)


