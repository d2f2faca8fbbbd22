"""Repair of flagged candidates: one decision per candidate (an injected model), executed by JVM expressions.

A decision is (choice, payload JSON). Executors turn candidates into four
sets: triples that go on, extra states, flags for review, and rejected records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import ensure_scope, extend_scope, flag_note
from attesta.operators.contracts import check_states, check_triples

# The steps that each guard class may take, and the payload keys that a step needs.
MENUS = {
    "numeric_endpoint": ("to_state", "pass_flagged", "drop_noise"),
    "qualitative_endpoint": ("to_state", "to_scope", "drop_noise"),
    "clause": ("decompose", "to_state", "drop_noise"),
    "list": ("decompose_per_member", "joint_with_scope", "drop_noise"),
    "compound_actor": ("pairwise_joint_edge", "named_group", "decompose", "drop_noise"),
    "deictic": ("to_source", "pass_flagged", "drop_noise"),
    "self_loop": ("missing_endpoint", "reflexive_state", "drop_noise"),
    "description_in_name": ("normalize_name", "pass_flagged"),
}
REQUIRED = {
    "to_state": ("entity", "state_key", "value", "as_of"), "reflexive_state": ("entity", "state_key", "value", "as_of"), "to_scope": ("scope",),
    "decompose": ("triples",), "decompose_per_member": ("triples",), "pairwise_joint_edge": ("edges",), "joint_with_scope": ("edges", "scope_conditions"),
    "named_group": ("group_name",), "normalize_name": ("name",), "missing_endpoint": ("endpoint",), "to_source": ("note",),
}
STATES, MEMBERS = ("to_state", "reflexive_state"), ("decompose", "decompose_per_member", "pairwise_joint_edge", "joint_with_scope")
FLAGS, DROPS = ("to_source", "pass_flagged"), ("drop_noise", "unknown")

_MEMBER = "struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,scope_conditions:string>"
PAYLOAD = (
    f"entity string, entity_type string, state_key string, value string, unit string, as_of string, scope string, triples array<{_MEMBER}>, edges array<{_MEMBER}>, "
    "scope_conditions string, group_name string, group_type string, name string, qualifier string, endpoint string, endpoint_type string, note string"
)

#: (candidate as dict, guard class, chunk text) -> (choice, payload JSON); an exception aborts the run.
Decide = Callable[[dict, str, str], tuple[str, str]]


@dataclass
class Dispatched:
    triples: DataFrame
    states: DataFrame
    flagged: DataFrame
    rejected: DataFrame


def with_chunk(flagged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds chunk_text by source_ref; a candidate without its chunk is an error."""
    text = chunks.select(F.col("source_ref").alias("__ref"), F.col("text").alias("chunk_text"))
    joined = flagged.join(text, F.col("source_ref") == F.col("__ref"), "left")
    missing = F.raise_error(F.concat(F.lit("no chunk for "), F.coalesce("source_ref", F.lit("null")))).cast("string")
    return joined.withColumn("chunk_text", F.when(F.col("__ref").isNotNull(), F.col("chunk_text")).otherwise(missing)).drop("__ref")


def decide(flagged: DataFrame, model: Decide) -> DataFrame:
    """Adds choice and payload. An answer off the menu of the primary class aborts. Write the result once before using it twice."""
    body = [c for c in flagged.columns if c not in ("chunk_text", "guard_classes")]

    @F.pandas_udf("choice string, payload string")
    def ask(candidate: pd.Series, guard: pd.Series, text: pd.Series) -> pd.DataFrame:
        import json

        out = []
        for c, g, t in zip(candidate, guard, text, strict=True):
            choice, payload = model(json.loads(c), g, t)
            if choice not in (*MENUS[g], "unknown"):
                raise ValueError(f"{choice!r} is not on the menu of {g}")
            out.append((choice, payload))
        return pd.DataFrame(out, columns=["choice", "payload"])

    return flagged.withColumn("__d", ask.asNondeterministic()(F.to_json(F.struct(*body)), "primary_class", "chunk_text")).select("*", "__d.choice", "__d.payload").drop("__d")


def _missing(p: Column) -> Column:
    """Is a needed key of the chosen step absent? Empty lists count as absent."""
    out = F.lit(False)
    for step, keys in REQUIRED.items():
        absent = F.lit(False)
        for k in keys:
            absent = absent | (p[k].isNull() if k not in ("triples", "edges") else F.coalesce(F.size(p[k]), F.lit(0)) < 1)
        out = F.when(F.col("choice") == step, absent).otherwise(out)
    return out


def _record(candidate: Column, decision: str, reason: Column, verdict: Column, step: Column) -> list[Column]:
    return [
        candidate.alias("candidate"), F.col("source_ref"), F.col("evidence"), F.col("scope_conditions"), F.lit(decision).alias("decision"), reason.alias("reason"),
        verdict.alias("verdict"), F.col("primary_class").alias("guard_class"), step.alias("step"),
    ]


def execute(decided: DataFrame) -> Dispatched:
    """Run the chosen steps. Columns of a triple: subject, types, relation, object, confidence, evidence, scope_conditions, source_ref, domain."""
    fields = ("subject", "subject_type", "relation", "object", "object_type", "confidence", "evidence", "scope_conditions", "source_ref", "domain")
    rows = decided if "domain" in decided.columns else decided.withColumn("domain", F.lit(None).cast("string"))
    rows = rows.withColumn("p", F.coalesce(F.from_json("payload", PAYLOAD), F.from_json(F.lit("{}"), PAYLOAD)))
    rows = rows.withColumn("__bad", _missing(F.col("p"))).withColumn("__json", F.to_json(F.struct(*fields)))
    bad = rows.where("__bad")
    ok = rows.where("NOT __bad")
    step = F.col("choice")

    # Members of a decomposition share the candidate's evidence, confidence and reference.
    members = ok.where(step.isin(*MEMBERS)).withColumn("m", F.explode(F.when(step.isin("pairwise_joint_edge", "joint_with_scope"), F.col("p.edges")).otherwise(F.col("p.triples"))))
    scope = F.when(step == "joint_with_scope", F.col("p.scope_conditions")).otherwise(F.coalesce("m.scope_conditions", "scope_conditions"))
    members = members.withColumns(
        {
            "subject_type": F.coalesce("m.subject_type", "subject_type"), "object_type": F.coalesce("m.object_type", "object_type"),
            "relation": F.coalesce("m.relation", "relation"), "subject": F.col("m.subject"), "object": F.col("m.object"), "scope_conditions": ensure_scope(scope),
        }
    )
    checked = check_triples(members)
    good_members, bad_members = checked.where("size(failures) = 0"), checked.where("size(failures) > 0")

    # Steps that change one endpoint or the scope.
    at_subject = F.col("flagged_endpoint") == "subject"
    name = F.when(step == "named_group", F.col("p.group_name")).when(step == "normalize_name", F.col("p.name"))
    kind = F.when(step == "named_group", F.col("p.group_type"))
    single = ok.where(step.isin("to_scope", "named_group", "normalize_name", "missing_endpoint"))
    more = F.when(step == "to_scope", F.col("p.scope")).when(step == "normalize_name", F.col("p.qualifier"))
    single = single.withColumns(
        {
            "subject": F.when(name.isNotNull() & at_subject, name).otherwise(F.col("subject")),
            "subject_type": F.when(kind.isNotNull() & at_subject, kind).otherwise(F.col("subject_type")),
            "object": F.when(step == "missing_endpoint", F.col("p.endpoint")).when(name.isNotNull() & ~at_subject, name).otherwise(F.col("object")),
            "object_type": F.when(step == "missing_endpoint", F.coalesce("p.endpoint_type", "object_type")).when(kind.isNotNull() & ~at_subject, kind).otherwise(F.col("object_type")),
            "scope_conditions": ensure_scope(extend_scope("scope_conditions", more)),
        }
    )
    triples = good_members.select(*fields).unionByName(single.select(*fields))

    states = ok.where(step.isin(*STATES)).select(
        F.col("p.entity").alias("entity"), F.coalesce("p.entity_type", F.when(at_subject, F.col("object_type")).otherwise(F.col("subject_type"))).alias("entity_type"), "p.state_key", "p.value",
        F.coalesce("p.unit", F.lit("")).alias("unit"), "p.as_of", "confidence", "evidence", "scope_conditions", "source_ref", "primary_class", "choice", "__json",
    )
    checked_states = check_states(states)
    good_states = checked_states.where("size(failures) = 0")

    flagged = ok.where(step.isin(*FLAGS)).select(*fields, "primary_class", "choice", F.coalesce("p.note", flag_note("subject", "relation", "object", "evidence", "choice", "primary_class")).alias("note"))
    invalid = F.lit("invalid_payload")
    rejected = bad.select(*_record(F.col("__json"), "rejected", F.concat(F.lit("payload lacks what the step needs: "), step), invalid, step))
    rejected = rejected.unionByName(bad_members.select(*_record(F.to_json("m"), "rejected", F.array_join("failures", "; "), invalid, step)))
    rejected = rejected.unionByName(checked_states.where("size(failures) > 0").select(*_record(F.col("__json"), "rejected", F.array_join("failures", "; "), invalid, step)))
    rejected = rejected.unionByName(ok.where(step.isin(*DROPS)).select(*_record(F.col("__json"), "dropped", F.lit("not knowledge"), F.lit("noise"), step)))
    rejected = rejected.unionByName(ok.where(step == "pass_flagged").select(*_record(F.col("__json"), "flagged", F.lit("held for review"), F.lit("flagged"), step)))
    body = ("entity", "entity_type", "state_key", "value", "unit", "as_of", "confidence", "evidence", "scope_conditions", "source_ref")
    return Dispatched(triples, good_states.select(*body), flagged, rejected)


def counters(decided: DataFrame, bypassed: DataFrame) -> DataFrame:
    """step, n: decisions per step, with those that needed none under ``bypassed``."""
    return decided.groupBy(F.col("choice").alias("step")).agg(F.count("*").alias("n")).unionByName(bypassed.agg(F.count("*").alias("n")).select(F.lit("bypassed").alias("step"), "n"))
