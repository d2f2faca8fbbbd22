"""The scan pass before extraction: what verbs and names of a source the graph knows already, and one call that groups the rest.

A model lists the verbs and names of each batch of chunks. Verbs anchor in the
registry, then in the relations of the graph; names in the entities, by the
resolver. What a source has left goes into one clustering call, which a source
with nothing left doesn't make. A source's remainder is smaller than its text.

Menus and rosters are offered to extraction; nothing is written to the graph,
and an answer that isn't one ends the ingest before anything is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import fold, normalize_verb
from attesta.operators import resolution
from attesta.operators.canonical import with_canonical
from attesta.operators.walks import batches
from attesta.sources.chunking import batch_text

#: batch text -> {"verbs": [...], "entities": [{"name", "type"}]}
Inventory = Callable[[str], dict]
#: unmatched verbs, unmatched entities {"name", "type"} -> {"verbs": [{"canonical", "aliases"}], "entities": [{"canonical", "entity_type", "aliases"}]}
Cluster = Callable[[list[str], list[dict]], dict]
#: A table written under a name and read back, so that no model is asked twice.
Once = Callable[[DataFrame, str], DataFrame]

TYPE = "concept"
_GROUPS = "verbs array<struct<canonical:string,aliases:array<string>>>, entities array<struct<canonical:string,entity_type:string,aliases:array<string>>>"


def _answer(found, what: str) -> Mapping:
    if not isinstance(found, Mapping):
        raise ValueError(f"the {what} call gave no answer")
    return found


def _typed(column: str) -> Column:
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(TYPE))


def scan(chunks: DataFrame, inventory: Inventory, size: int = 4) -> DataFrame:
    """source_id, batch, verbs, entities by one model call per batch of chunks."""
    texts = batch_text(batches(chunks, size))

    @F.pandas_udf("verbs array<string>, entities array<struct<name:string,type:string>>")
    def ask(text: pd.Series) -> pd.DataFrame:
        found = [_answer(inventory(t), "scan") for t in text]
        return pd.DataFrame({"verbs": [f.get("verbs") or [] for f in found], "entities": [f.get("entities") or [] for f in found]})

    return texts.withColumn("__i", ask.asNondeterministic()("text")).select("source_id", "batch", "__i.verbs", "__i.entities")


def _anchored(verbs: DataFrame, registry: DataFrame, live: DataFrame) -> DataFrame:
    """``verbs`` (verb and any other columns) with anchor and origin: the registry first, then relations of the graph, else unmatched."""
    known = registry.where("kind = 'relation'").select(F.col("label").alias("verb"), "canonical")
    used = live.select(normalize_verb("relation").alias("verb"), normalize_verb("relation").alias("__live")).distinct()
    joined = verbs.join(known, "verb", "left").join(used, "verb", "left")
    origin = F.when(F.col("canonical").isNotNull(), "registry").when(F.col("__live").isNotNull(), "graph").otherwise("unmatched")
    return joined.select(*verbs.columns, F.coalesce("canonical", "__live").alias("anchor"), origin.alias("origin"))


def source_verbs(inventory: DataFrame, registry: DataFrame, live: DataFrame) -> DataFrame:
    """source_id, raw, verb, anchor, origin for every spelling of a source."""
    verbs = inventory.select("source_id", F.explode("verbs").alias("raw")).select("source_id", "raw", normalize_verb("raw").alias("verb")).where("verb <> 'unknown'").distinct()
    return _anchored(verbs, registry, live)


def anchor_verbs(inventory: DataFrame, registry: DataFrame, live: DataFrame) -> DataFrame:
    """verb, anchor, origin over all rows of an inventory (verbs), whatever their source."""
    verbs = inventory.select(F.explode("verbs").alias("raw")).select(normalize_verb("raw").alias("verb")).where("verb <> 'unknown'").distinct()
    return _anchored(verbs, registry, live)


def verb_menu(anchored: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """The distinct verbs that extraction is offered: anchors and, for the unmatched, one cluster name each (verb, cluster)."""
    menu = anchored.where("anchor IS NOT NULL").select(F.col("anchor").alias("verb"))
    if clustered is not None:
        menu = menu.unionByName(clustered.select(F.col("cluster").alias("verb")))
    return menu.distinct().orderBy("verb")


def resolve_names(inventory: DataFrame, entities: DataFrame, registry: DataFrame, embed: Column | None = None) -> DataFrame:
    """The resolver's result for every name of the inventory, a session per source, in order of batches; nothing is written."""
    found = inventory.select("source_id", "batch", F.posexplode("entities").alias("pos", "e")).select("source_id", "batch", "pos", F.trim("e.name").alias("mention"), _typed("e.type").alias("type")).where("mention <> ''")
    typed = with_canonical(found, registry, "entity_type", "type")
    w = Window.partitionBy("source_id").orderBy("batch", "pos")
    vector = embed if embed is not None else F.lit(None).cast("array<double>")
    mentions = typed.withColumn("seq", F.row_number().over(w).cast("long")).select(F.col("source_id").alias("session"), "type", "seq", "mention", vector.alias("embedding"))
    return resolution.resolve(mentions, entities)


def anchor_entities(inventory: DataFrame, entities: DataFrame, registry: DataFrame, embed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(roster with one row per canonical entity, alias deltas): mentions go through the resolver, nothing is written."""
    resolved = resolve_names(inventory, entities, registry, embed)
    roster = resolved.select(F.coalesce("canonical", "mention").alias("name"), "type", "outcome").groupBy("name", "type").agg(F.min("outcome").alias("outcome")).orderBy("name", "type")
    return roster, resolution.alias_deltas(resolved)


def remainder(verbs: DataFrame, resolved: DataFrame) -> DataFrame:
    """source_id, verbs, entities (name, type) of sources that anchoring left something of: each spelling once, names in order of their first mention."""
    left = verbs.where("anchor IS NULL").groupBy("source_id").agg(F.array_sort(F.collect_set("raw")).alias("verbs"))
    names = resolved.where("outcome <> 'resolve'").groupBy(F.col("session").alias("source_id"), "mention", "type").agg(F.min("seq").alias("seq"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("mention").alias("name"), "type"))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))
    found = left.join(names.groupBy("source_id").agg(ordered.alias("entities")), "source_id", "full_outer")
    none = F.array().cast
    return found.select("source_id", F.coalesce("verbs", none("array<string>")).alias("verbs"), F.coalesce("entities", none("array<struct<name:string,type:string>>")).alias("entities"))


def consolidate(left: DataFrame, cluster: Cluster) -> DataFrame:
    """source_id, verbs, entities as grouped by one call a source."""

    @F.pandas_udf(_GROUPS)
    def ask(verbs: pd.Series, entities: pd.Series) -> pd.DataFrame:
        found = [_answer(cluster(list(v), [dict(e) for e in es]), "clustering") for v, es in zip(verbs, entities, strict=True)]
        return pd.DataFrame({"verbs": [f.get("verbs") or [] for f in found], "entities": [f.get("entities") or [] for f in found]})

    return left.withColumn("__c", ask.asNondeterministic()("verbs", "entities")).select("source_id", "__c.verbs", "__c.entities")


def _roster(resolved: DataFrame, entities: DataFrame, groups: DataFrame) -> DataFrame:
    """source_id, entity_roster: what names resolved to, in order of mention, then the groups whose name isn't among them."""
    stored = entities.groupBy("name", "type").agg(F.first("aliases", ignorenulls=True).alias("__known"))
    met = resolved.where("outcome = 'resolve'").groupBy(F.col("session").alias("source_id"), fold("canonical").alias("__key")).agg(F.min(F.struct("seq", F.col("canonical").alias("name"), "type", "mention")).alias("m")).select("source_id", "__key", "m.*").join(stored, ["name", "type"], "left")
    own = F.when(F.col("mention") != F.col("name"), F.array("mention")).otherwise(F.array().cast("array<string>"))
    aliases = F.array_distinct(F.concat(F.coalesce("__known", F.array().cast("array<string>")), own))
    anchored = met.select("source_id", "__key", F.struct(F.lit(0).alias("part"), "seq", "name", "type", aliases.alias("aliases")).alias("e"))
    each = groups.select("source_id", F.posexplode("entities").alias("pos", "g")).select("source_id", F.col("pos").cast("long").alias("seq"), F.trim("g.canonical").alias("name"), _typed("g.entity_type").alias("type"), F.coalesce("g.aliases", F.array().cast("array<string>")).alias("aliases")).where("name <> ''")
    first = each.groupBy("source_id", fold("name").alias("__key")).agg(F.min(F.struct(F.lit(1).alias("part"), "seq", "name", "type", "aliases")).alias("e"))
    rows = anchored.unionByName(first).groupBy("source_id", "__key").agg(F.min("e").alias("e"))
    entries = F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["aliases"].alias("aliases")))
    return rows.groupBy("source_id").agg(entries.alias("entity_roster"))


def render_roster(roster: Column | str) -> Column:
    """``name (type; aka: alias, alias)`` of each entry."""

    def line(e: Column) -> Column:
        known = F.when(F.size(e["aliases"]) > 0, F.concat(F.lit("; aka: "), F.array_join(e["aliases"], ", "))).otherwise("")
        return F.concat(e["name"], F.lit(" ("), e["type"], known, F.lit(")"))

    return F.transform(roster, line)


@dataclass
class Scan:
    #: source_id, verb_menu array<string>, entity_roster array<struct<name, type, aliases>>, scan_calls, cluster_calls: a row per source.
    hints: DataFrame
    #: Verbs of groups that the registry doesn't know.
    staged: DataFrame


def scan_pass(chunks: DataFrame, entities: DataFrame, live: DataFrame, registry: DataFrame, inventory: Inventory, once: Once, cluster: Cluster | None = None, embed: Column | None = None, size: int = 4) -> Scan:
    """Inventory, anchoring and at most one clustering call a source; without ``cluster`` what is left is not offered.

    Null verbs and names, and those of separators only, count as none; a source whose chunks name nothing gets empty hints.
    """
    found = once(scan(chunks, inventory, size), "scan-inventory")
    verbs = once(source_verbs(found, registry, live), "scan-verbs")
    resolved = once(resolve_names(found, entities, registry, embed), "scan-names")
    left = remainder(verbs, resolved)
    if cluster is None:
        left = left.where(F.lit(False))
    groups = once(consolidate(left, cluster or (lambda v, e: {})), "scan-groups")
    grouped = groups.select("source_id", F.explode("verbs.canonical").alias("c")).select("source_id", normalize_verb("c").alias("verb")).where("verb <> 'unknown'")
    menu = verbs.where("anchor IS NOT NULL").select("source_id", F.col("anchor").alias("verb")).unionByName(grouped).groupBy("source_id").agg(F.array_sort(F.collect_set("verb")).alias("verb_menu"))
    asked = groups.select("source_id", F.lit(1).alias("cluster_calls"))
    hints = found.groupBy("source_id").agg(F.count("*").cast("int").alias("scan_calls")).join(menu, "source_id", "left").join(_roster(resolved, entities, groups), "source_id", "left").join(asked, "source_id", "left")
    hints = hints.select(
        "source_id", F.coalesce("verb_menu", F.array().cast("array<string>")).alias("verb_menu"),
        F.coalesce("entity_roster", F.array().cast("array<struct<name:string,type:string,aliases:array<string>>>")).alias("entity_roster"), "scan_calls", F.coalesce("cluster_calls", F.lit(0)).alias("cluster_calls"),
    )
    known = registry.where("kind = 'relation'").select(F.col("label").alias("verb"))
    return Scan(once(hints, "scan-hints"), grouped.select("verb").distinct().join(known, "verb", "left_anti"))
