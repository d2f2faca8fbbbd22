"""Label registries: versioned vocabularies of relations, domains, entity types and state keys.

A registry document is a mapping with ``version``, ``labels`` and an optional
``proposed.labels``; an entry has optional ``aliases``, ``inverse`` and
``description``. Documents are small; on the cluster they are one table that
Spark broadcasts below its size threshold.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from attesta.schemas import REGISTRY

LABEL = re.compile(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)*")

# The packaged vocabularies. label: (aliases, inverse).
RELATIONS = {
    "causes": (("caused", "leads_to", "results_in"), "caused_by"),
    "caused_by": ((), ""),
    "part_of": ((), "has_part"),
    "has_part": ((), ""),
    "includes": (("include", "covers", "contains", "encompasses"), "included_in"),
    "included_in": ((), ""),
    "operates_in": (("based_in", "active_in"), ""),
    "precedes": (("came_before", "happened_before"), "follows"),
    "follows": (("came_after", "followed"), ""),
    "triggers": (("triggered", "sparked", "prompted"), "triggered_by"),
    "triggered_by": ((), ""),
    "visited": (("visited_by", "met", "met_with"), ""),
    "funds": (("finances", "subsidized"), "funded_by"),
    "funded_by": ((), ""),
    "regulates": (("regulated", "controls", "restricts"), "regulated_by"),
    "regulated_by": ((), ""),
    "trades_with": (("traded_with", "exports_to", "imports_from"), ""),
    "declared": (("announced", "stated", "declared_that", "said", "vowed"), ""),
    "described_as": (("described", "characterized_as", "labeled", "called"), ""),
    "expects": (("expected", "anticipates", "forecasts", "projects"), ""),
    "predicts": (("predicted", "predicted_at", "prediction", "forecasted"), "predicted_by"),
    "predicted_by": ((), ""),
    "supports": (("backs", "corroborates"), ""),
    "contradicts": (("refutes",), "contradicted_by"),
    "contradicted_by": ((), ""),
    "exceeds": (("exceeded", "surpasses", "outpaces", "more_than"), "exceeded_by"),
    "exceeded_by": ((), ""),
    "constrains": (("constrained", "limits", "caps"), "constrained_by"),
    "constrained_by": ((), ""),
    "supersedes": (("replaces",), "superseded_by"),
    "superseded_by": ((), ""),
    "increases": (("raises",), ""),
    "reduces": (("eases", "lowers"), ""),
    "depends_on": ((), ""),
}
#: "A reduces B" is the opposite of "A increases B", not "B increases A"; this pair is kept apart and only joined for parity.
PARITY_INVERSES = {"increases": "reduces"}
DOMAINS = {
    "economics": ("macroeconomics", "microeconomics"),
    "finance": ("markets", "investing"),
    "psychology": ("cognition", "behavior"),
    "politics": ("governance", "policy"),
    "geopolitics": ("international_relations", "foreign_policy"),
    "monetary_policy": ("central_banking", "rates_policy"),
    "technology": ("engineering", "computing"),
    "health": ("medicine", "wellness"),
}
ENTITY_TYPES = {
    "person": ("politician", "official", "leader", "individual", "chancellor", "president", "minister"),
    "organization": ("geopolitical_entity", "institution", "company", "agency", "central_bank", "party", "government", "bloc"),
    "country": ("nation", "nation_state", "state"),
    "place": ("location", "city", "region", "territory"),
    "event": ("election", "summit", "crisis", "meeting", "war", "announcement"),
    "policy": ("tariff", "sanction", "regulation", "stimulus", "rule", "program"),
    "agreement": ("treaty", "deal", "pact", "accord", "contract"),
    "product": ("commodity", "good", "asset", "currency"),
    "technology": ("platform", "ai_model", "system", "technique"),
    "market": ("sector", "asset_class", "exchange", "industry"),
    "metric": ("indicator", "index", "rate", "ratio"),
    "concept": ("idea", "doctrine", "ideology", "narrative", "principle", "risk"),
}
STATE_KEYS = {
    "approval_rating": ("popularity", "support_rating", "public_support"),
    "vote_share": ("election_result", "poll_share", "polling"),
    "policy_rate": ("interest_rate", "benchmark_rate", "base_rate", "discount_rate"),
    "short_term_borrowing": ("borrowing", "debt_issuance", "financing_need"),
    "trade_volume": ("trade", "exports", "imports", "trade_flow"),
    "inflation_rate": ("cpi", "consumer_prices", "price_growth"),
    "gdp_growth": ("growth_rate", "economic_growth", "gdp"),
    "unemployment_rate": ("joblessness", "unemployment"),
    "debt_to_gdp": ("debt_ratio", "debt_burden"),
    "budget_deficit": ("fiscal_deficit", "deficit", "budget_balance"),
    "exchange_rate": ("fx_rate", "currency_rate"),
    "bond_yield": ("yield", "treasury_yield", "rates"),
    "military_spending": ("defense_budget", "defense_spending"),
    "tariff_rate": ("duty_rate", "customs_rate"),
    "energy_price": ("oil_price", "gas_price", "power_price"),
    "market_cap": ("market_value", "valuation"),
    "consumer_confidence": ("sentiment", "confidence_index"),
    "migration_volume": ("migration", "immigration_flow"),
    "population": ("headcount", "population_size"),
}


class RegistryError(ValueError):
    """A registry document is malformed."""


@dataclass(frozen=True)
class Entry:
    label: str
    aliases: tuple[str, ...] = ()
    inverse: str = ""
    description: str = ""
    staged: bool = False


@dataclass
class Registry:
    version: int
    entries: dict[str, Entry]
    _canonical: dict[str, str] = field(init=False)
    _flip: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        self._canonical = {name: e.label for e in self.entries.values() for name in (e.label, *e.aliases)}
        self._flip = {e.inverse: e.label for e in self.entries.values() if e.inverse}

    def is_known(self, label: str) -> bool:
        return _norm(label) in self._canonical

    def canonical_for(self, label: str) -> str:
        return self._canonical.get(_norm(label), _norm(label))

    def canonicalize(self, subject: str, relation: str, object_: str) -> tuple[str, str, str, bool]:
        """(subject, relation, object, flipped): aliases collapse, then the second member of a pair turns round."""
        label = self.canonical_for(relation)
        if label in self._flip:
            return object_, self._flip[label], subject, True
        return subject, label, object_, False

    def vocabulary(self) -> list[str]:
        return sorted(self.entries)

    def staged_labels(self) -> list[str]:
        return sorted(e.label for e in self.entries.values() if e.staged)

    def entry(self, label: str) -> Entry | None:
        return self.entries.get(self.canonical_for(label))

    def document(self) -> dict[str, Any]:
        def spec(e: Entry) -> dict[str, Any]:
            return {k: v for k, v in (("aliases", list(e.aliases)), ("inverse", e.inverse), ("description", e.description)) if v}

        return {
            "version": self.version,
            "labels": {e.label: spec(e) for e in self.entries.values() if not e.staged},
            "proposed": {"labels": {e.label: spec(e) for e in self.entries.values() if e.staged}},
        }

    def dump(self) -> str:
        return yaml.safe_dump(self.document(), sort_keys=False, allow_unicode=True)

    def rows(self, kind: str) -> list[tuple]:
        """A row per spelling: its canonical label, and the label to flip to if it is the second member of a pair."""
        return [
            (kind, name, e.label, self._flip.get(e.label), e.staged, e.description, self.version)
            for e in self.entries.values()
            for name in (e.label, *e.aliases)
        ]


def _norm(label: str) -> str:
    return label.strip().lower()


def packaged(kind: str, parity: bool = False) -> Registry:
    """The vocabulary of ``kind``: relation, domain, entity_type or state_key."""
    if kind == "relation":
        extra = PARITY_INVERSES if parity else {}
        return Registry(1, {k: Entry(k, a, i or extra.get(k, "")) for k, (a, i) in RELATIONS.items()})
    table = {"domain": DOMAINS, "entity_type": ENTITY_TYPES, "state_key": STATE_KEYS}[kind]
    return Registry(1, {k: Entry(k, a) for k, a in table.items()})


def _entries(section: Any, where: str, staged: bool) -> list[Entry]:
    if not isinstance(section, Mapping):
        raise RegistryError(f"{where} must be a mapping")
    out = []
    for label, spec in section.items():
        if not isinstance(label, str) or not LABEL.fullmatch(label):
            raise RegistryError(f"{where}: label {label!r} must be lowercase snake_case")
        spec = {} if spec is None else spec
        if not isinstance(spec, Mapping):
            raise RegistryError(f"{where}.{label} must be a mapping")
        if unknown := set(spec) - {"aliases", "inverse", "description"}:
            raise RegistryError(f"{where}.{label}: unknown keys {sorted(map(str, unknown))}")
        aliases = spec.get("aliases") or []
        if not isinstance(aliases, list) or not all(isinstance(a, str) and LABEL.fullmatch(a) for a in aliases):
            raise RegistryError(f"{where}.{label}: aliases must be a list of lowercase snake_case labels")
        if len(set(aliases)) < len(aliases):
            raise RegistryError(f"{where}.{label}: duplicate alias")
        inverse = spec.get("inverse") or ""
        if not isinstance(inverse, str) or inverse and not LABEL.fullmatch(inverse):
            raise RegistryError(f"{where}.{label}: inverse must be a lowercase snake_case label")
        description = spec.get("description") or ""
        if not isinstance(description, str):
            raise RegistryError(f"{where}.{label}: description must be a string")
        out.append(Entry(label, tuple(aliases), inverse, description, staged))
    return out


def parse(document: Any) -> Registry:
    """Validate a registry document; the rules hold over canonical and staged labels together."""
    if not isinstance(document, Mapping):
        raise RegistryError("registry must be a mapping")
    if unknown := set(document) - {"version", "labels", "proposed"}:
        raise RegistryError(f"unknown top-level keys {sorted(map(str, unknown))}")
    version = document.get("version")
    if isinstance(version, bool) or not isinstance(version, int) or version < 1:
        raise RegistryError("version must be a positive integer")
    if "labels" not in document:
        raise RegistryError("labels section is missing")
    found = _entries(document["labels"], "labels", False)
    proposed = document.get("proposed")
    if proposed is not None:
        if not isinstance(proposed, Mapping) or set(proposed) - {"labels"}:
            raise RegistryError("proposed must be a mapping with labels only")
        found += _entries(proposed.get("labels") or {}, "proposed.labels", True)
    names: dict[str, str] = {}
    for e in found:
        if names.setdefault(e.label, e.label) != e.label or [x.label for x in found].count(e.label) > 1:
            raise RegistryError(f"label {e.label!r} is defined twice")
    for e in found:
        for alias in e.aliases:
            if alias in names:
                raise RegistryError(f"alias {alias!r} of {e.label!r} collides with {names[alias]!r}")
            names[alias] = e.label
    table = {e.label: e for e in found}
    claimed: dict[str, str] = {}
    for e in found:
        if not e.inverse:
            continue
        if e.inverse == e.label:
            raise RegistryError(f"{e.label!r} can't be its own inverse")
        if e.inverse not in table:
            raise RegistryError(f"inverse {e.inverse!r} of {e.label!r} is not a canonical label")
        if table[e.inverse].inverse:
            raise RegistryError(f"the pair {e.label!r}, {e.inverse!r} declares its inverse twice")
        if claimed.setdefault(e.inverse, e.label) != e.label:
            raise RegistryError(f"{e.inverse!r} is the inverse of two labels")
    return Registry(version, table)


def load(path: str) -> Registry:
    with open(path, encoding="utf-8") as f:
        try:
            return parse(yaml.safe_load(f))
        except yaml.YAMLError as e:
            raise RegistryError(f"invalid YAML: {e}") from e


def resolve_path(working: str, fallback: str) -> str:
    """The working copy if it exists, else the packaged file."""
    return working if os.path.exists(working) else fallback


def ensure_working(working: str, kind: str) -> str:
    """Seed the working copy from the packaged vocabulary once."""
    if not os.path.exists(working):
        os.makedirs(os.path.dirname(working) or ".", exist_ok=True)
        with open(working, "w", encoding="utf-8") as f:
            f.write(packaged(kind).dump())
    return working


def _rewrite(path: str, registry: Registry) -> None:
    text = registry.dump()
    parse(yaml.safe_load(text))
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


def stage(path: str, verbs: Iterable[str]) -> list[str]:
    """Add unknown verbs to the staged section; known, staged and empty ones are left alone."""
    registry = load(path)
    fresh = sorted({v for v in (_norm(x) for x in verbs) if v and v != "unknown" and LABEL.fullmatch(v) and not registry.is_known(v)})
    if fresh:
        _rewrite(path, Registry(registry.version, registry.entries | {v: Entry(v, staged=True) for v in fresh}))
    return fresh


def promote(path: str, apply: bool = False) -> list[str]:
    """Move staged labels into the vocabulary; a dry run unless ``apply``."""
    registry = load(path)
    staged = registry.staged_labels()
    if apply and staged:
        _rewrite(path, Registry(registry.version, {k: Entry(e.label, e.aliases, e.inverse, e.description) for k, e in registry.entries.items()}))
    return staged


def table(spark: SparkSession, registries: Mapping[str, Registry]) -> DataFrame:
    """All spellings of all registries as one small table."""
    return spark.createDataFrame([row for kind, r in registries.items() for row in r.rows(kind)], REGISTRY)


def packaged_table(spark: SparkSession, parity: bool = False) -> DataFrame:
    return table(spark, {k: packaged(k, parity) for k in ("relation", "domain", "entity_type", "state_key")})
