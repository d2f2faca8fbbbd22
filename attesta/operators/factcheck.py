"""Fact checks: domains with independent sources, their rows, verdict receipts, and the advisory notice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import clean_markup, redirect_target, scoped_claim, source_prefix
from attesta.operators.components import durable
from attesta.operators.ledger import dedupe
from attesta.schemas import IDENTITY

Search = Callable[[str], list[dict]]  # claim -> [{url, text}]
Judge = Callable[[str, list[dict]], dict]  # claim, results -> {verdict, confidence, reasoning, evidence_urls}
FEW_DOMAINS, SALTS = 10_000, 64
VERDICTS = ("supported", "contradicted", "unverifiable")
RECEIPT = "subject string, relation string, object string, source_ref string, verdict string, confidence double, evidence_urls array<string>, model string, search_provider string, reasoning string, created_at string"


def overlapping_domains(ledger: DataFrame, least: int = 2) -> DataFrame:
    """domain, n_sources: domains that at least ``least`` sources speak of."""
    rows = ledger.where("coalesce(domain, '') <> ''")
    return rows.groupBy("domain").agg(F.count_distinct(source_prefix("source_ref")).alias("n_sources")).where(F.col("n_sources") >= least)


def _in_domains(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """The rows of ``domains``, where they lie: a domain can hold any share of the rows, so they are not dealt by it.

    Domains are labels of a vocabulary, and are only broadcast where they are few; else each is dealt to many tasks.
    """
    domains = durable(domains)
    if domains.count() <= FEW_DOMAINS:
        return rows.join(F.broadcast(domains), "domain", "left_semi").select(*rows.columns)
    salt = F.pmod(F.xxhash64(*IDENTITY), F.lit(SALTS)).cast("int")
    dealt = domains.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(dealt, ["domain", "__salt"], "left_semi").select(*rows.columns)


def domain_candidates(ledger: DataFrame) -> DataFrame:
    """All rows of those domains, each identity once."""
    return dedupe(_in_domains(ledger, overlapping_domains(ledger).select("domain")))


def candidates_for_write(written: DataFrame, existing: DataFrame) -> DataFrame:
    """Written domains that another source speaks of already: their existing and written rows, each identity once, existing first."""
    sources = lambda df: df.where("coalesce(domain, '') <> ''").select("domain", source_prefix("source_ref").alias("src")).distinct()
    mine = sources(written)
    hit = sources(existing).join(mine, ["domain", "src"], "left_anti").join(mine.select("domain"), "domain", "left_semi").select("domain").distinct()
    old = existing.withColumn("__side", F.lit(0))
    rows = _in_domains(old.unionByName(written.withColumn("__side", F.lit(1)), allowMissingColumns=True), hit)
    w = Window.partitionBy(*IDENTITY).orderBy("__side", "seq")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__side")


def notice(written: DataFrame, existing: DataFrame) -> str | None:
    """An advisory sentence; it never raises."""
    try:
        domains = [r.domain for r in candidates_for_write(written, existing).select("domain").distinct().orderBy("domain").collect()]  # at most one row per label of the domain registry
    except Exception as e:  # advisory by contract
        return f"fact-check notice unavailable: {type(e).__name__}"
    return f"fact-check candidates in: {', '.join(domains)}" if domains else None


def fact_check(rows: DataFrame, search: Search, judge: Judge, model: str, provider: str, now: str) -> DataFrame:
    """A receipt per row, by injected search and verdict models; an invalid verdict is an error. Write the result once."""
    claims = rows.select(*IDENTITY, scoped_claim("subject", "relation", "object", "scope_conditions").alias("claim"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                found = search(r.claim)
                v = judge(r.claim, found)
                if v.get("verdict") not in VERDICTS or not isinstance(v.get("confidence"), int | float) or not 0 <= v["confidence"] <= 1:
                    raise ValueError(f"invalid verdict for {r.claim!r}")
                urls = v.get("evidence_urls") or [x["url"] for x in found]
                out.append((r.subject, r.relation, r.object, r.source_ref, v["verdict"], float(v["confidence"]), urls, model, provider, v.get("reasoning", ""), now))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECEIPT.split(", ")])

    return claims.mapInPandas(run, RECEIPT)


def append_verdicts(ledger: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one row with the number of receipts whose ledger row is missing)."""
    new = receipts.join(ledger.select(*IDENTITY), list(IDENTITY), "left_semi").withColumn("id", F.uuid())
    missing = receipts.join(ledger.select(*IDENTITY), list(IDENTITY), "left_anti").agg(F.count("*").alias("missing"))
    return new, missing


def parse_results(pages: DataFrame, limit: int = 5) -> DataFrame:
    """query, rank, url, title: the first links of result pages (query, html)."""
    link = r'<a[^>]*class="result__a"[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("title"))
    rows = pages.select("query", F.posexplode(F.slice(both, 1, limit)).alias("pos", "r"))
    return rows.select("query", (F.col("pos") + 1).alias("rank"), redirect_target(F.col("r")["url"]).alias("url"), clean_markup(F.col("r")["title"]).alias("title"))
