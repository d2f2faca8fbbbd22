"""Command line over a store of table snapshots. Model seams are injected by the embedding program (``main(argv, seams)``).

Exit codes: 0 done or approved, 1 pre-flight or command error, 2 bad input, 3 run error, 4 rejected.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import factcheck, ledger, maintenance, resolution, search, walks
from attesta.plans import fanout, ingest
from attesta.sources import chunking, registry
from attesta.store import Store, append_rejected


def _unit(name: str, default: float) -> float:
    value = float(os.environ.get(name, default))
    if not 0 < value <= 1:
        raise ValueError(f"{name} must be in (0, 1]")
    return value


@dataclass
class Settings:
    store: str
    registry: str
    work: str
    rejected: str
    threshold: float
    repeat_mode: str

    @classmethod
    def from_env(cls) -> Settings:
        base = os.environ.get("ATTESTA_HOME", "attesta-home")
        return cls(
            os.environ.get("ATTESTA_STORE", f"{base}/store"), os.environ.get("ATTESTA_REGISTRY", f"{base}/relations.yaml"), os.environ.get("ATTESTA_WORK", f"{base}/work"),
            os.environ.get("ATTESTA_REJECTED", f"{base}/rejected"), _unit("ATTESTA_THRESHOLD", 0.60), ledger.repeat_mode(os.environ.get("ATTESTA_REPEAT_MODE")),
        )


@dataclass
class Seams:
    """Injected models: all optional; a command that needs an absent one fails with a message."""

    embed: resolution.Embedder | None = None
    extract: ingest.Extract | None = None
    inventory: ingest.Inventory | None = None
    cluster: ingest.Cluster | None = None
    decide: Callable | None = None
    classify: Callable | None = None
    search: factcheck.Search | None = None
    judge: factcheck.Judge | None = None
    model: str = "injected"
    provider: str = "injected"
    pages: chunking.Pages | None = None
    ask: Callable[[str], str | None] | None = None


class Failed(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="attesta")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "init", "migrate-ledger", "backfill-sources", "backfill-evidence-embeddings", "normalize-relations"):
        sub.add_parser(name)
    query = sub.add_parser("query").add_subparsers(dest="what", required=True)
    for what in ("entity", "event", "directions"):
        q = query.add_parser(what)
        q.add_argument("term")
        q.add_argument("--top-k", type=int, default=search.TOP_K)
        q.add_argument("--json", action="store_true")
    show = sub.add_parser("entity").add_subparsers(dest="what", required=True).add_parser("show")
    show.add_argument("name")
    show.add_argument("--type", default=None)
    show.add_argument("--state", action="store_true")
    show.add_argument("--event", action="store_true")
    show.add_argument("--json", action="store_true")
    add = sub.add_parser("ingest")
    add.add_argument("path")
    add.add_argument("--yes", action="store_true")
    add.add_argument("--repeat-mode", default=None)
    add.add_argument("--no-novelty-filter", action="store_true")
    prov = sub.add_parser("provenance")
    prov.add_argument("source")
    promote = sub.add_parser("promote-verbs")
    promote.add_argument("--apply", action="store_true")
    check = sub.add_parser("fact-check")
    check.add_argument("--domain")
    check.add_argument("--source")
    reset = sub.add_parser("reset")
    reset.add_argument("--yes", action="store_true")
    return p


def _show(df: DataFrame, as_json: bool = False) -> None:
    """Print every row, a partition at a time."""
    for r in search.render_hits(df, as_json).toLocalIterator():
        print(r.value)


def _registry_table(spark: SparkSession, settings: Settings) -> DataFrame:
    kinds = {k: registry.packaged(k) for k in ("domain", "entity_type", "state_key")}
    kinds["relation"] = registry.load(settings.registry) if os.path.exists(settings.registry) else registry.packaged("relation")
    return registry.table(spark, kinds)


def _vector(seams: Seams, term: str) -> list[float]:
    vector = seams.embed(term) if seams.embed else None
    if vector is None:
        raise Failed(1, "the embedder is unavailable")
    return vector


def _rewrite(store: Store, result: tuple, names: tuple[str, ...]) -> None:
    *tables, report = result
    report = report.collect()[0].asDict()
    store.commit(dict(zip(names, tables, strict=True)))
    print(", ".join(f"{k}: {v}" for k, v in report.items()))


def run(args: argparse.Namespace, spark: SparkSession, seams: Seams, settings: Settings) -> int:
    store = Store(spark, settings.store)
    now_text = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    now = F.lit(now_text).cast("timestamp")
    c = args.command
    if c == "init":
        print("created: " + (", ".join(store.apply_schema()) or "nothing"))
        registry.ensure_working(settings.registry, "relation")
        return 0
    if c == "promote-verbs":
        staged = registry.promote(settings.registry, args.apply)
        print(("promoted: " if args.apply else "would promote: ") + (", ".join(staged) or "nothing"))
        return 0
    if c == "reset":
        if not args.yes:
            raise Failed(2, "reset deletes everything; pass --yes")
        print(store.reset(True))
        return 0
    if wrong := store.preflight():
        raise Failed(1, "; ".join(wrong))
    if c == "check":
        print("ok")
        return 0
    t = store.table
    if c == "query":
        fanout.positive(args.top_k, "top-k")
        if args.what == "entity":
            _show(search.similar_entities(t("entities"), _vector(seams, args.term), args.top_k, settings.threshold), args.json)
        elif args.what == "event":
            _show(search.search_events(t("ledger"), t("entities"), _vector(seams, args.term), args.top_k, settings.threshold), True)
        else:
            seeds, notice = fanout.match_seeds(spark, t("entities"), args.term, seams.embed, settings.threshold)
            rows = [r.asDict() for r in fanout.directions(seeds, t("arrows"), t("ledger"), args.top_k).collect()]
            print(fanout.render_markdown(rows, notice))
    elif c == "entity":
        found = t("entities").where(F.col("name") == args.name)
        if args.type:
            found = found.where(F.col("type") == args.type)
        if found.isEmpty():
            raise Failed(1, f"no entity {args.name}")
        if args.state:
            _show(walks.entity_states(t("state_events"), args.name, args.type or found.first().type), args.json)
        elif args.event:
            _show(walks.entity_events(t("ledger"), t("state_events"), args.name, args.type), args.json)
        else:
            _show(walks.neighbours(t("arrows"), t("entities"), args.name), args.json)
    elif c == "provenance":
        _show(walks.provenance_for_source(t("ledger"), args.source))
    elif c == "migrate-ledger":
        _rewrite(store, maintenance.migrate_ledger(t("arrows"), t("ledger"), now), ("ledger", "arrows"))
    elif c == "normalize-relations":
        _rewrite(store, maintenance.normalize_relations(t("ledger"), t("arrows"), _registry_table(spark, settings), now), ("ledger", "arrows"))
    elif c == "backfill-sources":
        sources, linked, report = maintenance.backfill_sources(t("ledger"), t("sources"))
        _rewrite(store, (sources, linked, report), ("sources", "ledger"))
    elif c == "backfill-evidence-embeddings":
        if seams.embed is None:
            raise Failed(1, "the embedder is unavailable")
        embed = resolution.embedding_udf(seams.embed)("evidence")
        store.commit({n: maintenance.backfill_embeddings(t(n), embed) for n in ("ledger", "state_events")})
    elif c == "fact-check":
        if bool(args.domain) == bool(args.source):
            raise Failed(2, "give exactly one of --domain and --source")
        if not seams.search or not seams.judge:
            raise Failed(1, "no search and verdict models")
        rows = walks.rows_for_domain(t("ledger"), args.domain) if args.domain else walks.provenance_for_source(t("ledger"), args.source).withColumn("scope_conditions", F.lit(""))
        work = f"{settings.work}/receipts-{now_text.replace(' ', '-').replace(':', '')}"
        factcheck.fact_check(rows, seams.search, seams.judge, seams.model, seams.provider, now_text).write.parquet(work)
        new, missing = factcheck.append_verdicts(t("ledger"), spark.read.parquet(work))
        store.append("verdicts", new)
        print(f"missing rows: {missing.first().missing}")
    elif c == "ingest":
        return _ingest(args, spark, store, seams, settings, now)
    return 0


def _ingest(args, spark, store, seams, settings, now) -> int:
    mode = ledger.repeat_mode(args.repeat_mode or settings.repeat_mode)
    if seams.extract is None:
        raise Failed(1, "no extraction model")
    if os.path.isdir(args.path):
        for r in chunking.skipped_files(spark, args.path).collect():
            print(f"skipped: {r.name}")
        docs = chunking.read_markdown(spark, args.path)
        if docs.isEmpty():
            raise Failed(2, "no Markdown files in the folder")
        chunks = chunking.chunk_markdown(docs)
    elif chunking.source_kind(args.path) == "markdown":
        chunks = chunking.chunk_markdown(chunking.read_markdown(spark, args.path))
    else:
        if seams.pages is None:
            raise Failed(1, "no PDF text extractor")
        chunks = chunking.chunk_pages(chunking.read_pages(spark, args.path, seams.pages))
    tables = {n: store.table(n) for n in ("entities", "arrows", "ledger")}
    gates = (None, None) if args.no_novelty_filter else (seams.decide, seams.classify)
    reg = _registry_table(spark, settings)
    delta = ingest.propose(spark, chunks, tables, reg, ingest.Models(seams.extract, gates[0], gates[1], seams.embed, seams.inventory, seams.cluster), settings.work)
    if delta.staged is not None and (verbs := [r.verb for r in delta.staged.collect()]):  # as many as a person is to look through
        print("staged verbs: " + ", ".join(registry.stage(registry.ensure_working(settings.registry, "relation"), verbs)))
    print(ingest.statistics(delta).first().asDict())
    answer = "approve"
    if not args.yes:  # closed input never approves
        answer, delta = ingest.review(delta, seams.ask or (lambda _: None))
    print(ingest.review_and_commit(store, delta, answer, reg, now, mode))
    if answer != "approve":
        append_rejected(ingest.rejection_records(delta), settings.rejected)
        return 4
    if text := ingest.advisory(tables["ledger"], delta):
        print(text)
    return 0


def main(argv: list[str] | None = None, seams: Seams | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = Settings.from_env()
        spark = spark or SparkSession.builder.getOrCreate()
        return run(args, spark, seams or Seams(), settings)
    except Failed as e:
        print(e, file=sys.stderr)
        return e.code
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # a command reports, it doesn't trace
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
