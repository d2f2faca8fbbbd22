import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta import cli
from attesta.operators import dispatch, factcheck, guards, ledger, maintenance, novelty, resolution, search, states, walks
from attesta.plans import fanout, ingest
from attesta.schemas import ARROWS, ENTITIES, LEDGER, SOURCES
from attesta.sources import chunking, registry
from attesta.store import Store



@pytest.fixture
def now(spark):
    return F.lit("2024-01-01").cast("timestamp")


def ledger_rows(spark, *items):
    """(subject, relation, object, source_ref, confidence[, scope[, evidence]])"""
    out = []
    for i, r in enumerate(items):
        scope, evidence = (r[5] if len(r) > 5 else ""), (r[6] if len(r) > 6 else f"e{i}")
        out.append((*r[:5], evidence, None, scope, "", r[1], r[3].split(":")[0], None, None, i))
    return spark.createDataFrame(out, LEDGER)


def arrow_rows(spark, df):
    return ledger.arrows(df).withColumns({"updated_at": F.col("created_at"), "evidence": F.lit(None).cast("array<string>"), "source_ref": F.lit(None).cast("string")}).select(*ARROWS.fieldNames())


@pytest.fixture
def rates(spark):
    entities = spark.createDataFrame([("Rates", "topic", ["interest rates"], [1.0, 0.0], None, None), ("Target", "topic", [], [0.0, 1.0], None, None), ("Other", "topic", [], None, None, None)], ENTITIES)
    rows = ledger_rows(spark, ("Rates", "MAY_DESCRIBE", "Target", "doc:chunk-2", 0.95, "loose usage"), ("Other", "HEDGES", "Rates", "book:2", 0.9, "crisis only"))
    return entities, rows


def test_fan_out(spark, rates):
    entities, rows = rates
    seeds, notice = fanout.match_seeds(spark, entities, "Interest Rates!")
    got = fanout.directions(seeds, arrow_rows(spark, rows), rows).orderBy("rank").collect()
    assert notice is None and [(r["rank"], r.neighbor, r.confidence, r.scope_conditions, r.source_ref, r.seed_score) for r in got] == [(1, "Target", 0.95, "loose usage", "doc:chunk-2", 1.0), (2, "Other", 0.9, "crisis only", "book:2", 1.0)]
    two = ledger_rows(spark, ("Rates", "MAY_DESCRIBE", "Target", "a:1", 0.6, "", "first claim"), ("Rates", "MAY_DESCRIBE", "Target", "doc:chunk-2", 0.5, "", "second claim"))
    r = fanout.directions(seeds, arrow_rows(spark, two), two).first()
    assert r.confidence == pytest.approx(0.8) and r.source_ref == "doc:chunk-2" and r.evidence == ["first claim", "second claim"]
    assert "Target" in fanout.render_markdown([x.asDict() for x in got])
    with pytest.raises(ValueError):
        fanout.directions(seeds, arrow_rows(spark, rows), top_k=0)


def test_seeds(spark, rates):
    entities, _ = rates
    near, _ = fanout.match_seeds(spark, entities, "money", lambda t: [0.8, 0.5])
    assert [(r.name, round(r.seed_score, 3)) for r in near.collect()] == [("Rates", 0.848)]
    assert fanout.semantic_seeds(entities, [0.8, 0.5], 0.95).count() == 0
    none, notice = fanout.match_seeds(spark, entities, "money", lambda t: None)
    assert none.count() == 0 and notice
    assert fanout.match_seeds(spark, entities, "rates", lambda t: 1 / 0)[0].count() == 1  # an exact name needs no model


def test_walks(spark, rates):
    entities, rows = rates
    arrows = arrow_rows(spark, rows)
    assert [(r.relation, r.direction, r.name) for r in walks.neighbours(arrows, entities, "Rates").collect()] == [("HEDGES", "in", "Other"), ("MAY_DESCRIBE", "out", "Target")]
    assert walks.edges_for_entity(arrows, rows, "Rates").count() == 2 and walks.provenance_for_source(rows, "book").count() == 1
    assert [r.name for r in walks.find_entities(entities, " INTEREST rates", "topic").collect()] == ["Rates"]
    assert [r.name for r in walks.containment_candidates(entities, "high rates", "topic").collect()] == ["Rates"]
    path = fanout.follow_path(arrows, "Other", 3)
    assert [p["object"] for p in path] == ["Rates", "Target"] and fanout.path_confidence(path) == 0.9
    hits = search.similar_entities(entities, [1.0, 0.0], threshold=0.6).collect()
    assert [h.name for h in hits] == ["Rates"]


def test_current_state(spark):
    ddl = "entity string, entity_type string, state_key string, value string, unit string, as_of string, confidence double, source_ref string, seq long"
    df = spark.createDataFrame([("P", "person", "approval_rating", "42", "%", "2026-09-01", 0.9, "note-1:x", 1), ("P", "person", "approval_rating", "38", "%", "2026-10-01", 0.5, "note-2:x", 2), ("P", "person", "gdp", "1", "", "2026", 0.5, "a:x", 3), ("P", "person", "gdp", "2", "", "2026", 0.8, "b:x", 4)], ddl)
    assert {(r.state_key, r.value) for r in states.current_state(df).collect()} == {("approval_rating", "38"), ("gdp", "2")}
    m = json.loads(states.state_json(states.state_map(states.current_state(df))).first().state)
    assert m["approval_rating"]["value"] == "38"


def test_normalization_pass_is_a_no_op_when_repeated(spark, now):
    reg = registry.packaged_table(spark)
    rows = ledger_rows(spark, ("a", "REPLACES", "b", "s1:x", 0.5), ("b", "SUPERSEDED_BY", "a", "s2:x", 0.6), ("a", "SUPERSEDES", "b", "s1:x", 0.4), ("a", "MAY_DESCRIBE", "b", "s1:x", 0.3))
    after, arrows, report = maintenance.normalize_relations(rows, arrow_rows(spark, rows), reg, now)
    assert {(r.relation, r.source_ref, r.confidence) for r in after.collect()} == {("SUPERSEDES", "s1:x", 0.4), ("SUPERSEDES", "s2:x", 0.6), ("MAY_DESCRIBE", "s1:x", 0.3)}
    assert {(r.relation, round(r.confidence, 6)) for r in arrows.collect()} == {("SUPERSEDES", 0.76), ("MAY_DESCRIBE", 0.3)}
    assert report.first().asDict() == {"kept": 2, "rewritten": 1, "collapsed": 1, "flipped": 1, "arrows_deleted": 2}
    again = maintenance.plan_normalization(after, reg)
    assert again.where("action <> 'keep'").count() == 0


def test_migration_and_source_backfill(spark, now):
    legacy = spark.createDataFrame([("a", "R", "b", 0.5, "", None, None, ["x", "y"], "doc:1"), ("c", "R", "d", 0.9, "", None, None, ["z"], "doc:2")], ARROWS)
    rows = ledger_rows(spark, ("c", "R", "d", "old:1", 0.4))
    after, arrows, report = maintenance.migrate_ledger(legacy, rows, now)
    assert report.first().asDict() == {"arrows": 2, "confidences_changed": 1, "stripped": 2, "rows_created": 1}
    assert {(r.subject, r.evidence) for r in after.collect()} == {("a", "x\ny"), ("c", "e0")}
    assert all(r.evidence is None and r.source_ref is None for r in arrows.collect())
    assert maintenance.migrate_ledger(arrows, after, now)[2].first().asDict() == {"arrows": 2, "confidences_changed": 0, "stripped": 0, "rows_created": 0}
    sources, linked, _ = maintenance.backfill_sources(after, spark.createDataFrame([], SOURCES))
    assert {r.id for r in sources.collect()} == {"doc", "old"} and linked.where("source_id IS NULL").count() == 0
    assert maintenance.backfill_sources(linked, sources)[2].first().sources_created == 0


ENT = "name string, type string, aliases array<string>, embedding array<double>, corroborations int"
MEN = "session string, type string, seq long, mention string, embedding array<double>"


def resolve(spark, mentions, store):
    m = spark.createDataFrame([("s", "organization", i, n, v) for i, (n, v) in enumerate(mentions)], MEN)
    e = spark.createDataFrame([(n, "organization", a, v, c) for n, a, v, c in store], ENT)
    return [(r.outcome, r.canonical, r.layer) for r in resolution.resolve(m, e).orderBy("seq").collect()]


def test_resolution_layers(spark):
    store = [("Federal Reserve", ["the Fed"], [1.0, 0.0], 0)]
    got = resolve(spark, [(" THE FED! ", None), ("Federal Reserv", None), ("Brand New", None), ("brand  new", None), ("Brand Neww", None)], store)
    assert got == [("resolve", "Federal Reserve", "store_exact"), ("resolve", "Federal Reserve", "store_fuzzy"), ("create", "Brand New", "create"), ("resolve", "Brand New", "session_exact"), ("resolve", "Brand New", "session_fuzzy")]
    close = [("Alpha Bank", [], [0.90, (1 - 0.81) ** 0.5], 0), ("Beta House", [], [0.88, -((1 - 0.7744) ** 0.5)], 0)]
    assert resolve(spark, [("Gamma", [1.0, 0.0])], close)[0][0] == "queue"
    backed = [("Alpha Bank", [], [0.86, (1 - 0.7396) ** 0.5], 2), ("Beta House", [], [0.859, -((1 - 0.859**2) ** 0.5)], 0)]
    assert resolve(spark, [("Gamma", [1.0, 0.0])], backed) == [("resolve", "Alpha Bank", "store_semantic")]
    assert resolve(spark, [("Reserve", None)], store) == [("queue", None, "store_containment")]
    bare = [("Federal Reserve", [], [1.0, 0.0], 0)]  # aliases are pooled, so one with other words would rule containment out
    assert resolve(spark, [("Federal Reserve System", [1.0, 0.0])], bare) == [("resolve", "Federal Reserve", "store_containment")]


def test_fuzzy_pairs_miss_none(spark):
    r = random.Random(5)
    base = ["Johannesburg", "MacDonalds", "New York", "abcdefghij", "Federal Reserve Bank of Saint Louis", "aaaaaaaaaaaa", "xy", "!?", "Bank  Bank", "European Organization for Nuclear Research in the Canton of Geneva"]
    names = [*base, "Kohannesburg", "McDonalds", "New York New York"]
    for n in base * 12:
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(n) + 1)
            n = r.choice([n[:at] + r.choice("abkx ") + n[at:], n[:at] + n[at + 1 :], n[:at] + r.choice("abkx") + n[at + 1 :]])
        names.append(n)
    stored = [(n, "t", [names[-1 - i]] if i % 3 == 0 else None) for i, n in enumerate(sorted(set(names)))]
    a = spark.createDataFrame([(n, "t") for n in sorted(set(names))] + [("Johannesburg", "other")], "name string, type string")
    for threshold in (0.90, 0.75):
        rows = resolution.fuzzy_pairs(a, spark.createDataFrame(stored, "name string, type string, aliases array<string>"), threshold).collect()
        best = {(m, n): resolution.best_ratio(resolution.norm(m), [resolution.norm(x) for x in (n, *(al or []))]) for m in set(names) for n, _, al in stored}
        assert {(x.a_name, x.b_name): x.ratio for x in rows} == {k: v for k, v in best.items() if v >= threshold} and len(rows) == len({(x.a_name, x.b_name) for x in rows})
    found = {(x.a_name, x.b_name) for x in resolution.fuzzy_pairs(a, a).collect()}  # without aliases
    assert {("Kohannesburg", "Johannesburg"), ("McDonalds", "MacDonalds")} <= found and ("New York New York", "New York") not in found


@pytest.mark.parametrize("seed", range(3))
def test_components_decide_as_one_fold_over_the_session(spark, seed):
    """Random sessions with vectors, aliases, ties and repeated names, against the whole store in one fold."""
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "bank", "of", "north", "house", "omega"]
    name = lambda: " ".join(r.sample(words, r.randint(1, 3)))

    def spoiled():
        n, at = name(), r.randrange(3)
        return n if at else n.upper() + r.choice(["", "s", "!", " x"])

    def vector():
        k = r.randrange(6)
        return None if r.random() < 0.4 else [float(k == i) + r.choice([0.0, 0.1, 0.3]) for i in range(6)]

    store = [(n, t, [spoiled() for _ in range(r.randrange(3))] or None, vector(), r.randrange(4)) for n, t in sorted({(name(), r.choice("tu")) for _ in range(14)})]
    mentions = [(r.choice("pq"), r.choice("tu"), i, spoiled(), vector()) for i in range(70)]
    e = spark.createDataFrame(store, ENT)
    m = spark.createDataFrame(mentions, MEN)
    got = [r_.asDict(recursive=True) for r_ in resolution.resolve(m, e).collect()]
    want = []
    for (_, kind), own in m.toPandas().groupby(["session", "type"]):
        pool = e.where(e.type == kind).toPandas()
        want += resolution.resolve_group(own, pool).to_dict("records")
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({x["layer"] for x in got}) >= 4


@pytest.mark.parametrize("seed", range(2))
def test_large_sessions_fall_into_components_and_decide_as_one_fold(spark, seed):
    """As above, but no session is folded whole, and half of the mentions have a store match by name, so they need no vector search."""
    r = random.Random(100 + seed)
    words = ["alpha", "beta", "gamma", "delta", "bank", "of", "north", "house", "omega"]
    name = lambda k: " ".join(r.sample(words, k))
    vector = lambda: None if r.random() < 0.3 else [float(r.randrange(6) == i) + r.choice([0.0, 0.1]) for i in range(6)]
    store = [(n, "t", None, vector(), r.randrange(4)) for n in sorted({name(2) for _ in range(8)})]
    mentions = [("p", r.choice(["t", None]), i, r.choice([store[i % len(store)][0], name(1) + "zq", name(1) + "z" * r.randrange(9, 11), name(3), "zq" + name(1)]), vector()) for i in range(60)]
    e, m = spark.createDataFrame(store, ENT), spark.createDataFrame(mentions, MEN)
    want = []
    for kind, own in m.toPandas().groupby("type", dropna=False):
        want += resolution.resolve_group(own, e.where(e.type == (kind if isinstance(kind, str) else "none")).toPandas()).to_dict("records")
    tell = lambda rows: sorted(repr([x[c] for c in ("seq", "mention", "outcome", "canonical", "layer", "new_alias", "matches")]) for x in rows)
    for whole in (0, resolution.WHOLE):
        assert tell(x.asDict(recursive=True) for x in resolution.resolve(m, e, whole).collect()) == tell(want)


def test_a_session_of_known_names_is_not_searched_for_components(spark, monkeypatch):
    """Small sessions are folded whole, names that the store has are not compared with others."""

    def never(*_, **__):
        raise AssertionError("searched")

    for f in ("near_names", "near_links", "near_vectors", "subset_pairs", "components"):
        monkeypatch.setattr(resolution, f, never)
    assert resolve(spark, [("Alpha", [1.0]), ("ALPHA", [1.0])], [("Alpha", None, [1.0], 0)]) == [("resolve", "Alpha", "store_exact")] * 2


def test_no_mentions_no_entities_and_null_names(spark):
    assert resolve(spark, [], [("A", None, None, 0)]) == []
    assert resolve(spark, [("A", None), (None, None), (None, None)], []) == [("create", "A", "create"), ("create", "", "create"), ("resolve", "", "session_exact")]


def test_containment_pairs_equal_brute_force(spark):
    r = random.Random(2)
    words = [*"abcdefgh", "the"]
    make = lambda n: sorted({" ".join(r.sample(words, r.randint(1, 5))) for _ in range(n)} | {"", "the", "the the", "zzz"})
    left, right = make(60), [(n, "t", [r.choice(words) + " x"] if r.random() < 0.3 else None) for n in make(60)]
    a = spark.createDataFrame([(n, "t") for n in left] + [("a", "other")], "name string, type string")
    b = spark.createDataFrame(right, "name string, type string, aliases array<string>")
    want = set()
    for x in left:
        for n, _, al in right:
            p, q = set(x.split()), {w for v in (n, *(al or [])) for w in v.split()}
            if p and q and (p < q or q < p):
                want.add((x, n))
    rows = resolution.containment_pairs(a, b).collect()
    assert {(x.a_name, x.b_name) for x in rows} == want and len(rows) == len(want)


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    from attesta.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", 40)  # many blocks
    r = np.random.default_rng(3)
    centres = r.standard_normal((6, 12))
    rows = [("t" if i % 3 else "u", i, list(map(float, centres[i % 6] + r.standard_normal(12) * (0.1 if i % 2 else 0.5)))) for i in range(300)]
    rows += [("t", 300 + i, [0.25] * 12) for i in range(3)] + [("t", 310, rows[1][2][:9]), ("t", 311, [0.0] * 12), ("t", 312, []), ("t", 313, None), ("t", 314, [float("nan")] * 12), ("t", 315, [1.0, None, 1.0]), (None, 316, [0.25] * 12), ("t", 317, [1e200] * 12), ("u", 318, [1e-200] * 12)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")

    def unit(v):
        v = np.array([np.nan if x is None else x for x in v or []], float)
        v = np.pad(v, (0, 12 - len(v)))
        if not np.isfinite(v).all() or not v.any():
            return np.zeros(12)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = {i: unit(v) for _, i, v in rows}
    want = {(a, b) for g, a, _ in rows for h, b, _ in rows if g == h and g is not None and units[a] @ units[b] >= 0.85}
    got = [tuple(x) for x in vectors.near_vectors(df, df, 0.85).collect()]
    assert set(got) == want and len(got) == len(want) > 1000

    def roots(links):
        root = {i: i for _, i, _ in rows}
        for _ in root:
            before = dict(root)
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root
        return root

    links = [tuple(x) for x in vectors.near_links(df, 0.85).collect()]
    assert roots(links) == roots(want) and len(links) < len(want) / 2
    blocks = vectors._blocks(df)
    met = vectors._meetings(blocks, blocks.toDF(*blocks.columns), 0.85).count()
    n = blocks.where("centre IS NOT NULL").groupBy("g").count().selectExpr("sum(count * count)").first()[0]
    assert 0 < met <= n
    assert vectors.near_vectors(df.limit(0), df, 0.85).count() == 0 and vectors.near_links(df.limit(0), 0.85).count() == 0


def test_blocks_of_far_clusters_do_not_meet(spark):
    from attesta.operators import vectors

    r = np.random.default_rng(4)
    centres = r.standard_normal((8, 32))
    rows = [("t", i, list(map(float, centres[i % 8] + 0.02 * r.standard_normal(32)))) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    blocks = vectors._blocks(df)
    each = blocks.groupBy("block").agg(F.count("*").alias("n")).collect()
    met = {tuple(x) for x in vectors._meetings(blocks, blocks.toDF(*blocks.columns), 0.85).collect()}
    size = {b.block: b.n for b in each}
    assert sum(size[i] * size[j] for i, j in met) <= 800 * 800
    assert {frozenset(x) for x in vectors.near_vectors(df, df, 0.85).collect()} == {frozenset((a, b)) for _, a, _ in rows for _, b, _ in rows if a % 8 == b % 8}


def test_semantic_pairs_join_repeats_and_ignore_odd_vectors(spark):
    m = spark.createDataFrame([(1, "t", [1.0, 0.0]), (2, "t", [1.0, 0.0]), (3, "t", None), (4, "u", [1.0, 0.0]), (5, "t", [float("nan"), 1.0])], "k long, type string, embedding array<float>")
    e = spark.createDataFrame([("a", "t", [1.0, 0.1]), ("b", "t", [1.0, 0.1]), ("c", "t", [0.0, 1.0]), ("d", None, [1.0, 0.0])], "name string, type string, embedding array<double>")
    assert sorted((r.k, r.name, round(r.score, 4)) for r in resolution.semantic_pairs(m, e).collect()) == [(1, "a", 0.995), (1, "b", 0.995), (2, "a", 0.995), (2, "b", 0.995)]


def test_pools_equal_plain_scores():
    r = random.Random(5)
    words = ["bank", "of", "the", "north", "nort", "banks", "3m", "", "alpha"]
    make = lambda: " ".join(r.choices(words, k=r.randint(0, 4)))
    known = [resolution.Known(make(), [make() for _ in range(r.randint(0, 2))], [r.random() for _ in range(r.choice((2, 3)))] if r.random() < 0.7 else None) for _ in range(80)]
    pool = resolution.Pool(known)
    for _ in range(60):
        key, vector = resolution.norm(make()), [r.random() - 0.2 for _ in range(r.choice((2, 3)))]
        assert pool.similar(key) == [(x, k) for k in known if (x := resolution.best_ratio(key, k.fuzzy_names)) >= resolution.FUZZY]
        assert pool.near(vector) == [(x, k) for k in known if k.vector is not None and (x := resolution._cos(vector, k.vector)) >= resolution.SEMANTIC]


def test_mentions_with_other_first_letters_are_resolved(spark):
    store = [("Johannesburg", [], None, 0), ("Golden Arches", ["MacDonalds"], None, 0)]
    assert resolve(spark, [("Kohannesburg", None), ("McDonalds", None)], store) == [("resolve", "Johannesburg", "store_fuzzy"), ("resolve", "Golden Arches", "store_fuzzy")]


DDL = "subject string, subject_type string, relation string, object string, object_type string, confidence double, evidence string, scope_conditions string, source_ref string, domain string"


def test_dispatch_steps(spark):
    made = [("elevated", "x"), ("France and Canada", "x"), ("$1 trillion", "x"), ("previous video", "x"), ("Bank (old)", "x"), ("A", "a"), ("US, Japan and UK", "x"), ("weak", "Y")]
    rows = spark.createDataFrame([(s, "place", "funds", o, "place", 0.5, "seen", "", "d:chunk-1", None) for s, o in made], DDL)
    answers = {
        "elevated": ("to_scope", {"scope": "when elevated"}), "France and Canada": ("named_group", {"group_name": "G2", "group_type": "organization"}), "$1 trillion": ("to_state", {"entity": "Debt", "entity_type": "metric", "state_key": "population", "value": "1", "as_of": "2024"}),
        "previous video": ("to_source", {"note": "meta"}), "Bank (old)": ("normalize_name", {"name": "Bank", "qualifier": "old"}), "A": ("missing_endpoint", {"endpoint": "B"}),
        "US, Japan and UK": ("decompose_per_member", {"triples": [{"subject": "US", "object": "x"}, {"subject": "", "object": "x"}]}), "weak": ("to_state", {"entity": "Y"}),
    }
    model = lambda c, g, t: (answers[c["subject"]][0], json.dumps(answers[c["subject"]][1]))
    chunks = spark.createDataFrame([("d:chunk-1", "text")], "source_ref string, text string")
    done = dispatch.execute(dispatch.decide(dispatch.with_chunk(guards.classify(rows), chunks), model))
    assert {(r.subject, r.object, r.scope_conditions) for r in done.triples.collect()} == {("elevated", "x", "when elevated"), ("G2", "x", "unconditional"), ("Bank", "x", "old"), ("A", "B", "unconditional"), ("US", "x", "unconditional")}
    assert [(r.entity, r.value) for r in done.states.collect()] == [("Debt", "1")]
    assert [r.note for r in done.flagged.collect()] == ["meta"] and done.rejected.count() == 2
    with pytest.raises(Exception, match="menu"):
        dispatch.decide(dispatch.with_chunk(guards.classify(rows), chunks), lambda c, g, t: ("nonsense", "{}")).collect()


def test_novelty_gate(spark):
    rows = novelty.with_claims(spark.createDataFrame([("a", "R", "b", 1), ("a", "R", "b", 2), ("c", "R", "d", 3)], "subject string, relation string, object string, seq long"))
    asked = novelty.classify(novelty.unique_claims(rows), lambda claims: [("novel" if c.startswith("a") else "known", {"novel": 0.75} if c.startswith("a") else {}) for c in claims])
    assert novelty.gate(rows, asked).count() == 2
    assert novelty.gate_counts(rows, asked).first().asDict() == {"candidates": 3, "unique_claims": 2, "kept": 2, "dropped": 1}
    assert novelty.mean_probabilities(asked).first().p == 0.375
    with pytest.raises(Exception, match="no verdict"):
        novelty.gate(rows, asked.limit(0)).collect()


def test_fact_checks(spark):
    rows = ledger_rows(spark, ("a", "R", "b", "s1:x", 0.5), ("c", "R", "d", "s2:x", 0.5)).withColumn("domain", F.lit("finance"))
    assert factcheck.domain_candidates(rows).count() == 2 and factcheck.notice(rows.where("subject = 'a'"), rows.where("subject = 'c'")) == "fact-check candidates in: finance"
    receipts = factcheck.fact_check(rows, lambda c: [{"url": "u", "text": c}], lambda c, r: {"verdict": "supported", "confidence": 0.9}, "m", "p", "2024")
    new, missing = factcheck.append_verdicts(rows.where("subject = 'a'"), receipts)
    assert [(r.subject, r.evidence_urls) for r in new.collect()] == [("a", ["u"])] and missing.first().missing == 1
    with pytest.raises(Exception, match="invalid verdict"):
        factcheck.fact_check(rows, lambda c: [], lambda c, r: {"verdict": "maybe", "confidence": 1}, "m", "p", "2024").collect()


def test_ingest_end_to_end_over_the_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("ATTESTA_HOME", str(tmp_path / "home"))
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "note.md").write_text("# Top\nThe Fed funds Banks.\n# More\nApproval is 42.")
    (docs / "skip.txt").write_text("x")

    def extract(chunk):
        base = {"confidence": 0.8, "evidence": "seen", "scope_conditions": "always", "source_ref": chunk["source_ref"]}
        if "funds" in chunk["text"]:
            return [("propose_triple", base | {"subject": "The Fed", "subject_type": "central_bank", "relation": "finances", "object": "Banks", "object_type": "organization", "domain": "finance"}), ("propose_triple", base | {"subject": "", "relation": "x"}), ("other", {})]
        return [("propose_state", base | {"entity": "Leader", "entity_type": "politician", "state_key": "popularity", "value": "42", "unit": "%", "as_of": "2024"})]

    seams = cli.Seams(extract=extract, embed=lambda t: [1.0, 0.0] if "Fed" in t else [0.0, 1.0])
    run = lambda *a: cli.main(list(a), seams, spark)
    assert run("check") == 1 and run("init") == 0 and run("check") == 0
    assert run("ingest", str(docs)) == 4  # nobody approved
    store = Store(spark, str(tmp_path / "home" / "store"))
    assert store.table("ledger").count() == 0 and store.table("rejected").count() >= 1
    assert run("ingest", str(docs), "--yes") == 0
    row = store.table("ledger").first()
    assert (row.subject, row.relation, row.object, row.raw_relation, row.source_id) == ("The Fed", "FUNDS", "Banks", "finances", None) or row.relation == "FUNDS"
    assert [(r.entity_type, r.state_key, r.value) for r in store.table("state_events").collect()] == [("person", "approval_rating", "42")]
    before = sorted(map(tuple, store.table("arrows").select("subject", "relation", "object", "confidence").collect()))
    assert run("ingest", str(docs), "--yes") == 0  # keep-first: nothing new
    assert sorted(map(tuple, store.table("arrows").select("subject", "relation", "object", "confidence").collect())) == before and store.table("ledger").count() == 1
    assert run("query", "directions", "the fed") == 0 and "Banks" in capsys.readouterr().out
    assert run("entity", "show", "The Fed") == 0 and run("entity", "show", "Nobody") == 1
    assert run("normalize-relations") == 0 and run("migrate-ledger") == 0 and run("backfill-sources") == 0 and run("backfill-evidence-embeddings") == 0
    assert store.table("ledger").where("evidence_embedding IS NULL").count() == 0
    assert run("query", "event", "money", "--top-k", "1") == 0 and run("query", "entity", "x", "--top-k", "0") == 2
    assert run("fact-check", "--domain", "finance", "--source", "x") == 2 and run("reset") == 2 and run("reset", "--yes") == 0


def test_ingest_stores_vectors_of_entities_and_evidence(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("ATTESTA_HOME", str(tmp_path / "home"))
    first, second = tmp_path / "first.md", tmp_path / "second.md"
    first.write_text("# Top\nThe Fed funds Banks.\n# More\nApproval is 42.")
    second.write_text("# Top\nEccles House funds Banks.")

    def extract(chunk):
        base = {"confidence": 0.8, "evidence": "seen", "scope_conditions": "always", "source_ref": chunk["source_ref"]}
        if "42" in chunk["text"]:
            return [("propose_state", base | {"entity": "Leader", "entity_type": "politician", "state_key": "popularity", "value": "42", "unit": "%", "as_of": "2024"})]
        who = "The Fed" if "Fed" in chunk["text"] else "Eccles House"
        return [("propose_triple", base | {"subject": who, "subject_type": "central_bank", "relation": "finances", "object": "Banks", "object_type": "organization", "evidence": "seen" if who == "The Fed" else "broken", "domain": "finance"})]

    def embed(text):
        if text == "broken":
            raise OSError("no model")
        return {"seen": [0.5, 0.5], "Banks": [0.0, 1.0]}.get(text, [1.0, 0.0])

    run = lambda *a: cli.main(list(a), cli.Seams(extract=extract, embed=embed), spark)
    assert run("init") == 0 and run("ingest", str(first), "--yes") == 0
    store = Store(spark, str(tmp_path / "home" / "store"))
    vectors = lambda: {r.name: r.embedding for r in store.table("entities").where("name <> 'Leader'").collect()}
    assert vectors() == {"The Fed": [1.0, 0.0], "Banks": [0.0, 1.0]}
    for table in ("ledger", "state_events"):
        assert [r.evidence_embedding for r in store.table(table).collect()] == [[0.5, 0.5]]
    assert run("ingest", str(second), "--yes") == 0  # a paraphrase finds the stored vector; a failing embedder leaves null
    assert vectors() == {"The Fed": [1.0, 0.0], "Banks": [0.0, 1.0]}
    rows = store.table("ledger").orderBy("seq").collect()
    assert [(r.subject, r.evidence_embedding) for r in rows] == [("The Fed", [0.5, 0.5]), ("The Fed", None)]


def test_flagged_candidates_go_on_without_a_decision_model(spark, tmp_path):
    def extract(chunk):
        base = {"subject_type": "organization", "relation": "supports", "object": "Paris", "object_type": "place", "confidence": 0.5, "evidence": "seen", "scope_conditions": "always", "source_ref": chunk["source_ref"], "domain": "finance"}
        return [("propose_triple", base | {"subject": s}) for s in ("Ann", "$5 trillion")]

    chunks = chunking.chunk_markdown(spark.createDataFrame([("d.md", "# A\nx")], "source_id string, text string"))
    tables = {"entities": spark.createDataFrame([], ENTITIES), "arrows": spark.createDataFrame([], ARROWS)}
    delta = ingest.propose(spark, chunks, tables, registry.packaged_table(spark), ingest.Models(extract), str(tmp_path))
    assert {r.subject for r in delta.new_edges.collect()} == {"Ann", "$5 trillion"} and delta.rejected.count() == 0


def test_states_land_on_the_entities_of_triples(spark, tmp_path, now):
    def extract(chunk):
        base = {"confidence": 0.5, "evidence": "seen", "scope_conditions": "always", "source_ref": chunk["source_ref"]}
        state = base | {"entity_type": "politician", "state_key": "popularity", "unit": "%", "as_of": "2024"}
        triple = base | {"subject": "Ann Smith", "subject_type": "politician", "relation": "supports", "object": "Paris", "object_type": "place", "domain": "finance"}
        return [("propose_triple", triple), ("propose_state", state | {"entity": " ANN SMITH! ", "value": "42"}), ("propose_state", state | {"entity": "Zoe", "value": "7"})]

    store = Store(spark, str(tmp_path / "store"))
    store.apply_schema()
    chunks = chunking.chunk_markdown(spark.createDataFrame([("d.md", "# A\nx")], "source_id string, text string"))
    reg = registry.packaged_table(spark)
    delta = ingest.propose(spark, chunks, {n: store.table(n) for n in ("entities", "arrows", "ledger")}, reg, ingest.Models(extract), str(tmp_path / "work"))
    ingest.commit(store, delta, reg, now)
    assert {(r.entity, r.value) for r in store.table("state_events").collect()} == {("Ann Smith", "42"), ("Zoe", "7")}
    assert sorted(r.name for r in store.table("entities").collect()) == ["Ann Smith", "Paris", "Zoe"]


def test_scan(spark):
    chunks = chunking.chunk_markdown(spark.createDataFrame([("d.md", "# A\nx\n# B\ny\n# C\nz")], "source_id string, text string"))
    found = ingest.scan(chunks, lambda text: {"verbs": ["Leads To", "orbits", "HEDGES"], "entities": [{"name": "Fed", "type": "central_bank"}]}, 2)
    assert found.count() == 2
    reg = registry.packaged_table(spark)
    anchored = ingest.anchor_verbs(found, reg, spark.createDataFrame([("HEDGES",)], "relation string"))
    assert {(r.verb, r.anchor, r.origin) for r in anchored.collect()} == {("leads_to", "causes", "registry"), ("orbits", None, "unmatched"), ("hedges", "hedges", "graph")}
    assert [r.verb for r in ingest.verb_menu(anchored).collect()] == ["causes", "hedges"]
    roster, aliases = ingest.anchor_entities(found, spark.createDataFrame([("Fed", "organization", ["the Fed"], None, None, None)], ENTITIES), reg)
    assert [(r.name, r.type) for r in roster.collect()] == [("Fed", "organization")] and aliases.count() == 0
