import pytest
from pyspark.sql import functions as F

from attesta.operators.numbering import numbered
from attesta.plans import ingest
from attesta.schemas import ENTITIES
from attesta.sources import chunking, registry
from attesta.store import Store


@pytest.fixture
def once(spark, tmp_path):
    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    return keep


def chunks_of(spark, **texts):
    return chunking.chunk_markdown(spark.createDataFrame(list(texts.items()), "source_id string, text string"))


def test_numbers_are_gapless_in_order(spark):
    rows = spark.range(5000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(97)))
    found = numbered(rows, ["k", "id"]).collect()
    assert [(r.k, r.id) for r in sorted(found, key=lambda r: r.seq)] == sorted((r.k, r.id) for r in found)
    assert sorted(r.seq for r in found) == list(range(1, 5001))
    assert numbered(rows.limit(0), ["k"]).count() == 0
    tied = numbered(spark.createDataFrame([(None,), ("a",), ("a",), (None,)], "k string"), ["k"]).collect()  # nulls first, ties next to one another
    assert [r.k for r in sorted(tied, key=lambda r: r.seq)] == [None, None, "a", "a"]


def test_scan_pass(spark, once):
    """Known verbs and names anchor, one call a source groups the rest, its names give way to anchored ones, its new verbs are staged."""
    calls = spark.sparkContext.accumulator(0)

    def inventory(text):
        if "quiet" in text:
            return {"verbs": None, "entities": []}
        return {"verbs": ["Leads To", "orbits", "HEDGES", "--", None], "entities": [{"name": " the FED ", "type": "central_bank"}, {"name": "Zebra", "type": None}, {"name": "Zebra", "type": ""}, {"name": " ", "type": "x"}]}

    def cluster(verbs, entities):
        calls.add(1)
        assert verbs == ["orbits"] and entities == [{"name": "Zebra", "type": "concept"}]
        return {"verbs": [{"canonical": "Circles Around", "aliases": ["orbits"]}, {"canonical": "causes", "aliases": []}, {"canonical": " ", "aliases": None}], "entities": [{"canonical": "zebra", "entity_type": "x", "aliases": []}, {"canonical": "New One", "entity_type": "", "aliases": ["N1"]}, {"canonical": "", "entity_type": "x", "aliases": []}]}

    store = spark.createDataFrame([("Federal Reserve", "organization", ["the Fed"], None, None, None)], ENTITIES)
    live = spark.createDataFrame([("HEDGES",)], "relation string")
    found = ingest.scan_pass(chunks_of(spark, a="# A\nx\n# B\ny", q="quiet"), store, live, registry.packaged_table(spark), inventory, once, cluster, size=1)
    hints = {r.source_id: r for r in found.hints.select("*", ingest.render_roster("entity_roster").alias("lines")).collect()}
    assert hints["a"].verb_menu == ["causes", "circles_around", "hedges"]
    assert hints["a"].lines == ["Federal Reserve (organization; aka: the Fed, the FED)", "Zebra (concept)", "New One (concept; aka: N1)"]
    assert (hints["a"].scan_calls, hints["a"].cluster_calls) == (2, 1)
    assert (hints["q"].verb_menu, hints["q"].lines, hints["q"].scan_calls, hints["q"].cluster_calls) == ([], [], 1, 0)
    assert [r.verb for r in found.staged.collect()] == ["circles_around"]
    assert calls.value == 1


def test_verbs_anchor_without_a_source(spark):
    inventory = spark.createDataFrame([(["Leads To", "leads_to", None],), (["HEDGES", "orbits", "--"],)], "verbs array<string>")
    found = ingest.anchor_verbs(inventory, registry.packaged_table(spark), spark.createDataFrame([("hedges",)], "relation string"))
    assert sorted(map(tuple, found.collect())) == [("hedges", "hedges", "graph"), ("leads_to", "causes", "registry"), ("orbits", None, "unmatched")]


def test_an_ingest_whose_scan_fails_writes_nothing_and_extracts_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.apply_schema()
    before = store.pointer()
    asked = spark.sparkContext.accumulator(0)
    models = ingest.Models(lambda chunk: asked.add(1) or [], inventory=lambda text: None)
    with pytest.raises(Exception, match="scan call gave no answer"):
        ingest.propose(spark, chunks_of(spark, d="x"), {n: store.table(n) for n in ("entities", "arrows", "ledger")}, registry.packaged_table(spark), models, str(tmp_path / "work"))
    assert store.pointer() == before and asked.value == 0


def test_prompts_offer_menu_and_roster():
    chunk = {"source_ref": "d:chunk-1", "section_path": ["A"], "text": "x", "verb_menu": ["causes", "hedges"], "entity_roster": ["Fed (organization)", "Zebra (concept)"]}
    assert ingest.prompt(chunk) == "source_ref: d:chunk-1\nsection: A\nknown entities: Fed (organization); Zebra (concept)\nrelations: causes, hedges\nx"
    assert ingest.prompt({"source_ref": "d:chunk-1", "section_path": None, "text": "x", "verb_menu": None}) == "source_ref: d:chunk-1\nx"


def test_review_edits_the_first_new_edge(spark):
    rows = [("a", "R", "b", 0.5, "d", 1), ("a", "R", "b", 0.5, "d", 3), ("c", "R", "d", 0.5, "d", 2)]
    candidates = spark.createDataFrame(rows, "subject string, relation string, object string, confidence double, source_id string, seq long")
    edges = candidates.groupBy("subject", "relation", "object").agg(F.max("confidence").alias("confidence"))
    delta = ingest.Delta(edges, edges, edges, candidates, edges, edges, edges, edges)
    answers = iter(["what", "edit", "many", "e", "1.5", "e", "0.25", " Approve "])
    decision, edited = ingest.review(delta, lambda _: next(answers))
    assert decision == "approve"
    assert {(r.subject, r.confidence) for r in edited.new_edges.collect()} == {("a", 0.25), ("c", 0.5)}
    assert sorted((r.subject, r.seq, r.confidence) for r in edited.candidates.collect()) == [("a", 1, 0.25), ("c", 2, 0.5)]
    assert ingest.review(delta, lambda _: None)[0] == "reject"
    assert ingest.first_new_edge(ingest.Delta(edges.limit(0), edges, edges, candidates, edges, edges, edges, edges)) is None


def test_references_outside_the_grammar_are_errors(spark):
    rows = spark.createDataFrame([("book-1:p", "x"), ("", "kept"), (None, "kept")], "source_ref string, source_id string")
    assert sorted(r.source_id for r in ingest._with_sources(rows).collect()) == ["book-1", "kept", "kept"]
    with pytest.raises(Exception, match="not a source reference"):
        ingest._with_sources(spark.createDataFrame([("no source", "x")], rows.schema)).select("source_ref").collect()
