import pytest
import yaml
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.operators import canonical, contracts, guards
from attesta.sources import chunking, registry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("ref, want", [("book-1:chapter-2/section-3/page-14", "book-1"), ("doc:chunk-1:extra", "doc"), ("a.b_c-d:x", "a.b_c-d")])
def test_source_ids(spark, ref, want):
    assert one(spark, S.source_id(F.lit(ref))) == want


@pytest.mark.parametrize("ref", ["chunk-1", "", ":chunk-1", "bad id:x", "book 1:x", "book :x"])
def test_bad_source_ids(spark, ref):
    with pytest.raises(Exception, match="not a source reference"):
        one(spark, S.source_id(F.lit(ref)))


def test_names_claims_and_vectors(spark):
    assert one(spark, S.normalize_name(F.lit("  The FED! "))) == "the fed"
    assert one(spark, S.normalize_name(F.lit("Straße"))) == "strasse"
    assert one(spark, S.normalize_verb(F.lit(" !! "))) == "unknown" and one(spark, S.normalize_candidate(F.lit("A b"))) == "a_b"
    assert one(spark, S.claim(F.lit("A"), F.lit("PART_OF"), F.lit("B"))) == "A part of B"
    assert one(spark, S.state_claim(F.lit("X"), F.lit("approval_rating"), F.lit("42"))) == "X's approval_rating is 42"
    vec = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, S.cosine(vec(1.0, 0.0), vec(0.8, 0.5))) == pytest.approx(0.8479983)
    assert one(spark, S.cosine(vec(0.0, 0.0), vec(0.8, 0.5))) == 0.0
    assert one(spark, S.combine(F.lit(0.6), F.lit(0.5), F.lit(True))) == pytest.approx(0.8) and one(spark, S.combine(F.lit(0.6), F.lit(0.5), F.lit(False))) == 0.6
    assert one(spark, S.redirect_target(F.lit("//d/l/?uddg=https%3A%2F%2Fa.b%2Fc&rut=1"))) == "https://a.b/c"
    assert one(spark, S.clean_markup(F.lit("<b>a &amp; b</b>"))) == "a & b"


@pytest.mark.parametrize(
    "subject, object_, want",
    [
        ("$1 trillion", "Fed", ["numeric_endpoint"]), ("elevated", "Fed", ["qualitative_endpoint"]), ("one two three four five six seven", "Fed", ["clause"]), ("the US, Japan and Australia", "Fed", ["list"]),
        ("France and Canada", "Fed", ["compound_actor"]), ("previous video", "Fed", ["deictic"]), ("Fed", " fed ", ["self_loop"]), ("Bank (old)", "Germany's chancellor", ["description_in_name"]), ("Fed", "Bank of Japan", []), ("it", "42%", ["deictic", "numeric_endpoint"]),
    ],
)
def test_guards(spark, subject, object_, want):
    row = guards.classify(spark.createDataFrame([(subject, object_)], "subject string, object string")).first()
    assert row.guard_classes == want and row.primary_class == (want[0] if want else None)


def test_registry_canonical_forms(spark):
    reg = registry.packaged("relation")
    assert len(reg.entries) == 34 and reg.canonicalize("a", "replaces", "b") == ("a", "supersedes", "b", False)
    assert reg.canonicalize("a", "superseded_by", "b") == ("b", "supersedes", "a", True)
    assert reg.canonicalize("a", "may_describe", "b") == ("a", "may_describe", "b", False)
    assert reg.canonicalize("a", "eases", "b")[3] is False and registry.packaged("relation", parity=True).canonicalize("a", "eases", "b") == ("b", "increases", "a", True)
    assert registry.parse(yaml.safe_load(reg.dump())).document() == reg.document()
    df = spark.createDataFrame([("a", "Superseded_By", "b"), ("a", "MAY_DESCRIBE", "b")], "subject string, relation string, object string")
    got = [tuple(r) for r in canonical.canonicalize_triples(df, registry.packaged_table(spark)).select("subject", "relation", "object", "flipped", "relation_known").collect()]
    assert sorted(got) == [("a", "MAY_DESCRIBE", "b", False, False), ("b", "SUPERSEDES", "a", True, True)]


@pytest.mark.parametrize(
    "document, fragment",
    [
        ([], "mapping"), ({"labels": {}}, "version"), ({"version": 0, "labels": {}}, "version"), ({"version": True, "labels": {}}, "version"), ({"version": 1}, "labels"), ({"version": 1, "labels": []}, "mapping"),
        ({"version": 1, "labels": {}, "x": 1}, "unknown top-level"), ({"version": 1, "labels": {"Bad": None}}, "snake_case"), ({"version": 1, "labels": {"a": {"aliases": "b"}}}, "aliases"), ({"version": 1, "labels": {"a": {"aliases": ["B"]}}}, "aliases"),
        ({"version": 1, "labels": {"a": {"aliases": ["b", "b"]}}}, "duplicate"), ({"version": 1, "labels": {"a": {"aliases": ["b"]}, "b": None}}, "collides"), ({"version": 1, "labels": {"a": {"inverse": "a"}}}, "own inverse"),
        ({"version": 1, "labels": {"a": {"inverse": "c"}}}, "not a canonical"), ({"version": 1, "labels": {"a": {"inverse": "b"}, "b": {"inverse": "a"}}}, "twice"), ({"version": 1, "labels": {"a": {"inverse": "c"}, "b": {"inverse": "c"}, "c": None}}, "two labels"),
        ({"version": 1, "labels": {"a": {"zzz": 1}}}, "unknown keys"), ({"version": 1, "labels": {"a": None}, "proposed": {"labels": {"a": None}}}, "defined twice"), ({"version": 1, "labels": {}, "proposed": []}, "proposed"),
    ],
)
def test_malformed_registries(document, fragment):
    with pytest.raises(registry.RegistryError, match=fragment):
        registry.parse(document)


def test_staging_and_promotion(tmp_path):
    path = registry.ensure_working(str(tmp_path / "r" / "relations.yaml"), "relation")
    assert registry.stage(path, ["Orbits", "causes", "unknown", "leads_to", "orbits"]) == ["orbits"] and registry.stage(path, ["orbits"]) == []
    assert registry.promote(path) == ["orbits"] and registry.load(path).staged_labels() == ["orbits"]
    assert registry.promote(path, apply=True) == ["orbits"] and registry.load(path).staged_labels() == [] and registry.load(path).is_known("orbits")


def test_markdown_chunks(spark):
    text = "before\n# Chapter\nintro\n## Section\nbody\n### Deep\nx\n# Next\ny"
    rows = chunking.chunk_markdown(spark.createDataFrame([("markdown", text), ("empty", "")], "source_id string, text string")).orderBy("ordinal").collect()
    assert [(r.section_path, r.source_ref) for r in rows] == [
        ([], "markdown:chunk-1"), (["Chapter"], "markdown:chunk-2"), (["Chapter", "Section"], "markdown:chunk-3"), (["Chapter", "Section", "Deep"], "markdown:chunk-4"), (["Next"], "markdown:chunk-5")
    ]
    assert rows[2].text == "## Section\nbody"


def test_page_chunks(spark):
    pages = [("a", ["First one.\n\nSecond one.", "Third."]), ("b", ["A paragraph that", "goes on."]), ("c", ["It ends in a comma,", "1.2 Heading here"]), ("d", [])]
    rows = chunking.chunk_pages(spark.createDataFrame(pages, "source_id string, pages array<string>")).orderBy("source_id", "ordinal").collect()
    assert [(r.source_id, r.text, r.pages) for r in rows] == [
        ("a", "First one.", [1]), ("a", "Second one.", [1]), ("a", "Third.", [2]), ("b", "A paragraph that\ngoes on.", [1, 2]), ("c", "It ends in a comma,", [1]), ("c", "1.2 Heading here", [2])
    ]


def test_contracts(spark):
    good = ("A", "person", "funds", "B", "place", 0.5, "seen", "always", "d:chunk-1", None)
    bad = ("  ", "Person", "funds", "B", "place", 1.5, "seen", "", "d:chunk-1", "Two Words")
    ddl = "subject string, subject_type string, relation string, object string, object_type string, confidence double, evidence string, scope_conditions string, source_ref string, domain string"
    valid, rejected = contracts.split_valid(contracts.check_triples(spark.createDataFrame([good, bad], ddl)))
    assert valid.count() == 1
    reason = rejected.first().reason
    assert all(x in reason for x in ("subject must", "scope_conditions must", "subject_type must", "confidence must", "domain must"))


def test_a_document_is_split_once_whatever_its_chunks_read(spark):
    docs = spark.range(1).select(F.col("id").cast("string").alias("source_id"), F.concat_ws("\n", F.col("id").cast("string"), F.lit("# B"), F.lit("x"), F.lit("### C")).alias("text"))
    found = chunking.chunk_markdown(docs)
    assert [(r.text, r.section_path) for r in found.orderBy("ordinal").collect()] == [("0", []), ("# B\nx", ["B"]), ("### C", ["B", "C"])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
