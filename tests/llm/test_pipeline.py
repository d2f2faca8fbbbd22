import shutil

import pytest
from helpers import frame, prose

import __spark_entry__ as entry
import corpus_pipeline
from attesta.llm import spaced_seeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with one case of each kind beside clean documents."""
    at = tmp_path_factory.mktemp("tables")
    r = [prose(i, 120) for i in range(40)]
    leak, passage = prose(900, 30), prose(901, 70)
    texts = r + [r[0], r[1].replace("alpha", "omega", 1), prose(41, 50) + " " + leak + " " + prose(42, 50), f"{prose(43, 80)} {passage} {prose(44, 80)}", f"{prose(45, 80)} {passage} {prose(46, 80)}", None, ""]
    texts += [prose(100 + i, 60) + " vermin idiotic" for i in range(40)]
    docs = frame(spark, texts)
    docs.write.parquet(f"{at}/documents.parquet")
    toxic = [(i, int(i >= 47)) for i in range(len(texts))]
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    yield str(at), texts, passage
    shutil.rmtree(at)


def test_each_stage_takes_out_its_cases_and_nothing_else(spark, small):
    sf, texts, passage = small
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        seen[name] = out.collect()
        if k < 4:
            assert out.columns == docs.columns
            docs = out
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert ids["toxicity"] == set(range(47))
    assert ids["minhash_near_dedup"] == set(range(47)) - {40, 41}
    assert ids["suffix_array_dedup"] == ids["minhash_near_dedup"]
    cut = {r.doc_id: r for r in seen["suffix_array_dedup"]}
    assert all(passage not in cut[i].text and cut[i].n_chars == len(cut[i].text) for i in (43, 44))
    assert all(cut[i].text == texts[i] for i in range(40))
    assert ids["benchmark_decontamination"] == ids["suffix_array_dedup"] - {42}
    assert {r.doc_id for r in seen["best_fit_packing"]} == ids["benchmark_decontamination"]


def test_repeated_rows_and_copies_without_ids_are_reduced_to_one_whole_text(spark):
    r = [prose(700 + i, 120) for i in range(6)]
    near = r[2].replace("alpha", "omega", 1)
    texts = [r[0], r[0], r[1], r[1], r[2], near, near, r[3], r[3], r[4], r[5], None, None, ""]
    ids = [5, 5, 7, None, 9, None, 3, None, None, 11, 3, 5, None, 7]
    docs = frame(spark, texts, ids)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    key = lambda rows: sorted(rows, key=repr)
    want = key([(5, r[0]), (7, r[1]), (3, near), (None, r[3]), (11, r[4]), (3, r[5]), (5, None), (None, None), (7, "")])
    assert key((x.doc_id, x.text) for x in kept.collect()) == want
    cut = corpus_pipeline.cut_repeats(spark, kept, SF)
    assert key((x.doc_id, x.text) for x in cut.collect()) == want


def test_contamination_is_judged_by_row(spark, small):
    sf, texts, _ = small
    clean, other, leaked = texts[0], texts[1], texts[42]
    rows = frame(spark, [clean, leaked, leaked, other, leaked, None, ""], [1, 1, None, 2, 2, None, 1])
    kept = corpus_pipeline.drop_contaminated(spark, rows, sf)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, clean), (2, other), (None, None), (1, "")], key=repr)


def test_toxicity_and_packing_take_rows_with_null_and_shared_ids(spark, small):
    sf, texts, _ = small
    rows = frame(spark, [texts[0], texts[-1], texts[-1], texts[0], None, texts[0] * 200], [1, 1, None, None, None, 1])
    kept = corpus_pipeline.drop_toxic(spark, rows, sf)
    assert sorted(((r.doc_id, len(r.text or "")) for r in kept.collect()), key=repr) == sorted([(1, len(texts[0])), (None, len(texts[0])), (None, 0), (1, 200 * len(texts[0]))], key=repr)
    packed = corpus_pipeline.pack_sequences(spark, kept, sf).collect()
    assert sum(r.piece == 0 for r in packed) == 4 and {r.doc_id for r in packed} == {1, None}


def test_run_gives_the_rows_of_the_last_stage(spark, small):
    sf, *_ = small
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(range(47)) - {40, 41, 42}
    assert rows[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_empty_tables(spark, small):
    sf, *_ = small
    empty = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_every_operator_has_its_query():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", [k for k in entry.queries() if k.startswith("op")])
def test_queries_run_on_the_smallest_tables(spark, name):
    table = {"op1": "pages", "op7": "pages"}.get(name.split("_")[0], "documents")
    n = entry.queries()[name](spark, SF).count()
    if name.startswith("op9"):
        docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
        assert n == spaced_seeds.contaminated(docs, items).count()
    elif name.startswith("op13"):
        assert n == 8 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    elif name.startswith(("op4", "op12")):
        assert n >= spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
