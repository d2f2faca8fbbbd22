import duckdb
import pytest

import __spark_entry__ as entry
from attesta import queries as graph

SF, BIGGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", graph.oracle_sql())
def test_query_equals_its_sql(spark, duck, name):
    df = graph.queries()[name](spark, SF)
    want = duck.sql(graph.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    key = lambda rows: sorted(repr(tuple(rows_)) for rows_ in rows)
    assert key(df.select(*cols).collect()) == key(want.select(*cols).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_fuzzy_pairs_equal_brute_force(spark):
    from attesta.operators.resolution import best_ratio, norm

    rows = {(r.type, r.name) for r in graph.titles(spark, BIGGER).collect()}
    want = {(t, a, b) for t, a in rows for u, b in rows if t == u and a < b and best_ratio(norm(a), [norm(b)]) >= 0.90}
    assert {(r.type, r.a_name, r.b_name) for r in graph.fuzzy_pairs(spark, BIGGER).collect()} == want and want


def test_resolution_cascade_equals_one_fold_over_each_session_and_type(spark):
    from attesta.operators.resolution import resolve_group

    mentions, entities = graph.title_mentions(spark, BIGGER).toPandas(), graph.title_entities(spark, BIGGER).toPandas()
    want = []
    for (_, kind), own in mentions.groupby(["session", "type"]):
        want += resolve_group(own, entities[entities.type == kind].drop(columns="type"))[["session", "type", "seq", "mention", "outcome", "canonical", "layer"]].itertuples(index=False, name=None)
    got = [tuple(r) for r in graph.resolution_cascade(spark, BIGGER).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({layer for *_, layer in got}) >= 3
