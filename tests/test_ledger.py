import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.operators import ledger
from attesta.schemas import IDENTITY

ROW = "subject string, relation string, object string, source_ref string, confidence double, evidence string, scope_conditions string, domain string, raw_relation string, seq long, created_at timestamp, updated_at timestamp"


def rows(spark, *items):
    """(source_ref, confidence[, scope]) of the triple (a, SUPPORTS, b), in order."""
    data = [("a", "SUPPORTS", "b", r[0], r[1], f"e{i}", r[2] if len(r) > 2 else "", "", "supports", i, None, None) for i, r in enumerate(items)]
    return spark.createDataFrame(data, ROW)


@pytest.mark.parametrize("values, want", [([0.5], 0.5), ([0.6, 0.5], 0.8), ([0.5, 0.5, 0.5], 0.875), ([2.0, 2.0], 1.0), ([-1.0, 0.5], 0.5)])
def test_complement_aggregate(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "confidence double")
    assert df.agg(ledger.complement()).first()[0] == pytest.approx(want, abs=1e-12)
    assert spark.createDataFrame([(values,)], "c array<double>").select(ledger.complement_of("c")).first()[0] == pytest.approx(want, abs=1e-12)


def test_complement_of_nothing(spark):
    assert spark.createDataFrame([([],)], "c array<double>").select(ledger.complement_of("c")).first()[0] == 0.0


@pytest.mark.parametrize(
    "existing, candidates, mode, actions, arrow",
    [
        ([], [("s1", 0.7, "when armed")], "keep-first", ["create"], (0.7, "when armed")),
        ([("s1", 0.5)], [("s1", 0.9)], "keep-first", ["skip"], (0.5, None)),
        ([], [("s1", 0.5), ("s1", 0.9)], "keep-first", ["create", "skip"], (0.5, "")),
        ([("s1", 0.6)], [("s2", 0.5)], "keep-first", ["create"], (0.8, "")),
        ([("s1", 0.5, "old scope")], [("s1", 0.9, "new scope")], "refresh", ["update"], (0.9, "new scope")),
        ([("s1", 0.5), ("s2", 0.5)], [("s1", 0.9)], "refresh", ["update"], (0.95, "")),
        ([], [("s1", 0.5), ("s1", 0.9)], "refresh", ["skip", "create"], (0.9, "")),
    ],
)
def test_write_plans(spark, existing, candidates, mode, actions, arrow):
    old, new = rows(spark, *existing), rows(spark, *candidates)
    plan = ledger.plan_writes(old, new, mode)
    assert [r.action for r in plan.orderBy("seq").collect()] == actions
    got = ledger.planned_arrows(old, plan).first()
    assert got.confidence == pytest.approx(arrow[0]) and got.scope_conditions == arrow[1]


def test_apply_is_idempotent_and_keeps_creation_times(spark):
    now, later = (F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-02-01"))
    new = rows(spark, ("s1", 0.5), ("s2", 0.4))
    first = ledger.apply_plan(new.limit(0), ledger.plan_writes(new.limit(0), new), now)
    again = ledger.apply_plan(first, ledger.plan_writes(first, new), later)
    view = lambda df: sorted(tuple(r) for r in df.select(*IDENTITY, "confidence", "created_at").collect())
    assert view(first) == view(again) and first.count() == 2
    refreshed = ledger.apply_plan(first, ledger.plan_writes(first, rows(spark, ("s1", 0.9)), "refresh"), later)
    assert {(r.source_ref, r.confidence) for r in refreshed.collect()} == {("s1", 0.9), ("s2", 0.4)}
    assert {str(r.created_at)[:10] for r in refreshed.collect()} == {"2024-01-01"}


@settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=1, max_size=5))
def test_complement_does_not_depend_on_order(spark, values):
    found = set()
    for p in itertools.islice(itertools.permutations(values), 6):
        found.add(round(spark.createDataFrame([(list(p),)], "c array<double>").select(ledger.complement_of("c")).first()[0], 9))
    assert len(found) == 1


def test_reduce_edges_counts_each_source_once(spark):
    data = [("a", "R", "b", "s1", 0.5, ["x"], "", ""), ("a", "R", "b", "s1", 0.9, ["y"], "sc", "d"), ("a", "R", "b", "s2", 0.5, None, "", ""), ("a", "R", "b", "", 0.9, [], "", "")]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(data)], "subject string, relation string, object string, source_ref string, confidence double, evidence array<string>, scope_conditions string, domain string, seq long")
    r = ledger.reduce_edges(df).first()
    assert r.confidence == pytest.approx(0.75) and r.evidence == ["x", "y", "s2"] and (r.source_ref, r.scope_conditions, r.domain) == ("s2", "sc", "d")


def test_modes_and_plans_stay_in_the_jvm(spark):
    assert ledger.repeat_mode(" Refresh ") == "refresh" and ledger.repeat_mode(None) == "keep-first"
    with pytest.raises(ValueError):
        ledger.repeat_mode("append")
    plan = ledger.arrows(rows(spark, ("s1", 0.5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "HashAggregate" in plan or "ObjectHashAggregate" in plan or "SortAggregate" in plan
