"""How rows are dealt in steps that many queries share."""

from attesta import queries as graph
from attesta.operators import factcheck, ledger

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_are_grouped_where_the_join_has_dealt_the_lines(spark):
    found = plan(graph.claims(spark, SF))
    assert "hashpartitioning(l_orderkey" in found
    assert "hashpartitioning(subject" not in found and "hashpartitioning(s_name" not in found


def test_ledger_is_worked_out_once_where_it_is_read_twice(spark):
    for query in (graph.backfill_candidates, graph.strip_candidates, graph.delta_changed_edges, graph.write_plan_refresh, graph.verdict_walk, graph.novelty_counts, graph.factcheck_candidates):
        assert "lineitem.parquet" not in plan(query(spark, SF)), query.__name__


def test_rows_of_checked_domains_are_not_dealt_by_domain(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "R", str(i), f"d{i % 3}:x", "one" if i % 4 else "two", i) for i in range(40)] + [("a", "R", "z", "d9:x", "alone", 40)], "subject string, relation string, object string, source_ref string, domain string, seq long")
    mine = rows.where("source_ref = 'd0:x'"), rows.where("source_ref <> 'd0:x'")
    few = [sorted(map(tuple, df.collect())) for df in (factcheck.candidates_for_write(*mine), factcheck.domain_candidates(rows))]
    assert "hashpartitioning(domain" not in plan(factcheck.candidates_for_write(*mine)) and [len(x) for x in few] == [40, 40]
    monkeypatch.setattr(factcheck, "FEW_DOMAINS", 0)
    assert [sorted(map(tuple, df.collect())) for df in (factcheck.candidates_for_write(*mine), factcheck.domain_candidates(rows))] == few


def test_ledger_is_dealt_once_before_it_is_spelled_out(spark):
    for query in (graph.arrows_complement, graph.normalize_relations_plan, graph.ledger_refresh):
        above, *below = plan(query(spark, SF)).split("Exchange hashpartitioning(subject")
        assert len(below) == 1 and "lpad(" in above and "lpad(" not in below[0], query.__name__


def test_write_plans_deal_keys_and_not_what_follows_from_them(spark):
    found = plan(graph.write_plan_keep_first(spark, SF))
    assert "evidence" not in "".join(line for line in found.splitlines() if "FileScan" in line)
    assert found.count("Exchange hashpartitioning(subject") == 2 and "lpad(" not in found.split("REPARTITION_BY_COL")[1]


def test_only_columns_that_a_query_uses_are_written(spark):
    assert not {"seq", "source_ref", "scope_conditions"} & set(plan(graph.backfill_candidates(spark, SF)).replace("#", " ").replace(",", " ").replace("[", " ").split())
    triples = spark.createDataFrame([("a", "R", "b", 0.5), ("a", "R", "b", 0.5)], "subject string, relation string, object string, confidence double")
    assert [r.asDict() for r in ledger.arrows(triples).collect()] == [{"subject": "a", "relation": "R", "object": "b", "confidence": 0.75, "n_rows": 2}]


def test_novelty_counts_deal_counted_claims(spark):
    found = plan(graph.novelty_counts(spark, SF))
    assert "FileScan parquet [claim" in found and "seq" not in found.split("FileScan")[1].split("]")[0]
    for line in found.splitlines():
        assert "partial_count(1)" not in line or "claim" not in line.split("keys=")[-1].split("]")[0], line
