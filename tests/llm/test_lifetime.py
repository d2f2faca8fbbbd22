"""Results outlive the objects they came from: what a derived DataFrame reads must still be there."""

import gc

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ("op1_warc_transactions", "op4_best_fit_packing", "op5_token_id_files", "op6_vector_bin_shards", "op8_minhash_near_duplicates", "op10_suffix_array_dedup", "pipeline")


@pytest.mark.parametrize("name", NAMES)
def test_a_derived_result_survives_its_root(spark, name):
    root = entry.queries()[name](spark, SF)
    derived = root.select("*").where("true")
    del root
    gc.collect()
    assert derived.count() > 0
