"""The driver contract, checked on the smallest data for one query of every module."""

import os

import pytest

import __spark_entry__ as contract
from tagloom.plans import catalog
from tools.check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "c08_prioritise", "c21_deoverlap", "c25_with_artist", "c36_optimise", "p14_track_everything", "m01_booru_metadata", "u07_merge_append",
    "f03_tags_regex", "f03_search_page", "j05_post_tags", "j07_diff", "j08_defeature", "a02_tag_frequency", "a04_features_from_counts",
    "o12_index_delta", "s08_first_source_wins", "w02_split_ratio", "w04_batches_shuffled", "o01_sort_multi_reverse",
    "x02_drop_near_duplicates", "s04_s13_csv_round_trip",
]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not there")


def test_every_query_is_checked_by_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_data
def test_entry(spark):
    assert contract.entry(spark).columns == ["image_key", "aesthetic_score", "safe_level"]


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name).startswith("ok")


@needs_data
@pytest.mark.parametrize("name", ["f03_tags_any", "a01_inverted_index", "x02_near_pairs", "w04_batches_shuffled", "j07_diff", "o04_upsert"])
def test_no_nested_loops(spark, name):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
