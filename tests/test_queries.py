"""Registered queries against their check SQL on the smallest tables.

All of them with BILLWEAVE_ALL_QUERIES=1, else one of every kind.
"""

import os

import pytest
from oracle import connect, differences

SF = "/root/testdata/sf0.001"
CORE = [
    "pattern_variants", "extract_sections_sameline", "goods_lines_blocks", "three_level_check", "column_blocks",
    "tag_goods_lines", "business_dedup", "outcome_rollup", "job_status", "scalar_helpers", "normalize_date",
    "normalize_amount", "normalize_code_width", "classify_route", "scan_documents", "admission_check", "magic_check",
    "failure_reasons", "path_order", "custom_mapping", "mapped_goods", "plugged_parser", "goods_lines_text",
    "goods_precedence", "text_source_choice", "recognised_reading_order", "block_source", "unplaced_text",
    "assist_answers", "assist_context", "incremental_ingest", "arriving_bytes", "listed_types", "sql_object_text",
    "flat_goods_lines", "one_page_lines", "assist_queue", "stored_answers",
]


def names():
    from billweave.plans.catalog import CHECK_SQL

    return list(CHECK_SQL) if os.environ.get("BILLWEAVE_ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from billweave.plans.catalog import CHECK_SQL, QUERIES

    assert differences(QUERIES[name](spark, SF), con, CHECK_SQL[name]) == ""


def test_every_query_has_check_sql():
    import __spark_entry__ as entry_points
    from billweave.plans.catalog import CHECK_SQL, QUERIES

    assert set(QUERIES) == set(CHECK_SQL) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    import __spark_entry__ as entry_points

    assert entry_points.entry(spark).limit(5).count() == 5
