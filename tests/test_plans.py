"""What the plans must and must not contain, and the registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_queries
from veriloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NO_PYTHON = [
    "rule_outcome_counts", "duplicate_property_ids", "extract_fields", "transliteration_guard", "detect_script", "select_reading",
    "model_json_fields", "reupload_gate", "correction_audit", "record_detail_counts", "throughput", "registry_page",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"stream_verify", "stream_reupload_gate", "stream_late_reads", "live_status_counts", "run_summary", "replaced_table", "manifest_round_trip", "sample_scores"}))
def test_no_cross_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name in NO_PYTHON:
        assert "Python" not in text and "ArrowEval" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.registry_search(spark, FOLDER))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "o_totalprice" not in text


def test_row_rules_do_not_shuffle(spark):
    assert "Exchange" not in plan(catalog.date_plausibility(spark, FOLDER))


@pytest.mark.parametrize("name", ["apply_reviews_results", "validate_missing_documents"])
def test_revalidation_reads_tables_a_bounded_number_of_times(spark, name):
    assert plan(catalog.QUERIES[name](spark, FOLDER)).split("== Initial Plan")[-1].count("FileScan") <= 10


def test_model_answers_are_parsed_without_a_join(spark):
    text = plan(catalog.model_json_fields(spark, FOLDER)).split("== Initial Plan")[-1]
    assert "Join" not in text and text.count("FileScan") == 1


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in check_queries.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, oracle, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = oracle.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert check_queries.canonical(got) == check_queries.canonical(want)
