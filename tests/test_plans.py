"""Plan properties of every registered query (the scale contract, checked)."""

import re

import pytest

from conftest import SF01
from cordon.plans.queries import QUERIES

FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
             "BroadcastNestedLoopJoin", "MapInPandas", "FlatMapGroupsInPandas"]
# Footers are read in tasks over the file listing (one row a file, never trips).
FOOTERS = {"directory_trips", "file_check", "file_columns", "local_months", "months_to_fetch", "fetch_plan"}
# Queries that return trip rows need every column.
ROW_LEVEL = {"ghost_flags", "daily_trips_stream"}


def _plan(spark, name):
    df = QUERIES[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"daily_trips_stream"}))
def test_no_python_and_no_pair_joins(spark, name):
    plan = _plan(spark, name)
    for op in FORBIDDEN:
        assert op not in plan or (op == "MapInPandas" and name in FOOTERS), (name, op)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROW_LEVEL))
def test_trip_scans_are_pruned(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = _plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        cols = [c.split(":")[0] for c in schema.split(",")]
        # the flagged table has 14 columns; no aggregate needs more than 8. Raw trips are derived
        # from lineitem (16 columns), where pickup, zone and type alone hang on 7.
        assert len(cols) <= (10 if cols[0].startswith("l_") else 8), (name, cols)


@pytest.mark.parametrize("name", ["daily_trips", "monthly_tips", "hourly_speeds_q1_2025",
                                  "surcharge_revenue", "border_effect", "december_imputed",
                                  "daily_trips_fused", "hourly_speeds_q1_2025_fused"])
def test_year_scoped_queries_prune_partitions(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = _plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert filters and all(("pickup_year" in f or "year" in f) for f in filters if f), (name, filters)
    assert any(f for f in filters), (name, filters)


def _scans(spark, name):
    """Scans in the plan, by table; a reused exchange counts once."""
    plan = _plan(spark, name)
    return len(re.findall(r"FileScan parquet", plan))


@pytest.mark.parametrize("name,most", [("suspicious_vendors", 1), ("wettest_month_trips", 2), ("weather_trips", 2), ("ghost_summary", 1)])
def test_scan_counts(spark, name, most):
    assert _scans(spark, name) <= most


def test_report_scans_trips_once(spark):
    """Vendors come from the flagged trips; every other section folds the small base."""
    plan = _plan(spark, "report_rows")
    assert len(re.findall(r"FileScan parquet [^\n]*ghost_type", plan)) == 1


def test_quarter_queries_list_three_months(spark):
    plan = _plan(spark, "hourly_speeds_q1_2025")
    assert re.search(r"pickup_month#\d+ IN \(1,2,3\)", plan)


def test_base_is_small(spark):
    from cordon.operators import flag as fl
    from cordon.plans import store
    sf = SF01.replace("sf0.01", "sf0.1")
    clean = fl.clean(store.flagged_table(spark, sf)).count()
    assert store.base_table(spark, sf).count() <= clean / 10
