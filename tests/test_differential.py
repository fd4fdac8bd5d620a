"""Every registered query against its oracle SQL on sf0.01 (DuckDB)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF01  # noqa: E402
from cordon.plans.oracle import ORACLE  # noqa: E402
from cordon.plans.queries import QUERIES  # noqa: E402

NAMES = sorted(QUERIES)

# Spark simple type -> DuckDB result type
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
         "array<int>": "INTEGER[]"}


@pytest.fixture(scope="module")
def duck():
    import diffcheck
    return diffcheck.duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    import diffcheck
    df = E.queries()[name](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name.startswith("missing_surcharge_locations"), "an empty result shows nothing"
    res = duck.execute(E.oracle_sql()[name])
    ok, msg = diffcheck.compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert ok, msg
    rel = duck.sql(E.oracle_sql()[name])
    oracle_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema:
        spark_type = f.dataType.simpleString()
        assert TYPES.get(spark_type, spark_type) == oracle_types[f.name], (f.name, spark_type)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["vendor_id", "ghost_trip_count", "total_suspicious_fare",
                          "pct_of_all_ghost_trips"]
    assert 0 < df.count() <= 5


def test_lazy_and_materialised_paths_agree(spark, monkeypatch):
    import diffcheck
    for name in ["surcharge_compliance", "border_effect", "december_imputed", "ghost_summary"]:
        a = E.queries()[name](spark, SF01)
        rows_a = [tuple(r) for r in a.collect()]
        monkeypatch.setenv("CORDON_MATERIALISE", "0")
        b = E.queries()[name](spark, SF01)
        rows_b = [tuple(r) for r in b.collect()]
        monkeypatch.delenv("CORDON_MATERIALISE")
        ok, msg = diffcheck.compare(rows_a, a.columns, rows_b, b.columns)
        assert ok, (name, msg)


def test_unwritable_store_falls_back_to_lazy_plan(spark):
    import diffcheck
    spark.conf.set("cordon.store.dir", "/proc/cordon-cannot-write-here")
    try:
        a = E.queries()["surcharge_compliance"](spark, SF01)
        rows_a = [tuple(r) for r in a.collect()]
    finally:
        spark.conf.unset("cordon.store.dir")
    b = E.queries()["surcharge_compliance"](spark, SF01)
    ok, msg = diffcheck.compare(rows_a, a.columns, [tuple(r) for r in b.collect()], b.columns)
    assert ok, msg
