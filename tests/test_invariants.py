"""Invariants that must hold between results on any input."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001, SF01
from cordon.operators import flag as fl
from cordon.operators import profile, zone
from cordon.sources import adapter


@pytest.fixture(scope="module", params=[SF001, SF01])
def sf(request):
    return request.param


def test_i4_compliance_parts_add_up(spark, sf):
    r = E.queries()["surcharge_compliance"](spark, sf).collect()[0]
    assert (r.trips_with_surcharge + r.trips_without_surcharge + r.trips_negative_surcharge
            == r.total_zone_entry_trips)


def test_i5_clean_plus_ghost_is_total(spark, sf):
    c = E.queries()["trip_counts"](spark, sf).collect()[0]
    assert c.clean_trips + c.ghost_trips == c.total_trips
    classes = E.queries()["ghost_summary"](spark, sf).collect()
    assert sum(r["count"] for r in classes) == c.ghost_trips


def test_i6_vendor_shares_sum_to_100(spark, sf):
    flagged = fl.flag(adapter.trips(spark, sf))
    rows = fl.suspicious_vendors(flagged, top_n=100).collect()
    assert math.isclose(sum(r.pct_of_all_ghost_trips for r in rows), 100.0, rel_tol=1e-12)


def test_i7_velocity_cells(spark, sf):
    rows = E.queries()["hourly_speeds_q1_2025"](spark, sf).collect()
    assert len(rows) <= 168
    keys = [(r.day_of_week, r.hour) for r in rows]
    assert keys == sorted(keys)
    assert all(0 <= d <= 6 and 0 <= h <= 23 for d, h in keys)


def test_i3_revenue_gap_is_the_negatives(spark, sf):
    clean = fl.clean(fl.flag(adapter.trips(spark, sf)))
    paid = zone.surcharge_revenue(clean, 2025).collect()[0].total_surcharge_revenue
    months = profile.monthly_tips(clean, 2025).collect()
    net = sum(r.total_surcharge for r in months)
    negatives = (clean.filter((F.year("pickup_time") == 2025) & (F.col("congestion_surcharge") < 0))
                 .agg(F.sum("congestion_surcharge")).collect()[0][0] or 0.0)
    assert paid >= net
    assert math.isclose(paid - net, -negatives, rel_tol=1e-9)


def test_i1_i2_daily_monthly_consistent(spark, sf):
    daily = E.queries()["daily_trips"](spark, sf).collect()
    monthly = E.queries()["monthly_tips"](spark, sf).collect()
    assert sum(r.trip_count for r in daily) == sum(r.trip_count for r in monthly)
    for r in monthly:
        assert math.isclose(r.avg_surcharge * r.trip_count, r.total_surcharge,
                            rel_tol=1e-9, abs_tol=1e-9)


def test_fused_equals_direct(spark, sf):
    import diffcheck
    q = E.queries()
    for name in ["surcharge_compliance", "missing_surcharge_locations", "quarterly_volumes",
                 "zone_direction_summary", "surcharge_revenue", "hourly_speeds_q1_2025",
                 "daily_trips", "monthly_tips", "border_effect"]:
        a = q[name](spark, sf)
        b = q[f"{name}_fused"](spark, sf)
        ok, msg = diffcheck.compare([tuple(r) for r in a.collect()], a.columns,
                                    [tuple(r) for r in b.collect()], b.columns)
        assert ok, (name, msg)


def test_fused_velocity_cells_equal_direct(spark, sf):
    import diffcheck
    from cordon.operators import summary
    from cordon.plans import fused, store
    base = store.base_table(spark, sf)
    clean = fl.clean(store.flagged_table(spark, sf))
    a = summary.cells_change(fused.velocity_cells(base, [2024, 2025]), 2024, 2025)
    b = summary.velocity_change(clean)
    ok, msg = diffcheck.compare([tuple(r) for r in a.collect()], a.columns,
                                [tuple(r) for r in b.collect()], b.columns)
    assert ok, msg
