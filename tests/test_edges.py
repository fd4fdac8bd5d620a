"""Hand-made edge rows: nulls, exact thresholds, windows, ties."""

import datetime as dt
import math

import pytest

from cordon import params
from cordon.operators import flag as fl
from cordon.operators import impute, profile, weather as wx, zone
from helpers import trips

Z_IN = params.CONGESTION_ZONE_IDS[0]
Z_OUT = 1
B = params.BORDER_ZONE_IDS[0]


def classify(spark, **kw):
    row = fl.flag(trips(spark, [kw])).collect()[0]
    return row


def test_null_times_speed_zero_only_stationary_rule(spark):
    r = classify(spark, pickup_time=None, dropoff_time="2025-02-01 10:00:00", fare=50.0)
    assert r.trip_duration_min is None and r.avg_speed_mph == 0.0 and r.ghost_type is None
    r = classify(spark, pickup_time="2025-02-01 10:00:00", dropoff_time=None,
                 trip_distance=0.0, fare=5.0)
    assert r.ghost_type == params.GHOST_STATIONARY


def test_reversed_times_teleporter(spark):
    r = classify(spark, pickup_time="2025-02-01 10:05:00", dropoff_time="2025-02-01 10:00:00",
                 fare=25.0)
    assert r.ghost_type == params.GHOST_TELEPORTER and r.avg_speed_mph == 0.0
    assert r.trip_duration_min == -5.0


def test_zero_duration_clean(spark):
    r = classify(spark, pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:00:00",
                 fare=5.0, trip_distance=1.0)
    assert r.ghost_type is None and r.avg_speed_mph == 0.0


def test_exactly_65_mph_is_not_impossible(spark):
    r = classify(spark, pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 11:00:00",
                 trip_distance=65.0, fare=100.0)
    assert r.avg_speed_mph == 65.0 and r.ghost_type is None


def test_exactly_60_seconds_not_teleporter_and_speed_excluded(spark):
    t = trips(spark, [dict(pickup_time="2025-02-03 10:00:00", dropoff_time="2025-02-03 10:01:00",
                           fare=25.0, trip_distance=0.5, pickup_loc=Z_IN, dropoff_loc=Z_IN)])
    r = fl.flag(t).collect()[0]
    assert r.ghost_type is None and r.trip_duration_min == 1.0
    cell = profile.hourly_speeds(fl.clean(fl.flag(t)), 2025, 1).collect()[0]
    assert cell.avg_speed_mph is None and cell.trip_count == 1


def test_59_seconds_fare_exactly_20_not_teleporter(spark):
    r = classify(spark, pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:00:59",
                 fare=20.0, trip_distance=0.1)
    assert r.ghost_type is None


def test_first_rule_wins(spark):
    r = classify(spark, pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:00:30",
                 fare=50.0, trip_distance=10.0)
    assert r.ghost_type == params.GHOST_IMPOSSIBLE


@pytest.mark.parametrize("fare", [0.0, None, -5.0])
def test_zero_distance_without_positive_fare_is_clean(spark, fare):
    r = classify(spark, pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:10:00",
                 trip_distance=0.0, fare=fare)
    assert r.ghost_type is None


def test_nan_distance_is_impossible(spark):
    r = classify(spark, pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:10:00",
                 trip_distance=float("nan"), fare=10.0)
    assert r.ghost_type == params.GHOST_IMPOSSIBLE


def test_null_pickup_zone_excluded_from_entries(spark):
    t = trips(spark, [
        dict(pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:10:00",
             pickup_loc=None, dropoff_loc=Z_IN),
        dict(pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:10:00",
             pickup_loc=Z_OUT, dropoff_loc=Z_IN),
    ])
    r = zone.surcharge_compliance(t).collect()[0]
    assert r.total_zone_entry_trips == 1
    locs = zone.missing_surcharge_locations(t, min_entries=1).collect()
    assert [x.pickup_loc for x in locs] == [Z_OUT]


def test_surcharge_classes(spark):
    rows = [dict(pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:10:00",
                 pickup_loc=Z_OUT, dropoff_loc=Z_IN, congestion_surcharge=s)
            for s in (None, 0.0, -2.5, 2.5)]
    r = zone.surcharge_compliance(trips(spark, rows)).collect()[0]
    assert (r.total_zone_entry_trips, r.trips_with_surcharge, r.trips_without_surcharge,
            r.trips_negative_surcharge) == (4, 1, 2, 1)
    assert r.compliance_rate == 25.0


def test_compliance_window_start(spark):
    rows = [dict(pickup_time=p, dropoff_time="2025-01-05 00:30:00", pickup_loc=Z_OUT,
                 dropoff_loc=Z_IN)
            for p in ("2025-01-05 00:00:00", "2025-01-04 23:59:59.999999")]
    r = zone.surcharge_compliance(trips(spark, rows)).collect()[0]
    assert r.total_zone_entry_trips == 1


def test_compliance_rate_null_on_no_entries(spark):
    r = zone.surcharge_compliance(trips(spark, [dict(pickup_time="2024-02-01 10:00:00")])).collect()[0]
    assert r.total_zone_entry_trips == 0 and r.compliance_rate is None


def test_tip_pct_zero_fare_counted(spark):
    t = trips(spark, [dict(pickup_time="2025-03-01 10:00:00", dropoff_time="2025-03-01 10:10:00",
                           fare=0.0, tip_amount=3.0),
                      dict(pickup_time="2025-03-02 10:00:00", dropoff_time="2025-03-02 10:10:00",
                           fare=10.0, tip_amount=2.0)])
    r = profile.monthly_tips(t, 2025).collect()[0]
    assert r.trip_count == 2 and r.avg_tip_pct == 10.0 and r.total_tips == 5.0


def test_border_zone_only_in_later_year(spark):
    t = trips(spark, [dict(pickup_time="2025-05-01 10:00:00", dropoff_time="2025-05-01 10:10:00",
                           dropoff_loc=B)])
    r = profile.border_effect(t).collect()[0]
    assert (r.dropoff_loc, r.count_2024, r.count_2025, r.pct_change) == (B, 0, 1, 0.0)


def test_december_cell_in_one_year_only(spark):
    t = trips(spark, [dict(pickup_time="2024-12-02 08:00:00", dropoff_time="2024-12-02 08:10:00",
                           fare=10.0, total_amount=20.0),
                      dict(pickup_time="2023-12-03 09:00:00", dropoff_time="2023-12-03 09:10:00",
                           fare=30.0, total_amount=40.0)])
    for fn in (impute.impute_month, impute.impute_month_by_join):
        rows = {(r.hour, r.dow): r for r in fn(t).collect()}
        a = rows[(8, 1)]  # Monday, 2024 only
        assert a.count_2023 is None and a.count_2024 == 1
        assert math.isclose(a.imputed_count, 0.7) and math.isclose(a.imputed_fare, 7.0)
        b = rows[(9, 0)]  # Sunday, 2023 only
        assert b.count_2024 is None and math.isclose(b.imputed_total, 12.0)
    r = impute.impute_month(t, renormalize=True).collect()
    assert {round(x.imputed_fare, 9) for x in r} == {10.0, 30.0}


def test_wettest_month_tie_goes_to_lower_month(spark):
    w = spark.createDataFrame([(dt.date(2025, 3, 1), 5.0, 5.0), (dt.date(2025, 2, 1), 5.0, 5.0)],
                              "date date, precipitation_mm double, rain_mm double")
    assert wx.wettest_month(w).collect()[0].month == 2


def test_null_precipitation_dropped_from_corr_zero_in_regression(spark):
    w = spark.createDataFrame(
        [(dt.date(2025, 1, d), p, p) for d, p in [(1, 1.0), (2, 2.0), (3, None), (4, 4.0)]],
        "date date, precipitation_mm double, rain_mm double")
    d = spark.createDataFrame([(dt.date(2025, 1, i), c) for i, c in [(1, 10), (2, 20), (3, 5), (4, 41)]],
                              "date date, trip_count bigint")
    r = wx.rain_elasticity(w, d).collect()[0]
    import numpy as np
    x = np.array([1.0, 2.0, 4.0]); y = np.array([10.0, 20.0, 41.0])
    assert math.isclose(r.correlation, np.corrcoef(x, y)[0, 1], rel_tol=1e-12)
    x0 = np.array([1.0, 2.0, 0.0, 4.0]); y0 = np.array([10.0, 20.0, 5.0, 41.0])
    slope = np.polyfit(x0, y0, 1)[0]
    assert r.n == 4 and math.isclose(r.slope, slope, rel_tol=1e-12)
    assert math.isclose(r.r_squared, np.corrcoef(x0, y0)[0, 1] ** 2, rel_tol=1e-12)


def test_suspicious_vendor_share_and_ties(spark):
    rows = []
    for vendor, n in [(1, 3), (2, 3), (3, 1), (None, 2)]:
        rows += [dict(pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:00:10",
                      fare=50.0, vendor_id=vendor)] * n
    out = fl.suspicious_vendors(fl.flag(trips(spark, rows)), top_n=3).collect()
    assert [r.vendor_id for r in out] == [1, 2, None]
    assert [r.pct_of_all_ghost_trips for r in out] == [3 * 100.0 / 9, 3 * 100.0 / 9, 2 * 100.0 / 9]


def test_ghost_stats_empty_rate_zero(spark):
    empty = fl.flag(trips(spark, [dict(pickup_time="2025-01-01 00:00:00")])).limit(0)
    r = fl.ghost_stats(empty).collect()[0]
    assert (r.total_trips, r.ghost_rate) == (0, 0.0)


def test_direction_null_pickup_is_outside(spark):
    rows = [dict(pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:10:00",
                 pickup_loc=p, dropoff_loc=d)
            for p, d in [(None, Z_IN), (Z_IN, Z_IN), (Z_OUT, Z_IN), (Z_IN, Z_OUT), (Z_OUT, Z_OUT)]]
    got = {r.trip_type: r.trip_count for r in zone.zone_direction_summary(trips(spark, rows)).collect()}
    assert got == {"outside_zone": 2, "within_zone": 1, "entering_zone": 1, "exiting_zone": 1}


def test_zone_names_dict_equals_lookup_join(spark):
    from cordon.sources import zones as zsrc
    border = spark.createDataFrame([(142, 1.0), (999, 2.0), (None, 3.0)],
                                   "dropoff_loc int, pct_change double")
    a = profile.with_zone_names(border, params.ZONE_NAMES).orderBy("pct_change").collect()
    b = profile.with_zone_names(border, zsrc.roster_lookup(spark)).orderBy("pct_change").collect()
    assert [(r.LocationID, r.zone_name) for r in a] == [(r.LocationID, r.zone_name) for r in b]
    assert a[0].zone_name == "Lincoln Square East" and a[1].LocationID is None


def test_coordinates_dict_equals_join(spark):
    from cordon.sources import zones as zsrc
    border = spark.createDataFrame([(142, 1.0), (999, 2.0), (None, 3.0)],
                                   "dropoff_loc int, pct_change double")
    a = profile.with_coordinates(border).orderBy("pct_change").collect()
    b = profile.with_coordinates(border, zsrc.coordinates(spark)).orderBy("pct_change").collect()
    assert [(r.lat, r.lon) for r in a] == [(r.lat, r.lon) for r in b]
    assert (a[0].lat, a[0].lon) == params.BORDER_COORDS[142]
    assert (a[1].lat, a[1].lon) == params.DEFAULT_COORD == (a[2].lat, a[2].lon)


def test_fused_equals_direct_on_null_and_odd_rows(spark):
    """Null times, zones, fares, totals and vendors, NaN distances, strange years: every fold equals its direct operator."""
    import itertools

    import diffcheck
    from cordon.operators import zone
    from cordon.plans import fused
    times = [("2025-01-04 23:59:59", "2025-01-05 00:20:00"), ("2025-01-05 00:00:00", "2025-01-05 00:20:00"), ("2025-02-10 08:00:00", "2025-02-10 08:00:59"),
             ("2024-03-31 23:00:00", "2024-04-01 00:10:00"), ("2098-07-01 10:00:00", "2098-07-01 10:30:00"), (None, "2025-01-05 00:20:00"), ("2025-03-01 10:00:00", None)]
    zones_ = [(1, 230), (230, 161), (161, 1), (1, 142), (None, 161), (161, None), (7, 161)]
    odd = [dict(), dict(total_amount=None), dict(fare=None, tip_amount=2.0), dict(trip_distance=float("nan")), dict(vendor_id=None),
           dict(congestion_surcharge=0.0, total_amount=20.0), dict(congestion_surcharge=-2.5), dict(congestion_surcharge=2.5, taxi_type="green")]
    rows = [dict(pickup_time=p, dropoff_time=d, pickup_loc=a, dropoff_loc=b, **o) for (p, d), (a, b), o in itertools.product(times, zones_, odd)]
    clean = fl.clean(fl.flag(trips(spark, rows)))
    base = fused.base_aggregate(clean)
    pairs = [(zone.surcharge_compliance(clean), fused.surcharge_compliance(base)),
             (zone.missing_surcharge_locations(clean, min_entries=1), fused.missing_surcharge_locations(base, min_entries=1)),
             (zone.quarterly_volumes(clean), fused.quarterly_volumes(base)), (zone.zone_direction_summary(clean), fused.zone_direction_summary(base)),
             (zone.surcharge_revenue(clean), fused.surcharge_revenue(base)), (profile.hourly_speeds(clean, 2025, 1), fused.hourly_speeds(base, 2025, 1)),
             (profile.daily_trips(clean, 2025), fused.daily_trips(base, 2025)), (profile.monthly_tips(clean, 2025), fused.monthly_tips(base, 2025)),
             (profile.border_effect(clean), fused.border_effect(base))]
    for a, b in pairs:
        got = [tuple(r) for r in b.collect()]
        ok, msg = diffcheck.compare([tuple(r) for r in a.collect()], a.columns, got, b.columns)
        assert ok and got, msg
