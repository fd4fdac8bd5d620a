"""Golden checks against published results.

Always on: small published results restated below as literal expectations.
Opt-in: set CORDON_GOLDEN_DIR to a folder holding the published processed
CSVs and report JSON to recompute every golden from the full files.
"""

import math
import os

import pytest
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.stats import regression_p_value
from cordon.operators import impute, profile, summary, weather as wx
from cordon.sources import published

# ---------------------------------------------------------------------------
# Published values restated as literals (read from the published outputs)
# ---------------------------------------------------------------------------

# Border effect: zone, drop-offs 2024, drop-offs 2025, % change, lat, lon, zone name.
BORDER = [
    (237, 1717817, 1734960, 0.9979526340698689, 40.7689, -73.9595, "Upper East Side South"),
    (143, 595544, 598711, 0.5317827062316135, 40.7725, -73.987, "Lincoln Square West"),
    (263, 840421, 843001, 0.30698899718117467, 40.7756, -73.9595, "Yorkville West"),
    (151, 369516, 368238, -0.34585782483031857, 40.7968, -73.9664, "Manhattan Valley"),
    (262, 616513, 611528, -0.8085798677400152, 40.7767, -73.953, "Yorkville East"),
    (236, 1808841, 1767520, -2.284390944256571, 40.7804, -73.953, "Upper East Side North"),
    (239, 1133903, 1099353, -3.04699784725854, 40.78, -73.9795, "Upper West Side South"),
    (142, 1136192, 1101192, -3.0804652734749056, 40.7736, -73.983, "Lincoln Square East"),
    (238, 911062, 882848, -3.096825463031056, 40.7915, -73.9744, "Upper West Side North"),
]

# Imputation rows: hour, dow, count/fare/total 2023, count/fare/total 2024, imputed x3.
IMPUTED = [
    (0, 0, None, None, None, 29129, 18.521657798070684, 26.512057056541696,
     20390.3, 12.965160458649478, 18.558439939579188),
    (0, 1, None, None, None, 7772, 23.616307256819347, 33.1635627895008,
     5440.4, 16.53141507977354, 23.21449395265056),
    (14, 0, 1.0, 8.6, 13.88, 35417, 21.404369088290906, 30.05651975040243,
     24792.199999999997, 17.563058361803634, 25.203563825281698),
    (23, 0, 11.0, 15.027272727272726, 22.574545454545454, 13661, 23.747347924749285,
     33.779328014054705, 9565.999999999998, 21.131325365506317, 30.417893246201928),
]

# Monthly tip percentage and trip count, 2025 (month 12 holds 13 stray trips).
TIPS = [(1, 19.069480987451456, 3440104), (2, 17.81246344717192, 3534014),
        (3, 17.60618284754354, 4097321), (4, 18.058076808177265, 3929965),
        (5, 16.316514197266567, 4514024), (6, 15.80020784030186, 4239614),
        (7, 15.684314537290202, 3826649), (8, 15.781006708921705, 3517949),
        (9, 16.812050302990798, 4174801), (10, 16.930833673746303, 4357629),
        (11, 16.465027411938884, 4125295), (12, 18.760127685072966, 13)]

# Rain elasticity as published, over 335 joined days.
ELASTICITY = dict(correlation=0.15022655589115413, slope=443.43114008715685,
                  r_squared=0.022568018094918048, p_value=0.005869731526095835, n=335)


def test_g1_imputation_blend_literals(spark):
    df = spark.createDataFrame(IMPUTED, published.SCHEMAS["december_imputed"])
    pub = df.select([F.col(c).alias(f"pub_{c}") if c.startswith("imputed") else c for c in df.columns])
    got = impute._imputed(pub, (2023, 2024), (0.3, 0.7), False).collect()
    for r in got:
        assert math.isclose(r.imputed_count, r.pub_imputed_count, rel_tol=1e-12)
        assert math.isclose(r.imputed_fare, r.pub_imputed_fare, rel_tol=1e-12)
        assert math.isclose(r.imputed_total, r.pub_imputed_total, rel_tol=1e-12)


def test_g2_g3_border_change_names_coordinates(spark):
    df = spark.createDataFrame([(z, a, b) for z, a, b, *_ in BORDER],
                               "dropoff_loc int, count_2024 bigint, count_2025 bigint")
    got = profile.with_zone_names(profile.with_coordinates(
        df.withColumn("pct_change", profile.pct_change("count_2024", "count_2025"))),
        params.ZONE_NAMES)
    rows = {r.dropoff_loc: r for r in got.collect()}
    for z, _a, _b, pct, lat, lon, name in BORDER:
        r = rows[z]
        assert math.isclose(r.pct_change, pct, rel_tol=1e-12)
        assert (r.lat, r.lon, r.zone_name, r.LocationID) == (lat, lon, name, z)
    s = summary.border_summary(got).collect()[0]
    assert round(s.avg_pct_change, 3) == -1.203 and s.n_zones == 9  # G7 border mean


def test_g4_p_value_from_published_fit(spark):
    r = math.sqrt(ELASTICITY["r_squared"])  # slope > 0, so r > 0
    p = spark.range(1).select(regression_p_value(F.lit(r), F.lit(ELASTICITY["n"])).alias("p")) \
        .collect()[0].p
    assert math.isclose(p, ELASTICITY["p_value"], rel_tol=1e-9)


def test_g7_tip_decline_and_stray_month(spark):
    tips = spark.createDataFrame(TIPS, "month int, avg_tip_pct double, trip_count bigint")
    t = summary.tip_change(tips).collect()[0]
    assert (t.first_month, t.last_month, t.first_label, t.last_label) == (1, 12, "Jan", "Dec")
    assert round(t.tip_decline, 3) == 0.309
    t = summary.tip_change(tips, min_trips=1000).collect()[0]
    assert (t.first_month, t.last_month) == (1, 11)


# ---------------------------------------------------------------------------
# Opt-in: recompute from the full published files
# ---------------------------------------------------------------------------

GOLDEN_DIR = os.environ.get("CORDON_GOLDEN_DIR")
FILES = {"velocity_before": "velocity_q1_2024.csv", "velocity_after": "velocity_q1_2025.csv",
         "daily": "daily_trips_2025.csv", "weather_trips": "weather_trips.csv",
         "imputed": "december_2025_imputed.csv"}
full = pytest.mark.skipif(not GOLDEN_DIR, reason="CORDON_GOLDEN_DIR not set")


def _find(name):
    for root, _dirs, files in os.walk(GOLDEN_DIR):
        if FILES[name] in files:
            return os.path.join(root, FILES[name])
    pytest.skip(f"{FILES[name]} not under CORDON_GOLDEN_DIR")


@full
def test_full_g1_blend(spark):
    df = published.read(spark, "december_imputed", _find("imputed"))
    pub = df.select([F.col(c).alias(f"pub_{c}") if c.startswith("imputed") else c for c in df.columns])
    rows = impute._imputed(pub, (2023, 2024), (0.3, 0.7), False).collect()
    assert len(rows) == 168 and sum(r.count_2024 for r in rows) == 3722358
    assert max(abs(r.imputed_total - r.pub_imputed_total) for r in rows) < 1e-9


@full
def test_full_g4_g5_g6_weather(spark):
    wt = published.read(spark, "weather_trips", _find("weather_trips"))
    weather = wt.select("date", "precipitation_mm", "rain_mm")
    daily = published.read(spark, "daily_trips", _find("daily"))
    r = wx.rain_elasticity(weather, daily.select("date", "trip_count")).collect()[0]
    for k in ("correlation", "slope", "r_squared", "p_value"):
        assert math.isclose(getattr(r, k), ELASTICITY[k], rel_tol=1e-9), k
    assert r.n == ELASTICITY["n"] and r.interpretation == "inelastic"
    m = wx.wettest_month(weather).collect()[0]
    assert (m.month, m.n_days) == (5, 31) and math.isclose(m.total_precipitation_mm, 178.3)
    assert wx.weather_trips(weather, daily).count() == 335
    assert daily.agg(F.sum("trip_count")).collect()[0][0] == 43757378  # I1


@full
def test_full_g7_speed_change(spark):
    cells = (published.read(spark, "velocity", _find("velocity_before")).withColumn("year", F.lit(2024))
             .unionByName(published.read(spark, "velocity", _find("velocity_after"))
                          .withColumn("year", F.lit(2025))))
    r = summary.cells_change(cells, 2024, 2025).collect()[0]
    assert round(r.speed_change_pct, 3) == -0.259 and round(r.weighted_change_pct, 2) == 0.78
