"""Hourly, daily, monthly and border-zone profiles of clean trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.mathexpr import pct_change, tip_pct
from cordon.functions.scope import scope
from cordon.functions.timeexpr import day_of_week, duration_seconds, quarter_range, year_range, years_range
from cordon.operators.zone import in_zone


def speed_over(min_seconds: float = params.SPEED_MIN_SECONDS) -> Column:
    """Trip speed in mph for trips longer than `min_seconds`, else null.

    Null keeps short trips out of the average while they still count as trips.
    """
    secs = duration_seconds("pickup_time", "dropoff_time")
    return F.when(secs > min_seconds, F.col("trip_distance") / (secs / F.lit(3600.0)))


def hourly_speeds(clean: DataFrame, year: int, quarter: int,
                  ids=params.CONGESTION_ZONE_IDS) -> DataFrame:
    """Inside-cordon trips of one quarter per (hour, day_of_week): mean speed, count."""
    clean = scope(clean, years=[year], months=range(3 * quarter - 2, 3 * quarter + 1))
    return (clean.filter(quarter_range("pickup_time", year, quarter)
                         & in_zone("pickup_loc", ids) & in_zone("dropoff_loc", ids))
            .groupBy(F.hour("pickup_time").alias("hour"),
                     day_of_week("pickup_time").alias("day_of_week"))
            .agg(F.avg(speed_over()).alias("avg_speed_mph"),
                 F.count(F.lit(1)).alias("trip_count"))
            .orderBy("day_of_week", "hour"))


def daily_trips(clean: DataFrame, year: int = params.ANALYSIS_YEAR) -> DataFrame:
    """Per pickup date of `year`: trips, revenue, average surcharge."""
    return (scope(clean, years=[year]).filter(year_range("pickup_time", year))
            .groupBy(F.to_date("pickup_time").alias("date"))
            .agg(F.count(F.lit(1)).alias("trip_count"),
                 F.sum("total_amount").alias("total_revenue"),
                 F.avg("congestion_surcharge").alias("avg_surcharge"))
            .orderBy("date"))


def monthly_tips(clean: DataFrame, year: int = params.ANALYSIS_YEAR) -> DataFrame:
    """Per pickup month of `year`: surcharge and tip averages and sums.

    avg_tip_pct is the mean of per-trip tip percentages (0 for trips without
    a positive fare), not total tips over total fares.
    """
    return (scope(clean, years=[year]).filter(year_range("pickup_time", year))
            .groupBy(F.month("pickup_time").alias("month"))
            .agg(F.avg("congestion_surcharge").alias("avg_surcharge"),
                 F.avg(tip_pct()).alias("avg_tip_pct"),
                 F.sum("congestion_surcharge").alias("total_surcharge"),
                 F.sum("tip_amount").alias("total_tips"),
                 F.count(F.lit(1)).alias("trip_count"))
            .orderBy("month"))


def border_dropoffs(clean: DataFrame, years=(2024, 2025),
                    ids=params.BORDER_ZONE_IDS) -> DataFrame:
    """Drop-offs per (border zone, pickup year) for the listed years."""
    years = sorted(years)
    return (scope(clean, years=years).filter(in_zone("dropoff_loc", ids)
                         & years_range("pickup_time", years[0], years[-1])
                         & F.year("pickup_time").isin(years))
            .groupBy("dropoff_loc", F.year("pickup_time").alias("year"))
            .agg(F.count(F.lit(1)).alias("dropoff_count"))
            .orderBy("dropoff_loc", "year"))


def border_effect(clean: DataFrame, before: int = params.COMPARISON_YEAR,
                  after: int = params.ANALYSIS_YEAR,
                  ids=params.BORDER_ZONE_IDS) -> DataFrame:
    """Per border zone: drop-offs in two years and the percent change.

    One scan and one aggregate: the two yearly counts are conditional counts,
    so a year without trips reads 0 and the change is 0 when the base is 0.
    """
    year = F.year("pickup_time")
    return (scope(clean, years=[before, after]).filter(in_zone("dropoff_loc", ids)
                         & (year_range("pickup_time", before) | year_range("pickup_time", after)))
            .groupBy("dropoff_loc")
            .agg(F.count_if(year == before).alias(f"count_{before}"),
                 F.count_if(year == after).alias(f"count_{after}"))
            .withColumn("pct_change", pct_change(f"count_{before}", f"count_{after}"))
            .orderBy(F.desc("pct_change"), F.asc("dropoff_loc")))


def with_coordinates(border: DataFrame, coords=params.BORDER_COORDS,
                     default=params.DEFAULT_COORD, key: str = "dropoff_loc") -> DataFrame:
    """Add lat/lon by zone id, falling back to the default point.

    `coords` is either a fixed id -> (lat, lon) dict, applied as a literal map
    lookup (no join), or a DataFrame (zone_id, lat, lon), joined left; the planner
    broadcasts it by its bytes.
    """
    if not isinstance(coords, dict):
        c = coords.select(F.col("zone_id").alias("_zid"), F.col("lat").alias("_lat"),
                          F.col("lon").alias("_lon"))
        joined = border.join(c, border[key] == c["_zid"], "left")
        return (joined.withColumns({"lat": F.coalesce(F.col("_lat"), F.lit(float(default[0]))),
                                    "lon": F.coalesce(F.col("_lon"), F.lit(float(default[1])))})
                .drop("_zid", "_lat", "_lon"))

    def lookup(i):
        m = F.create_map(*[x for zid, ll in sorted(coords.items())
                           for x in (F.lit(int(zid)), F.lit(float(ll[i])))])
        return F.coalesce(F.try_element_at(m, F.col(key)), F.lit(float(default[i])))

    return border.withColumns({"lat": lookup(0), "lon": lookup(1)})


def with_zone_names(border: DataFrame, lookup, key: str = "dropoff_loc") -> DataFrame:
    """Left join to the zone lookup: keeps LocationID and Zone as zone_name.

    `lookup` is either the lookup DataFrame (LocationID, Zone, ...) — one row
    per taxi zone, which the planner broadcasts by its bytes — or a fixed id -> name dict, applied as a literal map lookup (no join).
    """
    if isinstance(lookup, dict):
        names = F.create_map(*[x for zid, name in sorted(lookup.items())
                               for x in (F.lit(int(zid)), F.lit(name))])
        hit = F.array_contains(F.map_keys(names), F.col(key))
        return border.withColumns({
            "LocationID": F.when(hit, F.col(key).cast("int")),
            "zone_name": F.try_element_at(names, F.col(key)),
        })
    names = lookup.select(F.col("LocationID"), F.col("Zone").alias("zone_name"))
    return border.join(names, border[key] == names["LocationID"], "left")


def border_markers(border: DataFrame) -> DataFrame:
    """Map encoding: green for growth, red otherwise; radius |pct| * 2 + 10."""
    return border.withColumns({
        "marker_color": F.when(F.col("pct_change") > 0, F.lit("green")).otherwise(F.lit("red")),
        "marker_radius": F.abs(F.col("pct_change")) * F.lit(2.0) + F.lit(10.0),
    })
