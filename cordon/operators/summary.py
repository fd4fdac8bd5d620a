"""Page-level figures: speed heat-map pivot, before/after deltas, tip trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.mathexpr import pct_change
from cordon.functions.scope import scope
from cordon.operators.profile import speed_over
from cordon.operators.zone import in_zone
from cordon.functions.timeexpr import day_of_week, quarter_range


def velocity_pivot(speeds: DataFrame) -> DataFrame:
    """Rows day_of_week, one column per hour 0..23, mean of avg_speed_mph."""
    return (speeds.groupBy("day_of_week")
            .pivot("hour", list(range(24)))
            .agg(F.avg("avg_speed_mph"))
            .orderBy("day_of_week"))


def velocity_cells(clean: DataFrame, years, quarter: int = 1,
                   ids=params.CONGESTION_ZONE_IDS) -> DataFrame:
    """(year, hour, day_of_week) cells of inside-cordon trips of one quarter, one scan."""
    in_any = None
    for y in years:
        c = quarter_range("pickup_time", y, quarter)
        in_any = c if in_any is None else (in_any | c)
    clean = scope(clean, years=list(years), months=range(3 * quarter - 2, 3 * quarter + 1))
    return (clean.filter(in_any & in_zone("pickup_loc", ids) & in_zone("dropoff_loc", ids))
            .groupBy(F.year("pickup_time").alias("year"), F.hour("pickup_time").alias("hour"),
                     day_of_week("pickup_time").alias("day_of_week"))
            .agg(F.avg(speed_over()).alias("avg_speed_mph"),
                 F.count(F.lit(1)).alias("trip_count")))


def cells_change(cells: DataFrame, before: int, after: int) -> DataFrame:
    """Mean cell speed in two years and the percent change, from (year, cell) rows.

    ``avg_speed_*`` is the unweighted mean of the (hour, weekday) cells (the
    page's figure); ``weighted_speed_*`` weights each cell by its trip count.
    """
    weighted_n = F.when(F.col("avg_speed_mph").isNotNull(), F.col("trip_count"))
    per_year = cells.groupBy("year").agg(
        F.avg("avg_speed_mph").alias("mean_speed"),
        (F.sum(F.col("avg_speed_mph") * F.col("trip_count")) / F.sum(weighted_n)).alias("wmean"))

    def pick(col, y):
        return F.max(F.when(F.col("year") == y, F.col(col)))

    return (per_year.agg(pick("mean_speed", before).alias(f"avg_speed_{before}"),
                         pick("mean_speed", after).alias(f"avg_speed_{after}"),
                         pick("wmean", before).alias(f"weighted_speed_{before}"),
                         pick("wmean", after).alias(f"weighted_speed_{after}"))
            .withColumn("speed_change_pct",
                        pct_change(f"avg_speed_{before}", f"avg_speed_{after}"))
            .withColumn("weighted_change_pct",
                        pct_change(f"weighted_speed_{before}", f"weighted_speed_{after}")))


def velocity_change(clean: DataFrame, before: int = params.COMPARISON_YEAR,
                    after: int = params.ANALYSIS_YEAR, quarter: int = 1,
                    ids=params.CONGESTION_ZONE_IDS) -> DataFrame:
    """Before/after speed change of one quarter: one scan, two small re-aggregations."""
    return cells_change(velocity_cells(clean, [before, after], quarter, ids), before, after)


def border_summary(border: DataFrame) -> DataFrame:
    """Mean border change and the map centre (mean lat, mean lon)."""
    return border.agg(F.avg("pct_change").alias("avg_pct_change"),
                      F.avg("lat").alias("center_lat"),
                      F.avg("lon").alias("center_lon"),
                      F.count(F.lit(1)).alias("n_zones"))


def month_label(col: str = "month"):
    """Month number -> 'Jan'..'Dec'."""
    return F.element_at(F.array(*[F.lit(m) for m in params.MONTH_ABBR]), F.col(col))


def day_label(col: str = "day_of_week"):
    """Day of week (0 = Sunday) -> 'Sun'..'Sat'."""
    return F.element_at(F.array(*[F.lit(d) for d in params.DAY_ABBR]), F.col(col) + 1)


def tip_change(monthly: DataFrame, min_trips: int = 0) -> DataFrame:
    """Tip % of the first and last month present and the decline between them.

    ``min_trips`` ignores months with fewer trips (a few stray pickups dated
    into a month otherwise absent); the default 0 keeps every month.
    """
    if min_trips:
        monthly = monthly.filter(F.col("trip_count") >= min_trips)
    first = F.min("month")
    last = F.max("month")
    return (monthly.agg(first.alias("first_month"), last.alias("last_month"),
                        F.min_by("avg_tip_pct", "month").alias("first_tip_pct"),
                        F.max_by("avg_tip_pct", "month").alias("last_tip_pct"))
            .withColumn("tip_decline", F.col("first_tip_pct") - F.col("last_tip_pct"))
            .withColumn("first_label", month_label("first_month"))
            .withColumn("last_label", month_label("last_month")))
