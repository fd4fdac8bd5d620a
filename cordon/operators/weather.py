"""Weather against demand: wettest month, daily join, correlation and OLS."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.stats import regression_p_value


def wettest_month(weather: DataFrame) -> DataFrame:
    """The month with the largest precipitation sum; ties go to the lower month."""
    return (weather.groupBy(F.month("date").alias("month"))
            .agg(F.sum("precipitation_mm").alias("total_precipitation_mm"),
                 F.count(F.lit(1)).alias("n_days"))
            .orderBy(F.desc_nulls_last("total_precipitation_mm"), F.asc("month"))
            .limit(1))


def weather_trips(weather: DataFrame, daily: DataFrame) -> DataFrame:
    """Inner join of weather and daily trips on date (weather columns first).

    Both sides hold one row per day (at most 366 per year), so the planner
    broadcasts one side; nothing here grows with the trip count.
    """
    return weather.join(daily, "date", "inner")


def month_weather_trips(weather: DataFrame, daily: DataFrame, month: int) -> DataFrame:
    """``weather_trips`` restricted to one calendar month (both sides filtered first)."""
    def pick(df):
        return df.filter(F.month("date") == month)
    return pick(weather).select("date", "precipitation_mm").join(pick(daily), "date", "inner")


def wettest_month_trips(weather: DataFrame, daily: DataFrame, from_joined: bool = False) -> DataFrame:
    """Daily rows of the wettest month joined with trips (month found on the cluster).

    The wettest month comes from the whole weather series, or with
    ``from_joined`` from the joined days only (as the page computes it).
    """
    rain = weather.select("date", "precipitation_mm")
    days = rain.join(daily.withColumn("_trips", F.lit(True)), "date", "inner" if from_joined else "left")
    # Windows over one row per day of the series.
    month = F.month("date")
    totals = days.withColumn("_m", month).withColumn("_total", F.sum("precipitation_mm").over(Window.partitionBy("_m")))
    order = F.struct(F.col("_total").isNotNull().alias("known"), F.col("_total").alias("total"), (-F.col("_m")).alias("m"))
    return (totals.withColumn("_wet", F.max_by("_m", order).over(Window.partitionBy()))
            .filter((F.col("_m") == F.col("_wet")) & F.col("_trips"))
            .drop("_trips", "_m", "_total", "_wet"))


def rain_elasticity(weather: DataFrame, daily: DataFrame, predictor: str = "precipitation_mm",
                    elastic_slope: float = params.ELASTIC_SLOPE,
                    inelastic_corr: float = params.INELASTIC_CORR,
                    with_p_value: bool = True) -> DataFrame:
    """One row: correlation, OLS slope / intercept / r^2 / n, p-value and labels.

    The correlation drops days with a null predictor; the regression counts
    them as 0 (as the audited pipeline does). The slope label says ``elastic``
    when |slope| > 1000; the page label says ``Inelastic`` when |corr| < 0.5.
    """
    x = F.col(predictor)
    x0 = F.coalesce(x, F.lit(0.0))
    y = F.col("trip_count").cast("double")
    stats = (weather.select("date", predictor).join(daily.select("date", "trip_count"), "date", "inner")
             .agg(F.corr(x, y).alias("correlation"),
                  F.regr_slope(y, x0).alias("slope"),
                  F.regr_intercept(y, x0).alias("intercept"),
                  F.corr(x0, y).alias("_r"),
                  F.regr_count(y, x0).alias("n")))
    out = stats.select(
        "correlation", "slope", "intercept",
        (F.col("_r") * F.col("_r")).alias("r_squared"),
        "n",
        *([regression_p_value(F.col("_r"), F.col("n")).alias("p_value")] if with_p_value else []),
        F.when(F.abs(F.col("slope")) > elastic_slope, F.lit("elastic"))
         .otherwise(F.lit("inelastic")).alias("interpretation"),
        F.when(F.abs(F.col("correlation")) < inelastic_corr, F.lit("Inelastic"))
         .otherwise(F.lit("Elastic")).alias("page_label"),
    )
    return out
