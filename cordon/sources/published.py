"""Typed readers for the CSV outputs of an earlier run (dates parsed).

Later steps normally receive DataFrames directly; these readers serve a step
that starts from stored outputs, with the schema fixed instead of inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "velocity": "hour int, day_of_week int, avg_speed_mph double, trip_count bigint",
    "daily_trips": "date date, trip_count bigint, total_revenue double, avg_surcharge double",
    "tips_surcharge": "month int, avg_surcharge double, avg_tip_pct double, "
                      "total_surcharge double, total_tips double, trip_count bigint",
    "border_effect": "dropoff_loc int, count_2024 bigint, count_2025 bigint, pct_change double, "
                     "lat double, lon double, LocationID int, zone_name string",
    "weather_trips": "date date, precipitation_mm double, rain_mm double, trip_count bigint, "
                     "total_revenue double, avg_surcharge double",
    "december_imputed": "hour int, dow int, count_2023 double, fare_2023 double, "
                        "total_2023 double, count_2024 bigint, fare_2024 double, "
                        "total_2024 double, imputed_count double, imputed_fare double, "
                        "imputed_total double",
}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Read a published CSV of `kind` (a key of SCHEMAS) with its fixed schema."""
    return spark.read.option("header", True).schema(SCHEMAS[kind]).csv(path)
