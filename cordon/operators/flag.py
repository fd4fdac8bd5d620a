"""Implausible ("ghost") trip classification, split, summaries and audit sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.mathexpr import pct_of_or_zero
from cordon.functions.timeexpr import duration_seconds


def flag(trips: DataFrame, max_mph: float = params.MAX_SPEED_MPH,
         min_minutes: float = params.MIN_TRIP_MINUTES,
         min_fare: float = params.TELEPORTER_FARE) -> DataFrame:
    """Add trip_duration_min, avg_speed_mph and ghost_type (first rule wins).

    Speed is 0 when the duration is not positive or unknown. A null input in a
    rule leaves it unknown, so the trip falls through to the next rule.
    Row-local: no shuffle, runs the same on a stream.
    """
    secs = duration_seconds("pickup_time", "dropoff_time")
    with_speed = trips.withColumns({
        "trip_duration_min": secs / F.lit(60.0),
        "avg_speed_mph": F.when(secs > 0, F.col("trip_distance") / (secs / F.lit(3600.0)))
                          .otherwise(F.lit(0.0)),
    })
    ghost = (F.when(F.col("avg_speed_mph") > max_mph, F.lit(params.GHOST_IMPOSSIBLE))
             .when((F.col("trip_duration_min") < min_minutes) & (F.col("fare") > min_fare),
                   F.lit(params.GHOST_TELEPORTER))
             .when((F.col("trip_distance") == 0) & (F.col("fare") > 0),
                   F.lit(params.GHOST_STATIONARY)))
    return with_speed.withColumn("ghost_type", ghost)


def clean(flagged: DataFrame) -> DataFrame:
    """Trips no rule flagged."""
    return flagged.filter(F.col("ghost_type").isNull())


def ghosts(flagged: DataFrame) -> DataFrame:
    """Trips some rule flagged."""
    return flagged.filter(F.col("ghost_type").isNotNull())


def trip_counts(flagged: DataFrame) -> DataFrame:
    """total / clean / ghost trip counts in one pass."""
    is_ghost = F.col("ghost_type").isNotNull()
    return flagged.agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.count_if(~is_ghost).alias("clean_trips"),
        F.count_if(is_ghost).alias("ghost_trips"),
    )


def ghost_stats(flagged: DataFrame) -> DataFrame:
    """total, ghost, clean and ghost rate % (0 when there are no trips)."""
    return trip_counts(flagged).select(
        "total_trips", "ghost_trips", "clean_trips",
        pct_of_or_zero("ghost_trips", "total_trips").alias("ghost_rate"))


def ghost_summary(flagged: DataFrame) -> DataFrame:
    """Per ghost class: count, average fare, average distance."""
    return (ghosts(flagged).groupBy("ghost_type")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.avg("fare").alias("avg_fare"),
                 F.avg("trip_distance").alias("avg_distance")))


def suspicious_vendors(flagged: DataFrame, top_n: int = params.SUSPICIOUS_TOP_N) -> DataFrame:
    """Top vendors by ghost-trip count, with their share of all ghost trips.

    One scan: the share's denominator is the sum of the vendors' counts (a window over one row
    per vendor, never over trips). Ties on the count break by vendor id.
    """
    per_vendor = (ghosts(flagged).groupBy("vendor_id")
                  .agg(F.count(F.lit(1)).alias("ghost_trip_count"),
                       F.sum("fare").alias("total_suspicious_fare")))
    return (per_vendor
            .withColumn("_all", F.sum("ghost_trip_count").over(Window.partitionBy()))
            .orderBy(F.desc("ghost_trip_count"), F.asc_nulls_last("vendor_id"))
            .limit(top_n)
            .withColumn("pct_of_all_ghost_trips",
                        F.col("ghost_trip_count") * F.lit(100.0) / F.col("_all"))
            .drop("_all"))


def save_audit(flagged: DataFrame, path: str, partition_by_class: bool = True) -> str:
    """Write the ghost trips as Parquet (overwrite), partitioned by class."""
    writer = ghosts(flagged).write.mode("overwrite")
    if partition_by_class:
        writer = writer.partitionBy("ghost_type")
    writer.parquet(path)
    return path
