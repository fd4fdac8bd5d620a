"""Cordon membership, surcharge compliance, volumes and revenue.

Zone membership is a literal IN-list of at most a few dozen ids: it needs no
join and no shuffle, and it reaches the Parquet scan as a pushed filter.
A null location is neither in nor out (SQL three-valued logic), exactly as
``loc NOT IN (subquery)`` treats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.mathexpr import pct_of
from cordon.functions.scope import scope
from cordon.functions.timeexpr import quarter_range, since, year_range


def in_zone(c: str, ids=params.CONGESTION_ZONE_IDS) -> Column:
    return F.col(c).isin(list(ids))


def not_in_zone(c: str, ids=params.CONGESTION_ZONE_IDS) -> Column:
    return ~F.col(c).isin(list(ids))


def zone_entries(trips: DataFrame, start: str = params.CONGESTION_START,
                 ids=params.CONGESTION_ZONE_IDS) -> DataFrame:
    """Trips from outside the cordon into it, picked up at or after `start`."""
    trips = scope(trips, min_year=int(str(start)[:4]))
    return trips.filter(since("pickup_time", start) & not_in_zone("pickup_loc", ids)
                        & in_zone("dropoff_loc", ids))


def _paid() -> Column:
    return F.col("congestion_surcharge") > 0


def _missing() -> Column:
    s = F.col("congestion_surcharge")
    return (s == 0) | s.isNull()


def surcharge_compliance(clean: DataFrame, start: str = params.CONGESTION_START) -> DataFrame:
    """Zone entries with / without surcharge and the compliance rate.

    Negative surcharges count as neither paid nor missing; they are reported
    in their own column so the three add up to the total.
    """
    return zone_entries(clean, start).agg(
        F.count(F.lit(1)).alias("total_zone_entry_trips"),
        F.count_if(_paid()).alias("trips_with_surcharge"),
        F.count_if(_missing()).alias("trips_without_surcharge"),
        F.count_if(F.col("congestion_surcharge") < 0).alias("trips_negative_surcharge"),
        pct_of(F.count_if(_paid()), F.count(F.lit(1))).alias("compliance_rate"),
    )


def missing_surcharge_locations(clean: DataFrame, min_entries: int = params.MISSING_MIN_ENTRIES,
                                top_n: int = params.MISSING_TOP_N,
                                start: str = params.CONGESTION_START) -> DataFrame:
    """Pickup zones whose entries most often lack the surcharge (top n)."""
    return (zone_entries(clean, start).groupBy("pickup_loc")
            .agg(F.count(F.lit(1)).alias("total_entries"),
                 F.count_if(_missing()).alias("missing_surcharge"))
            .filter(F.col("total_entries") >= min_entries)
            .withColumn("missing_rate", pct_of("missing_surcharge", "total_entries"))
            .orderBy(F.desc("missing_rate"), F.asc_nulls_last("pickup_loc"))
            .limit(top_n))


def quarter_label(year_quarters=((2024, 1), (2025, 1))) -> Column:
    """'Q{q}_{year}' for pickups inside one of the listed quarters, else null."""
    label = None
    for year, quarter in year_quarters:
        cond = quarter_range("pickup_time", year, quarter)
        text = F.lit(f"Q{quarter}_{year}")
        label = F.when(cond, text) if label is None else label.when(cond, text)
    return label


def quarterly_volumes(clean: DataFrame, year_quarters=((2024, 1), (2025, 1))) -> DataFrame:
    """Trips into the cordon per taxi type and quarter."""
    in_any = None
    for year, quarter in year_quarters:
        cond = quarter_range("pickup_time", year, quarter)
        in_any = cond if in_any is None else (in_any | cond)
    clean = scope(clean, years={y for y, _ in year_quarters},
                  months={m for _, q in year_quarters for m in range(3 * q - 2, 3 * q + 1)})
    return (clean.filter(in_zone("dropoff_loc") & in_any)
            .groupBy("taxi_type", quarter_label(year_quarters).alias("quarter"))
            .agg(F.count(F.lit(1)).alias("trip_count"))
            .orderBy("taxi_type", "quarter"))


def direction(pickup: str = "pickup_loc", dropoff: str = "dropoff_loc") -> Column:
    """within_zone / entering_zone / exiting_zone / outside_zone."""
    return (F.when(in_zone(pickup) & in_zone(dropoff), F.lit("within_zone"))
            .when(not_in_zone(pickup) & in_zone(dropoff), F.lit("entering_zone"))
            .when(in_zone(pickup) & not_in_zone(dropoff), F.lit("exiting_zone"))
            .otherwise(F.lit("outside_zone")))


def zone_direction_summary(clean: DataFrame, start: str = params.CONGESTION_START) -> DataFrame:
    """Trips since `start` by direction: count, average total, average surcharge."""
    clean = scope(clean, min_year=int(str(start)[:4]))
    return (clean.filter(since("pickup_time", start))
            .groupBy(direction().alias("trip_type"))
            .agg(F.count(F.lit(1)).alias("trip_count"),
                 F.avg("total_amount").alias("avg_total"),
                 F.avg("congestion_surcharge").alias("avg_surcharge")))


def surcharge_revenue(clean: DataFrame, year: int = params.ANALYSIS_YEAR) -> DataFrame:
    """Surcharge sum, count and average over trips of `year` that paid one."""
    return (scope(clean, years=[year]).filter(year_range("pickup_time", year) & _paid())
            .agg(F.sum("congestion_surcharge").alias("total_surcharge_revenue"),
                 F.count(F.lit(1)).alias("total_trips_with_surcharge"),
                 F.avg("congestion_surcharge").alias("avg_surcharge")))


def zone_entries_by_roster(trips: DataFrame, roster: DataFrame, start: str = params.CONGESTION_START,
                           id_col: str = "zone_id") -> DataFrame:
    """``zone_entries`` where the cordon is a table: a left semi join on the drop-off, a null-aware anti join on the pickup.

    As ``NOT IN``: a null pickup is not outside (unless the roster is empty), and a null id in the roster leaves no
    pickup that is known to be outside. Repeated ids do not repeat trips.
    """
    trips = scope(trips, min_year=int(str(start)[:4])).filter(since("pickup_time", start))
    return trips.sparkSession.sql(
        f"SELECT * FROM {{trips}} WHERE dropoff_loc IN (SELECT `{id_col}` FROM {{roster}}) "
        f"AND pickup_loc NOT IN (SELECT `{id_col}` FROM {{roster}})", trips=trips, roster=roster)


def direction_by_roster(trips: DataFrame, roster: DataFrame, id_col: str = "zone_id") -> DataFrame:
    """Trips with ``trip_type`` (see ``direction``) by existence joins with a roster table; null ids of the roster are no zones."""
    ids = roster.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_zone")).distinct()
    out = trips
    for side in ("pickup", "dropoff"):
        there = ids.withColumn(f"_{side}_in", F.lit(True))
        out = out.join(there, F.col(f"{side}_loc") == F.col("_zone"), "left").drop("_zone")
        out = out.withColumn(f"_{side}_in", F.when(F.col(f"{side}_loc").isNotNull(), F.col(f"_{side}_in").isNotNull()))
    pickup, dropoff = F.col("_pickup_in"), F.col("_dropoff_in")
    kind = (F.when(pickup & dropoff, F.lit("within_zone")).when(~pickup & dropoff, F.lit("entering_zone"))
            .when(pickup & ~dropoff, F.lit("exiting_zone")).otherwise(F.lit("outside_zone")))
    return out.withColumn("trip_type", kind).drop("_pickup_in", "_dropoff_in")
