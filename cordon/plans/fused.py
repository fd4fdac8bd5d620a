"""One base table of clean trips that every calendar/zone profile folds again.

At full scale the clean-trip table is billions of rows, and each profile would
scan it. One scan instead adds every trip to the cells of the grains it matters
to, each with as few keys as its profiles need:

* ``day``: date, taxi type, pickup in the cordon?, drop-off in the cordon? (any trip),
* ``entry``: pickup zone and month (zone entries; days in the toll's first month),
* ``speed``: year, quarter, hour, weekday (trips within the cordon),
* ``border``: year and drop-off zone (drop-offs in a border zone).

Counts and additive sums only; a mean keeps its own count, since nulls don't count
in it. The cells are bounded by days and zones, not by trips. Float sums are sums
of partial sums and may differ from the direct operators in the last digits.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.mathexpr import pct_change, pct_of, tip_pct
from cordon.functions.timeexpr import day_of_week
from cordon.operators.profile import speed_over
from cordon.operators.zone import in_zone, not_in_zone

# The base is written partitioned by these; profiles prune to their grain and years.
BASE_PARTITION = ("grain", "year")
_KEYS = "struct<grain:string,year:int,date:date,taxi_type:string,pickup_in:boolean,dropoff_in:boolean,loc:int,quarter:int,hour:int,day_of_week:int>"
_START = _dt.date.fromisoformat(params.CONGESTION_START)


def with_year(base: DataFrame) -> DataFrame:
    """Rows in the order of their partitions; no shuffle, the base is small."""
    return base.sortWithinPartitions(*BASE_PARTITION)


def _cell(grain: str, **keys: Column) -> Column:
    fields = [f.split(":")[0] for f in _KEYS[len("struct<"):-1].split(",")]
    values = {"grain": F.lit(grain), "year": F.year("pickup_time"), **keys}
    return F.struct(*[values.get(f, F.lit(None)).alias(f) for f in fields]).cast(_KEYS)


def base_aggregate(clean: DataFrame) -> DataFrame:
    date = F.to_date("pickup_time")
    month = F.trunc("pickup_time", "month").cast("date")
    first = F.lit(_START.replace(day=1))
    cells = F.array_compact(F.array(
        _cell("day", date=date, taxi_type=F.col("taxi_type"), pickup_in=in_zone("pickup_loc"), dropoff_in=in_zone("dropoff_loc")),
        F.when(not_in_zone("pickup_loc") & in_zone("dropoff_loc"),
               _cell("entry", date=F.when(month == first, date).otherwise(month), loc=F.col("pickup_loc"))),
        F.when(in_zone("pickup_loc") & in_zone("dropoff_loc"),
               _cell("speed", quarter=F.quarter("pickup_time"), hour=F.hour("pickup_time"), day_of_week=day_of_week("pickup_time"))),
        F.when(F.col("dropoff_loc").isin(list(params.BORDER_ZONE_IDS)), _cell("border", loc=F.col("dropoff_loc")))))
    s = F.col("congestion_surcharge")
    spread = clean.select(F.explode(cells).alias("cell"), "total_amount", "congestion_surcharge", "tip_amount",
                          tip_pct().alias("tip_pct"), speed_over().alias("speed"))
    return (spread.groupBy("cell")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("total_amount").alias("sum_total"),
                 F.count("total_amount").alias("n_total"),
                 F.count("congestion_surcharge").alias("n_surcharge"),
                 F.sum(s).alias("sum_surcharge"),
                 F.sum("tip_amount").alias("sum_tips"),
                 F.sum("tip_pct").alias("sum_tip_pct"),
                 F.count("tip_pct").alias("n_tip_pct"),
                 F.count_if(s > 0).alias("n_paid"),
                 F.sum(F.when(s > 0, s)).alias("sum_paid_surcharge"),
                 F.count_if((s == 0) | s.isNull()).alias("n_missing"),
                 F.count_if(s < 0).alias("n_negative"),
                 F.sum("speed").alias("sum_speed"),
                 F.count("speed").alias("n_speed"))
            .select("cell.*", "*").drop("cell"))


def _grain(base: DataFrame, grain: str, years=None, min_year=None) -> DataFrame:
    base = base.filter(F.col("grain") == grain)
    if years is not None:
        base = base.filter(F.col("year").isin([int(y) for y in years]))
    if min_year is not None:
        base = base.filter(F.col("year") >= int(min_year))
    return base


def _d(value) -> Column:
    return F.lit(_dt.date.fromisoformat(str(value)[:10]))


def _n(col="n") -> Column:
    return F.sum(col).cast("long")


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.sum(total), F.sum(count))


def surcharge_compliance(base: DataFrame, start: str = params.CONGESTION_START) -> DataFrame:
    def total(col):
        return F.coalesce(_n(col), F.lit(0).cast("long"))

    entries = _grain(base, "day", min_year=int(str(start)[:4])).filter(
        (F.col("date") >= _d(start)) & ~F.col("pickup_in") & F.col("dropoff_in"))
    return entries.agg(
        total("n").alias("total_zone_entry_trips"),
        total("n_paid").alias("trips_with_surcharge"),
        total("n_missing").alias("trips_without_surcharge"),
        total("n_negative").alias("trips_negative_surcharge"),
        pct_of(total("n_paid"), total("n")).alias("compliance_rate"))


def missing_surcharge_locations(base: DataFrame, min_entries: int = params.MISSING_MIN_ENTRIES,
                                top_n: int = params.MISSING_TOP_N,
                                start: str = params.CONGESTION_START) -> DataFrame:
    """`start` is the first of a month, or a day of the toll's first month (the days the base keeps)."""
    day = _dt.date.fromisoformat(str(start)[:10])
    if day.day != 1 and day.replace(day=1) != _START.replace(day=1):
        raise ValueError(f"the base keeps whole months outside the toll's first month: {start}")
    return (_grain(base, "entry", min_year=day.year).filter(F.col("date") >= F.lit(day)).groupBy(F.col("loc").alias("pickup_loc"))
            .agg(_n().alias("total_entries"), _n("n_missing").alias("missing_surcharge"))
            .filter(F.col("total_entries") >= min_entries)
            .withColumn("missing_rate", pct_of("missing_surcharge", "total_entries"))
            .orderBy(F.desc("missing_rate"), F.asc_nulls_last("pickup_loc"))
            .limit(top_n))


def quarterly_volumes(base: DataFrame, year_quarters=((2024, 1), (2025, 1))) -> DataFrame:
    day = _grain(base, "day", years={y for y, _ in year_quarters}).filter(F.col("dropoff_in"))
    quarter = F.concat(F.lit("Q"), F.quarter("date"), F.lit("_"), F.col("year"))
    return (day.withColumn("quarter", quarter).filter(F.col("quarter").isin([f"Q{q}_{y}" for y, q in year_quarters]))
            .groupBy("taxi_type", "quarter").agg(_n().alias("trip_count")).orderBy("taxi_type", "quarter"))


def zone_direction_summary(base: DataFrame, start: str = params.CONGESTION_START) -> DataFrame:
    p, d = F.col("pickup_in"), F.col("dropoff_in")
    direction = (F.when(p & d, "within_zone").when(~p & d, "entering_zone").when(p & ~d, "exiting_zone")
                 .otherwise("outside_zone"))
    return (_grain(base, "day", min_year=int(str(start)[:4])).filter(F.col("date") >= _d(start))
            .groupBy(direction.alias("trip_type"))
            .agg(_n().alias("trip_count"),
                 _mean("sum_total", "n_total").alias("avg_total"),
                 _mean("sum_surcharge", "n_surcharge").alias("avg_surcharge")))


def surcharge_revenue(base: DataFrame, year: int = params.ANALYSIS_YEAR) -> DataFrame:
    return (_grain(base, "day", [year]).filter(F.col("n_paid") > 0)
            .agg(F.sum("sum_paid_surcharge").alias("total_surcharge_revenue"),
                 F.coalesce(_n("n_paid"), F.lit(0)).alias("total_trips_with_surcharge"),
                 _mean("sum_paid_surcharge", "n_paid").alias("avg_surcharge")))


def hourly_speeds(base: DataFrame, year: int, quarter: int) -> DataFrame:
    return (_grain(base, "speed", [year]).filter(F.col("quarter") == quarter)
            .groupBy("hour", "day_of_week")
            .agg(_mean("sum_speed", "n_speed").alias("avg_speed_mph"), _n().alias("trip_count"))
            .orderBy("day_of_week", "hour"))


def daily_trips(base: DataFrame, year: int = params.ANALYSIS_YEAR) -> DataFrame:
    return (_grain(base, "day", [year]).groupBy("date")
            .agg(_n().alias("trip_count"), F.sum("sum_total").alias("total_revenue"),
                 _mean("sum_surcharge", "n_surcharge").alias("avg_surcharge"))
            .orderBy("date"))


def monthly_tips(base: DataFrame, year: int = params.ANALYSIS_YEAR) -> DataFrame:
    return (_grain(base, "day", [year]).groupBy(F.month("date").alias("month"))
            .agg(_mean("sum_surcharge", "n_surcharge").alias("avg_surcharge"),
                 _mean("sum_tip_pct", "n_tip_pct").alias("avg_tip_pct"),
                 F.sum("sum_surcharge").alias("total_surcharge"),
                 F.sum("sum_tips").alias("total_tips"),
                 _n().alias("trip_count"))
            .orderBy("month"))


def border_effect(base: DataFrame, before: int = params.COMPARISON_YEAR,
                  after: int = params.ANALYSIS_YEAR) -> DataFrame:
    year = F.col("year")
    return (_grain(base, "border", [before, after]).groupBy(F.col("loc").alias("dropoff_loc"))
            .agg(F.sum(F.when(year == before, F.col("n")).otherwise(0)).cast("long").alias(f"count_{before}"),
                 F.sum(F.when(year == after, F.col("n")).otherwise(0)).cast("long").alias(f"count_{after}"))
            .withColumn("pct_change", pct_change(f"count_{before}", f"count_{after}"))
            .orderBy(F.desc("pct_change"), F.asc("dropoff_loc")))


def velocity_cells(base: DataFrame, years, quarter: int = 1) -> DataFrame:
    """(year, hour, day_of_week) speed cells of one quarter in several years."""
    return (_grain(base, "speed", years).filter(F.col("quarter") == quarter)
            .groupBy("year", "hour", "day_of_week")
            .agg(_mean("sum_speed", "n_speed").alias("avg_speed_mph"), _n().alias("trip_count")))
