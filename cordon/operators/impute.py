"""Hour-by-weekday profiles of a month and the weighted fill of a missing month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.mathexpr import blend
from cordon.functions.scope import scope
from cordon.functions.timeexpr import day_of_week, month_range


def _month_of_years(trips: DataFrame, month: int, years) -> DataFrame:
    trips = scope(trips, years=years, months=[month])
    cond = None
    for y in years:
        c = month_range("pickup_time", y, month, month)
        cond = c if cond is None else (cond | c)
    return trips.filter(cond)


def imputation_profile(trips: DataFrame, taxi_type: str, month: int,
                       years=params.IMPUTE_YEARS) -> DataFrame:
    """Per (year, hour, day_of_week) of one type and month: count and means."""
    return (_month_of_years(trips.filter(F.col("taxi_type") == taxi_type), month, years)
            .groupBy(F.year("pickup_time").alias("year"), F.hour("pickup_time").alias("hour"),
                     day_of_week("pickup_time").alias("day_of_week"))
            .agg(F.count(F.lit(1)).alias("trip_count"),
                 F.avg("fare").alias("avg_fare"),
                 F.avg("total_amount").alias("avg_total"),
                 F.avg("tip_amount").alias("avg_tip")))


def month_profile(trips: DataFrame, year: int, month: int = 12) -> DataFrame:
    """Per (hour, dow) of one month: count_{y}, fare_{y}, total_{y}."""
    return (_month_of_years(trips, month, [year])
            .groupBy(F.hour("pickup_time").alias("hour"), day_of_week("pickup_time").alias("dow"))
            .agg(F.count(F.lit(1)).alias(f"count_{year}"),
                 F.avg("fare").alias(f"fare_{year}"),
                 F.avg("total_amount").alias(f"total_{year}")))


def _imputed(df: DataFrame, years, weights, renormalize: bool) -> DataFrame:
    (y1, y2), (w1, w2) = years, weights
    out = df
    for measure in ("count", "fare", "total"):
        a, b = f"{measure}_{y1}", f"{measure}_{y2}"
        value = blend(a, b, w1, w2)
        if renormalize:
            present = (F.when(F.col(a).isNotNull(), F.lit(float(w1))).otherwise(F.lit(0.0))
                       + F.when(F.col(b).isNotNull(), F.lit(float(w2))).otherwise(F.lit(0.0)))
            value = value / present
        out = out.withColumn(f"imputed_{measure}", value)
    return out


def impute_month(trips: DataFrame, month: int = 12, years=params.IMPUTE_YEARS,
                 weights=params.IMPUTE_WEIGHTS, renormalize: bool = False) -> DataFrame:
    """Weighted blend of one month's (hour, dow) profile over two earlier years.

    One scan and one shuffle: each year's count and means are conditional
    aggregates, null where the year has no trips in that cell (what a full
    outer join of two profiles gives). A missing side counts as 0 in the blend;
    ``renormalize`` divides by the weights actually present instead.
    """
    y1, y2 = years
    year = F.year("pickup_time")
    aggs = []
    for y in (y1, y2):
        hit = year == y
        aggs += [F.nullif(F.count_if(hit), F.lit(0)).alias(f"count_{y}"),
                 F.avg(F.when(hit, F.col("fare"))).alias(f"fare_{y}"),
                 F.avg(F.when(hit, F.col("total_amount"))).alias(f"total_{y}")]
    prof = (_month_of_years(trips, month, [y1, y2])
            .groupBy(F.hour("pickup_time").alias("hour"), day_of_week("pickup_time").alias("dow"))
            .agg(*aggs))
    return _imputed(prof, years, weights, renormalize)


def impute_month_by_join(trips: DataFrame, month: int = 12, years=params.IMPUTE_YEARS,
                         weights=params.IMPUTE_WEIGHTS, renormalize: bool = False) -> DataFrame:
    """Same result as ``impute_month`` via a full outer join of two profiles."""
    y1, y2 = years
    joined = month_profile(trips, y1, month).join(
        month_profile(trips, y2, month), ["hour", "dow"], "full")
    return _imputed(joined, years, weights, renormalize)


def impute_where_missing(trips: DataFrame, gate: DataFrame, years, month: int = 12,
                         weights=params.IMPUTE_WEIGHTS) -> DataFrame:
    """(year, hour, dow, imputed_*) of each of `years` whose `month` the gate (``catalog.imputation_gate``) finds missing.

    A month that is at hand is not imputed: its year has no row. The two years before are blended; one scan and one
    aggregate serve all years, and each year's cells go on to the two years that they may fill.
    """
    years = [int(y) for y in years]
    sources = sorted({y - back for y in years for back in (1, 2)})
    cells = (_month_of_years(trips, month, sources)
             .groupBy(F.year("pickup_time").alias("source"), F.hour("pickup_time").alias("hour"), day_of_week("pickup_time").alias("dow"))
             .agg(F.count(F.lit(1)).cast("double").alias("count"), F.avg("fare").alias("fare"), F.avg("total_amount").alias("total")))
    cells = cells.withColumn("year", F.explode(F.array(F.col("source") + 2, F.col("source") + 1))).filter(F.col("year").isin(years))
    weight = F.when(F.col("year") - F.col("source") == 2, F.lit(float(weights[0]))).otherwise(F.lit(float(weights[1])))
    due = gate.filter("needs_imputation").select("year")
    return (cells.join(due, "year", "left_semi").groupBy("year", "hour", "dow")
            .agg(*[F.coalesce(F.sum(weight * F.col(m)), F.lit(0.0)).alias(f"imputed_{m}") for m in ("count", "fare", "total")]))
