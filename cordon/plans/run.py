"""The full audit over raw monthly trip files.

    catalog -> unify -> flag -> write flagged table (year-partitioned) once
    -> every aggregate reads pruned partitions of that table
    -> small results as CSV, ghost audit as Parquet, report as JSON.

Only bounded aggregates (at most a few hundred rows) are coalesced to one
file; nothing trip-level passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon import params
from cordon.operators import flag as fl
from cordon.operators import impute, profile, summary, weather as wx, zone
from cordon.plans import fused as fz
from cordon.plans.report import report_document, report_json, report_rows
from cordon.plans.store import unflagged, write_flagged
from cordon.sources import catalog, trips, zones


def write_small(df: DataFrame, path: str, null: str = "") -> str:
    """CSV with header, one file: only for results of bounded size; nulls are written as `null`.

    Repartitioned, not coalesced: the last aggregation keeps its tasks.
    """
    ordered = df.withColumn("_ord", F.monotonically_increasing_id())
    ordered.repartition(1).sortWithinPartitions("_ord").drop("_ord").write.mode("overwrite").options(header=True, nullValue=null, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def run(spark: SparkSession, trips_dir: str, out_dir: str, lookup_path: str | None = None,
        weather: DataFrame | None = None, year: int = params.ANALYSIS_YEAR,
        comparison: int = params.COMPARISON_YEAR, fused: bool = True) -> dict[str, str]:
    """Run every step; returns output name -> path.

    With ``fused`` the calendar/zone profiles fold one materialised base
    aggregate of clean trips instead of scanning the clean trips each.
    """
    out = out_dir.rstrip("/")
    paths: dict[str, str] = {}

    # Step 1: what files are there (names that parse, sizes; unmatched reported).
    paths["catalog"] = f"{out}/catalog"
    catalog.local_catalog(spark, trips_dir).write.mode("overwrite").parquet(paths["catalog"])
    paths["file_check"] = f"{out}/file_check"
    trips.validate_files(spark, trips_dir).write.mode("overwrite").parquet(paths["file_check"])

    # Steps 2-3: a footer that can't be read stops the run. Trip files without a pickup
    # column are left out and reported with their rows; then flag, and materialise once.
    check = spark.read.parquet(paths["file_check"])
    unread = check.filter(F.col("error").isNotNull()).orderBy("path").limit(5).collect()
    if unread:
        raise ValueError("trip files whose footer can't be read: " + "; ".join(f"{r.path} ({r.error})" for r in unread))
    if not check.filter("ok").limit(1).collect():
        raise ValueError(f"no readable yellow or green trip files under {trips_dir}")
    skipped = check.filter("NOT ok AND taxi_type IS NOT NULL").select("path", "n_rows")
    paths["flagged"] = f"{out}/flagged"
    some = skipped.limit(1).count() > 0
    write_flagged(fl.flag(trips.read_directory(spark, trips_dir, skipped if some else None)), paths["flagged"])
    flagged = spark.read.parquet(paths["flagged"])
    clean = fl.clean(flagged)
    paths["ghost_audit"] = fl.save_audit(flagged, f"{out}/audit/ghost_trips")

    lookup = zones.read_lookup(spark, lookup_path) if lookup_path else params.ZONE_NAMES
    if fused:
        paths["base"] = f"{out}/base"
        (fz.with_year(fz.base_aggregate(clean)).write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy(*fz.BASE_PARTITION).parquet(paths["base"]))
        base = spark.read.parquet(paths["base"])
        ops = dict(
            compliance=fz.surcharge_compliance(base),
            missing=fz.missing_surcharge_locations(base),
            quarterly=fz.quarterly_volumes(base),
            direction=fz.zone_direction_summary(base),
            revenue=fz.surcharge_revenue(base, year),
            speeds_before=fz.hourly_speeds(base, comparison, 1),
            speeds_after=fz.hourly_speeds(base, year, 1),
            daily=fz.daily_trips(base, year),
            monthly=fz.monthly_tips(base, year),
            border=fz.border_effect(base, comparison, year))
    else:
        ops = dict(
            compliance=zone.surcharge_compliance(clean),
            missing=zone.missing_surcharge_locations(clean),
            quarterly=zone.quarterly_volumes(clean),
            direction=zone.zone_direction_summary(clean),
            revenue=zone.surcharge_revenue(clean, year),
            speeds_before=profile.hourly_speeds(clean, comparison, 1),
            speeds_after=profile.hourly_speeds(clean, year, 1),
            daily=profile.daily_trips(clean, year),
            monthly=profile.monthly_tips(clean, year),
            border=profile.border_effect(clean, comparison, year))
    border = profile.border_markers(profile.with_zone_names(
        profile.with_coordinates(ops["border"]), lookup))
    daily = ops["daily"]

    small = {
        "trip_counts": fl.trip_counts(flagged),
        "ghost_summary": fl.ghost_summary(flagged),
        "suspicious_vendors": fl.suspicious_vendors(flagged),
        "compliance": ops["compliance"],
        "missing_surcharge_locations": ops["missing"],
        "quarterly_comparison": ops["quarterly"],
        "zone_direction_summary": ops["direction"],
        "surcharge_revenue": ops["revenue"],
        f"velocity_q1_{comparison}": ops["speeds_before"],
        f"velocity_q1_{year}": ops["speeds_after"],
        f"daily_trips_{year}": daily,
        "tips_surcharge": ops["monthly"],
        "border_effect": border,
        "skipped_files": skipped.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("trips")),
    }
    # Months at hand and missing; the missing month is imputed only where it is missing.
    at_hand = catalog.available_months(spark.read.parquet(paths["catalog"]).join(skipped.select("path"), "path", "left_anti"))
    month_of = F.explode("months").alias("month")
    missing = catalog.missing_from_expected(
        catalog.expected_catalog(spark, [year]), at_hand.select("year", "taxi_type", month_of))
    small["available_months"] = at_hand.select("year", "taxi_type", month_of).orderBy("year", "taxi_type", "month")
    small["missing_months"] = missing.orderBy("year", "taxi_type", "month")
    if catalog.needs_imputation(missing, 12).first()[0]:
        small[f"december_{year}_imputed"] = impute.impute_month(
            unflagged(flagged), 12, (comparison - 1, comparison))
    sections = {
        "total_surcharge_revenue": small["surcharge_revenue"],
        "suspicious_vendors": small["suspicious_vendors"],
        "compliance_rate": small["compliance"],
        "missing_surcharge_locations": small["missing_surcharge_locations"],
        "skipped_files": small["skipped_files"],
    }
    # Page figures, folded from the small results above.
    small[f"velocity_pivot_q1_{comparison}"] = summary.velocity_pivot(ops["speeds_before"])
    small[f"velocity_pivot_q1_{year}"] = summary.velocity_pivot(ops["speeds_after"])
    small["velocity_change"] = summary.cells_change(
        fz.velocity_cells(base, [comparison, year]) if fused
        else summary.velocity_cells(clean, [comparison, year]), comparison, year)
    small["tip_change"] = summary.tip_change(ops["monthly"])
    small["border_summary"] = summary.border_summary(border)
    if weather is not None:
        small["weather_trips"] = wx.weather_trips(weather, daily)
        small["wettest_month_trips"] = wx.wettest_month_trips(weather, daily)
        small["wettest_month"] = wx.wettest_month(weather)
        small["rain_elasticity"] = wx.rain_elasticity(weather, daily)
        sections["rain_elasticity"] = small["rain_elasticity"]

    for name, df in small.items():
        paths[name] = write_small(df, f"{out}/processed/{name}")

    rows = report_rows(sections)
    paths["report_rows"] = f"{out}/report/rows"
    rows.repartition(1).write.mode("overwrite").json(paths["report_rows"])
    paths["report"] = f"{out}/report/sections"
    report_json(sections).repartition(1).write.mode("overwrite").json(paths["report"])
    paths["report_document"] = f"{out}/report/document"
    report_document(spark.read.schema("section string, json string").json(paths["report"])).write.mode("overwrite").text(paths["report_document"])
    return paths


def main(argv=None) -> None:
    """python -m cordon.plans.run TRIPS_DIR OUT_DIR [--lookup CSV] [--weather JSON]"""
    import argparse
    import json

    from cordon.sources import weather as wsrc

    ap = argparse.ArgumentParser(description="Trip audit over raw monthly files")
    ap.add_argument("trips_dir")
    ap.add_argument("out_dir")
    ap.add_argument("--lookup", default=None, help="zone lookup CSV")
    ap.add_argument("--weather", default=None, help="archive weather JSON document(s)")
    ap.add_argument("--year", type=int, default=params.ANALYSIS_YEAR)
    ap.add_argument("--direct", action="store_true", help="skip the fused base aggregate")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("cordon-run").getOrCreate()
    weather = wsrc.read_responses(spark, args.weather) if args.weather else None
    paths = run(spark, args.trips_dir, args.out_dir, lookup_path=args.lookup, weather=weather,
                year=args.year, comparison=args.year - 1, fused=not args.direct)
    print(json.dumps(paths, indent=2))


if __name__ == "__main__":
    main()
