"""Registered queries over the benchmark tables: name -> (spark, sf_dir) -> DataFrame.

Trips come from ``lineitem`` and weather from ``orders`` through
``cordon.sources.adapter``; links come from ``pages``. Each query is the
library operator applied to whole tables.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon import params
from cordon.functions.scope import scope
from cordon.functions.timeexpr import since
from cordon.operators import flag as fl
from cordon.operators import impute, profile, summary, weather as wx, zone
from cordon.plans import archive, fused, store
from cordon.plans.report import report_json, report_rows, report_values
from cordon.sources import adapter, catalog
from cordon.sources import trips as trips_source
from cordon.sources import weather as weather_source
from cordon.sources import zones as zones_source


_LOG = logging.getLogger(__name__)


def _materialise() -> bool:
    return os.environ.get("CORDON_MATERIALISE", "1") != "0"


def _stored(spark, sf, opener):
    """A materialised table, or None when it cannot be written (lazy plan then)."""
    if not _materialise():
        return None
    if not store.writable(spark):
        _LOG.warning("the store %s can't be written, deriving lazily", store.store_root(spark))
        return None
    return opener(spark, sf)  # any other failure is raised, not hidden behind a raw scan


def _flagged(spark, sf):
    """Flagged trips: the materialised table, or the lazy derivation."""
    table = _stored(spark, sf, store.flagged_table)
    return table if table is not None else fl.flag(adapter.trips(spark, sf))


def _unified(spark, sf):
    table = _stored(spark, sf, store.flagged_table)
    return store.unflagged(table) if table is not None else adapter.trips(spark, sf)


def ghost_flags(spark, sf):
    return _flagged(spark, sf).drop(*store.PARTITION_COLUMNS)


def _clean(spark, sf):
    return fl.clean(_flagged(spark, sf))


def _daily(spark, sf):
    return profile.daily_trips(_clean(spark, sf), params.ANALYSIS_YEAR)


def _weather(spark, sf):
    return adapter.weather(spark, sf, params.ANALYSIS_YEAR)


def unified_trips_by_type(spark, sf):
    return (_unified(spark, sf).groupBy("taxi_type")
            .agg(F.count(F.lit(1)).alias("trip_count"),
                 F.count("vendor_id").alias("vendor_rows"),
                 F.min("pickup_time").alias("first_pickup"),
                 F.max("pickup_time").alias("last_pickup"),
                 F.count_if(F.col("tip_amount") == 0).alias("zero_tip_trips")))


def border_effect_map(spark, sf):
    border = profile.border_effect(_clean(spark, sf))
    border = profile.with_coordinates(border)
    border = profile.with_zone_names(border, params.ZONE_NAMES)
    return profile.border_markers(border)


def _pages(spark, sf):
    return adapter.read_table(spark, sf, "pages")


def _listing(spark, sf):
    """Pages with a listing of trip files behind their own anchors."""
    return adapter.listing_pages(_pages(spark, sf))


def _trip_links(spark, sf):
    return catalog.parse_links(catalog.harvest_links(_listing(spark, sf), trip_files_only=True))


def months_to_fetch(spark, sf):
    return catalog.months_to_fetch(_trip_links(spark, sf), archive.local(spark, sf), params.ANALYSIS_YEAR)


def fetch_plan(spark, sf):
    """Listed files of the analysis and comparison years and those imputed from that are not at hand."""
    return catalog.fetch_plan(_trip_links(spark, sf), archive.local(spark, sf), [params.ANALYSIS_YEAR, params.COMPARISON_YEAR], params.IMPUTE_YEARS)


def _gate(spark, sf):
    return catalog.imputation_gate(_trip_links(spark, sf), [2023, 2024, 2025])


def december_where_missing(spark, sf):
    return impute.impute_where_missing(_unified(spark, sf), _gate(spark, sf), [2024, 2025])


def _cordon_roster(spark, sf):
    """The cordon's zones that a lookup (from ``supplier``) names, from the zone dimension."""
    lookup = adapter.lookup_from_supplier(adapter.read_table(spark, sf, "supplier"))
    return zones_source.zones(spark, lookup).filter("roster = 'congestion' AND zone_name IS NOT NULL").select("zone_id")


def roster_entries(spark, sf):
    """Entries into the named zones, by pickup zone, through semi and null-aware anti joins."""
    return (zone.zone_entries_by_roster(_clean(spark, sf), _cordon_roster(spark, sf)).groupBy("pickup_loc")
            .agg(F.count(F.lit(1)).alias("trip_count"), F.count_if(F.col("congestion_surcharge") > 0).alias("paid")))


def roster_directions(spark, sf):
    """Trips since the start by direction relative to the named zones, through existence joins."""
    trips = scope(_clean(spark, sf), min_year=int(params.CONGESTION_START[:4])).filter(since("pickup_time", params.CONGESTION_START))
    return (zone.direction_by_roster(trips, _cordon_roster(spark, sf)).groupBy("trip_type")
            .agg(F.count(F.lit(1)).alias("trip_count"), F.avg("total_amount").alias("avg_total")))


def missing_months(spark, sf):
    expected = catalog.expected_catalog(spark, [params.ANALYSIS_YEAR])
    return catalog.missing_from_expected(expected, _trip_links(spark, sf))


def _raw_unified(spark, sf):
    """Trips through the raw yellow and green layouts and their union."""
    lineitem = adapter.read_table(spark, sf, "lineitem")
    return trips_source.unify(*[trips_source.to_unified(adapter.raw_frame(lineitem, t), t) for t in params.TAXI_TYPES])


def raw_trips_by_zone(spark, sf):
    return (_raw_unified(spark, sf).groupBy("taxi_type", "pickup_loc")
            .agg(F.count(F.lit(1)).alias("trip_count"), F.count("vendor_id").alias("vendor_rows"),
                 F.count_if(F.col("tip_amount") == 0).alias("zero_tip_trips"),
                 F.min("pickup_time").alias("first_pickup"), F.max("dropoff_time").alias("last_dropoff")))


def weather_documents(spark, sf):
    documents = adapter.weather_documents(adapter.read_table(spark, sf, "orders"))
    return weather_source.parse_response(documents)


def border_effect_lookup(spark, sf):
    """Border effect named and placed by tables (a lookup and a coordinate table from ``supplier``)."""
    supplier = adapter.read_table(spark, sf, "supplier")
    border = profile.with_coordinates(profile.border_effect(_clean(spark, sf)), adapter.coordinates_from_supplier(supplier))
    return profile.border_markers(profile.with_zone_names(border, adapter.lookup_from_supplier(supplier)))


def _base(spark, sf):
    table = _stored(spark, sf, store.base_table)
    return table if table is not None else fused.base_aggregate(fl.clean(_flagged(spark, sf)))


def daily_trips_stream(spark, sf):
    """Clean trips per day from a stream over ``lineitem`` (all days)."""
    from cordon.streaming import stream
    return stream.run_daily_counts(spark, stream.lineitem_stream(spark, sf), store.store_root(spark))


def _sections(spark, sf):
    """Trips are scanned once (vendors); everything else folds the base."""
    base = _base(spark, sf)
    return {
        "total_surcharge_revenue": fused.surcharge_revenue(base),
        "rain_elasticity": wx.rain_elasticity(_weather(spark, sf), fused.daily_trips(base)),
        "suspicious_vendors": fl.suspicious_vendors(_flagged(spark, sf)),
        "compliance_rate": fused.surcharge_compliance(base),
        "missing_surcharge_locations": fused.missing_surcharge_locations(base),
    }


def report(spark, sf):
    return report_rows(_sections(spark, sf))


def report_document_values(spark, sf):
    """The report's JSON documents, read back: every value with its JSON type."""
    return report_values(report_json(_sections(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources and unify
    "unified_trips_by_type": unified_trips_by_type,
    "raw_trips_by_zone": raw_trips_by_zone,
    "directory_trips": archive.directory_trips,
    "file_check": archive.file_check,
    "file_columns": archive.file_columns,
    "weather_cache": archive.weather_cache,
    "lookup_round_trip": archive.lookup_round_trip,
    "published_round_trip": lambda s, sf: archive.published_round_trip(s, _daily(s, sf), sf),
    "weather_documents": weather_documents,
    # flag
    "ghost_flags": ghost_flags,
    "trip_counts": lambda s, sf: fl.trip_counts(_flagged(s, sf)),
    "ghost_summary": lambda s, sf: fl.ghost_summary(_flagged(s, sf)),
    "ghost_stats": lambda s, sf: fl.ghost_stats(_flagged(s, sf)),
    "suspicious_vendors": lambda s, sf: fl.suspicious_vendors(_flagged(s, sf)),
    "ghost_audit": lambda s, sf: archive.ghost_audit(s, _flagged(s, sf).drop(*store.PARTITION_COLUMNS), sf),
    # zone
    "roster_entries": roster_entries,
    "roster_directions": roster_directions,
    "surcharge_compliance": lambda s, sf: zone.surcharge_compliance(_clean(s, sf)),
    "missing_surcharge_locations": lambda s, sf: zone.missing_surcharge_locations(_clean(s, sf)),
    "quarterly_volumes": lambda s, sf: zone.quarterly_volumes(_clean(s, sf)),
    "zone_direction_summary": lambda s, sf: zone.zone_direction_summary(_clean(s, sf)),
    "surcharge_revenue": lambda s, sf: zone.surcharge_revenue(_clean(s, sf)),
    # profiles
    "hourly_speeds_q1_2024": lambda s, sf: profile.hourly_speeds(_clean(s, sf), 2024, 1),
    "hourly_speeds_q1_2025": lambda s, sf: profile.hourly_speeds(_clean(s, sf), 2025, 1),
    "daily_trips": _daily,
    "monthly_tips": lambda s, sf: profile.monthly_tips(_clean(s, sf), params.ANALYSIS_YEAR),
    "border_dropoffs": lambda s, sf: profile.border_dropoffs(_clean(s, sf)),
    "border_effect": border_effect_map,
    "border_effect_lookup": border_effect_lookup,
    # imputation (over unified, not clean, trips)
    "imputation_profile": lambda s, sf: impute.imputation_profile(_unified(s, sf), "yellow", 12),
    "december_profile_2024": lambda s, sf: impute.month_profile(_unified(s, sf), 2024, 12),
    "december_imputed": lambda s, sf: impute.impute_month(_unified(s, sf)),
    "december_imputed_join": lambda s, sf: impute.impute_month_by_join(_unified(s, sf)),
    # weather
    "wettest_month": lambda s, sf: wx.wettest_month(_weather(s, sf)),
    "weather_trips": lambda s, sf: wx.weather_trips(_weather(s, sf), _daily(s, sf)),
    "wettest_month_trips": lambda s, sf: wx.wettest_month_trips(_weather(s, sf), _daily(s, sf)),
    "rain_elasticity": lambda s, sf: wx.rain_elasticity(_weather(s, sf), _daily(s, sf),
                                                        with_p_value=False),
    "rain_elasticity_p": lambda s, sf: wx.rain_elasticity(_weather(s, sf), _daily(s, sf)),
    # page figures
    "velocity_pivot": lambda s, sf: summary.velocity_pivot(profile.hourly_speeds(_clean(s, sf), 2025, 1)),
    "velocity_change": lambda s, sf: summary.velocity_change(_clean(s, sf)),
    "tip_change": lambda s, sf: summary.tip_change(profile.monthly_tips(_clean(s, sf), params.ANALYSIS_YEAR)),
    "border_summary": lambda s, sf: summary.border_summary(border_effect_map(s, sf)),
    # file catalog over stored pages
    "link_harvest": lambda s, sf: catalog.harvest_links(_pages(s, sf), trip_files_only=False),
    "trip_links": _trip_links,
    "month_coverage": lambda s, sf: catalog.available_months(_trip_links(s, sf)),
    "missing_months": missing_months,
    "months_to_fetch": months_to_fetch,
    "local_months": lambda s, sf: catalog.available_months(archive.local(s, sf)),
    "local_files": archive.local_files,
    "fetch_plan": fetch_plan,
    "imputation_gate": _gate,
    "december_where_missing": december_where_missing,
    "needs_imputation": lambda s, sf: catalog.needs_imputation(missing_months(s, sf)),
    # streaming: same classifier, event-time daily windows
    "daily_trips_stream": daily_trips_stream,
    # report
    "report_rows": report,
    "report_document_values": report_document_values,
    # the same profiles folded from the fused base aggregate (one clean-trip scan)
    "surcharge_compliance_fused": lambda s, sf: fused.surcharge_compliance(_base(s, sf)),
    "missing_surcharge_locations_fused": lambda s, sf: fused.missing_surcharge_locations(_base(s, sf)),
    "quarterly_volumes_fused": lambda s, sf: fused.quarterly_volumes(_base(s, sf)),
    "zone_direction_summary_fused": lambda s, sf: fused.zone_direction_summary(_base(s, sf)),
    "surcharge_revenue_fused": lambda s, sf: fused.surcharge_revenue(_base(s, sf)),
    "hourly_speeds_q1_2025_fused": lambda s, sf: fused.hourly_speeds(_base(s, sf), 2025, 1),
    "daily_trips_fused": lambda s, sf: fused.daily_trips(_base(s, sf)),
    "monthly_tips_fused": lambda s, sf: fused.monthly_tips(_base(s, sf)),
    "velocity_change_fused": lambda s, sf: summary.cells_change(
        fused.velocity_cells(_base(s, sf), [2024, 2025]), 2024, 2025),
    "border_effect_fused": lambda s, sf: profile.border_markers(profile.with_zone_names(
        profile.with_coordinates(fused.border_effect(_base(s, sf))),
        params.ZONE_NAMES)),
}
