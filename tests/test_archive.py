"""Files of the audit: layouts and folders of parts, footers, listing, cache, sink, CSV; joins with a roster; the imputation gate."""

import datetime as dt

import pytest
from conftest import SF001
from helpers import trips as trip_frame
from pyspark.sql import functions as F

import __spark_entry__ as E
from cordon import params
from cordon.operators import flag as fl
from cordon.operators import impute, zone
from cordon.plans import archive, store
from cordon.plans.report import report_json, report_values
from cordon.plans.run import write_small
from cordon.sources import adapter, catalog, published, trips, weather, zones


@pytest.fixture(scope="module")
def files(spark):
    return archive.trip_files(spark, SF001)


def test_files_cover_every_trip_once(spark, files):
    raw = adapter.raw_trips_from_lineitem(adapter.read_table(spark, SF001, "lineitem"))
    check = trips.validate_files(spark, files)
    assert check.agg(F.sum("n_rows")).first()[0] == raw.count()
    assert check.filter("NOT ok").count() == 4 and check.filter("error IS NOT NULL").count() == 0


def test_layouts_read_as_one_schema(spark, files):
    widths = {r.id_types for r in trips.validate_files(spark, files).collect()}
    assert len(widths) == 3
    got = trips.read_directory(spark, files)  # broken months read with null pickups
    assert got.schema == trips.UNIFIED_SCHEMA or [f.name for f in got.schema] == trips.UNIFIED_COLUMNS
    assert got.filter("pickup_time IS NULL").count() == trips.validate_files(spark, files).filter("NOT ok").agg(F.sum("n_rows")).first()[0]
    assert got.filter("congestion_surcharge IS NULL").count() == 0


def test_scan_opens_the_files_of_its_type_only(spark, files):
    n = {t: spark.read.schema(trips.raw_schema(t)).option("recursiveFileLookup", True).parquet(files).filter(
        F.col("_metadata.file_path").rlike(f"/{t}_tripdata_")).select("_metadata.file_path").distinct().count() for t in params.TAXI_TYPES}
    plan = trips.read_directory(spark, files)
    plan.collect()
    listed = catalog.local_catalog(spark, files).filter("matched").groupBy("taxi_type").count().collect()
    assert {r.taxi_type: r["count"] for r in listed} == n


def test_plain_files_and_folders_side_by_side(spark, tmp_path):
    rows = trip_frame(spark, [dict(pickup_time="2024-01-05 10:00:00", dropoff_time="2024-01-05 10:10:00")] * 3)
    raw = rows.select(F.col("vendor_id").alias("VendorID"), F.col("pickup_time").alias("tpep_pickup_datetime"), F.col("dropoff_time").alias("tpep_dropoff_datetime"))
    raw.repartition(2).write.parquet(str(tmp_path / "yellow_tripdata_2024-01.parquet"))
    raw.coalesce(1).write.parquet(str(tmp_path / "stage"))
    part = next((tmp_path / "stage").glob("part-*.parquet"))
    (tmp_path / "yellow_tripdata_2024-02.parquet").write_bytes(part.read_bytes())
    (tmp_path / "fhv_tripdata_2024-02.parquet").write_bytes(part.read_bytes())
    assert trips.read_directory(spark, str(tmp_path)).count() == 6
    months = {(r.taxi_type, r.year, r.month) for r in catalog.local_months(catalog.local_catalog(spark, str(tmp_path))).collect()}
    assert months == {("yellow", 2024, 1), ("yellow", 2024, 2)}
    assert catalog.local_catalog(spark, str(tmp_path)).filter("NOT matched").count() == 2  # the stray file and the staged part


def test_broken_months_are_fetched_again(spark, files):
    at_hand = {(r.taxi_type, r.year, r.month) for r in archive.local(spark, SF001).collect()}
    listed = {(r.taxi_type, r.year, r.month) for r in catalog.local_months(catalog.local_catalog(spark, files)).collect()}
    assert listed - at_hand == {(t, *ym) for t, months in archive.BROKEN.items() for ym in months}


def test_folder_is_made_once_per_version(spark, files):
    assert archive.trip_files(spark, SF001) == files
    store.refresh()
    assert archive.trip_files(spark, SF001) == files


def test_weather_cache_rewrites_one_year_and_prunes(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(dt.date(y, 1, d), float(y + d), 0.5) for y in (2023, 2024) for d in (1, 2)]
    df = spark.createDataFrame(rows, "date date, precipitation_mm double, rain_mm double")
    weather.save(df, path)
    before = sorted(p.name for p in (tmp_path / "w" / "year=2023").iterdir())
    weather.save(df.filter("year(date) = 2024").withColumn("precipitation_mm", F.lit(1.0)), path)
    assert sorted(p.name for p in (tmp_path / "w" / "year=2023").iterdir()) == before
    assert [r.precipitation_mm for r in weather.load(spark, path, 2024).collect()] == [1.0, 1.0]
    assert sorted(r.precipitation_mm for r in weather.load(spark, path, 2023).collect()) == [2024.0, 2025.0]
    plan = weather.load(spark, path, 2024)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_audit_sink_drops_classes_of_the_last_write(spark, tmp_path):
    rows = [("impossible_physics", 1.0), ("teleporter", 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "ghost_type string, fare double")
    path = fl.save_audit(df, str(tmp_path / "a"))
    assert {r.ghost_type for r in spark.read.parquet(path).collect()} == {"impossible_physics", "teleporter"}
    fl.save_audit(df.filter("ghost_type = 'teleporter'"), path)
    assert [(r.ghost_type, r.fare) for r in spark.read.parquet(path).collect()] == [("teleporter", 2.0)]


def test_csv_round_trips(spark, tmp_path):
    rows = [(1, "A, B", 'quo"ted', None), (2, None, "ü", "Yellow Zone"), (3, " spaced ", None, None)]
    df = spark.createDataFrame(rows, zones.LOOKUP_SCHEMA)
    got = zones.read_lookup(spark, write_small(df, str(tmp_path / "l"), null="N/A"))
    assert sorted(map(tuple, got.collect())) == rows
    daily = spark.createDataFrame([(dt.date(2025, 1, 1), 3, 0.1 + 0.2, 1e-300), (dt.date(2025, 1, 2), 2**53 + 1, 1e300, None)], published.SCHEMAS["daily_trips"])
    back = published.read(spark, "daily_trips", write_small(daily, str(tmp_path / "d")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, daily.collect()))


ZONES = [4, 12, 13]


def _located(spark):
    places = [None, 4, 12, 13, 99, 100]
    return trip_frame(spark, [dict(pickup_time="2025-02-01 10:00:00", dropoff_time="2025-02-01 10:10:00", pickup_loc=p, dropoff_loc=d) for p in places for d in places])


def test_roster_joins_equal_literal_lists(spark):
    t = _located(spark)
    roster = spark.createDataFrame([(z,) for z in ZONES + ZONES], "zone_id int")
    want = sorted(map(str, zone.zone_entries(t, ids=ZONES).collect()))
    assert sorted(map(str, zone.zone_entries_by_roster(t, roster).collect())) == want and want
    got = zone.direction_by_roster(t, roster)
    # The literal rule of the cordon, with these zones in its place.
    inside = lambda c: F.col(c).isin(ZONES)
    rule = (F.when(inside("pickup_loc") & inside("dropoff_loc"), "within_zone").when(~inside("pickup_loc") & inside("dropoff_loc"), "entering_zone")
            .when(inside("pickup_loc") & ~inside("dropoff_loc"), "exiting_zone").otherwise("outside_zone"))
    assert got.count() == t.count() and got.filter(F.col("trip_type") != rule).count() == 0


def test_null_ids_of_a_roster(spark):
    t = _located(spark)
    roster = spark.createDataFrame([(4,), (12,), (None,)], "zone_id int")
    assert zone.zone_entries_by_roster(t, roster).count() == 0  # NOT IN with a null is never true
    assert zone.direction_by_roster(t, roster).filter("trip_type = 'within_zone'").count() == 4
    empty = spark.createDataFrame([], "zone_id int")
    assert zone.zone_entries_by_roster(t, empty).count() == 0
    assert {r.trip_type for r in zone.direction_by_roster(t, empty).collect()} == {"outside_zone"}


def test_roster_plans_are_joins(spark):
    roster = spark.createDataFrame([(z,) for z in ZONES], "zone_id int")
    plan = zone.zone_entries_by_roster(_located(spark), roster)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan and "NestedLoop" not in plan


def test_gate_decides_whether_a_month_is_imputed(spark):
    have = [(t, y, 12) for y in (2023, 2024) for t in params.TAXI_TYPES] + [("yellow", 2025, 12), ("green", 2025, 11), ("green", None, 12), (None, 2025, 12)]
    available = spark.createDataFrame(have, "taxi_type string, year int, month int")
    gate = catalog.imputation_gate(available, [2024, 2025])
    assert sorted((r.year, r.missing_types, r.needs_imputation) for r in gate.collect()) == [(2024, [], False), (2025, ["green"], True)]
    t = trip_frame(spark, [dict(pickup_time=f"{y}-12-03 10:00:00", dropoff_time=f"{y}-12-03 10:10:00") for y in (2022, 2023, 2024, 2024)])
    filled = impute.impute_where_missing(t, gate, [2024, 2025]).collect()
    # 2023-12-03 is a Sunday, 2024-12-03 a Tuesday; 2024 is at hand and not imputed
    assert sorted((r.year, r.dow, round(r.imputed_count, 9)) for r in filled) == [(2025, 0, 0.3), (2025, 2, 1.4)]
    full = catalog.imputation_gate(available.unionByName(spark.createDataFrame([("green", 2025, 12)], available.schema)), [2024, 2025])
    assert impute.impute_where_missing(t, full, [2024, 2025]).count() == 0


def test_report_values_keep_json_types(spark):
    sections = {"rain_elasticity": spark.createDataFrame([(0.5, "elastic", None)], "slope double, interpretation string, p double"),
                "vendors": spark.createDataFrame([(1, "7", 2.0), (2, None, 1e300)], "vendor_id int, label string, total double"),
                "empty": spark.createDataFrame([], "a int, b string")}
    got = {(r.section, r.metric, r.row): (r.kind, r.number, r.text) for r in report_values(report_json(sections)).collect()}
    assert got[("rain_elasticity", "slope", None)] == ("number", 0.5, None)
    assert got[("rain_elasticity", "interpretation", None)] == ("text", None, "elastic")
    assert got[("rain_elasticity", "p", None)] == ("null", None, None)
    assert got[("vendors", "label", 0)] == ("text", None, "7") and got[("vendors", "label", 1)] == ("null", None, None)
    assert got[("vendors", "total", 1)] == ("number", 1e300, None) and got[("vendors", "vendor_id", 1)] == ("number", 2.0, None)
    assert got[("empty", "a", None)] == (None, None, None) and len(got) == 11


def test_registered(spark):
    for name in ("directory_trips", "file_check", "file_columns", "local_files", "fetch_plan", "imputation_gate", "december_where_missing", "roster_entries",
                 "roster_directions", "weather_cache", "lookup_round_trip", "published_round_trip", "ghost_audit", "report_document_values"):
        assert name in E.queries() and name in E.oracle_sql()


def test_files_are_written_from_few_scans_without_a_sort(spark, tmp_path, monkeypatch):
    """One pass over the trips for each type and layout, none for the broken months; rows stay in their order within a file."""
    at = [("2025-03-09 10:00:00", 0), ("2025-06-03 10:00:00", 1), ("2025-03-02 10:00:00", 2), ("2025-05-01 10:00:00", 3), ("2025-02-01 10:00:00", 4), (None, 5)]
    rows = trip_frame(spark, [dict(pickup_time=t, dropoff_time="2025-07-01 10:00:00", vendor_id=v, taxi_type=x) for x in params.TAXI_TYPES for t, v in at])
    raw = rows.select(F.col("pickup_time").alias("pickup_datetime"), F.col("dropoff_time").alias("dropoff_datetime"), F.col("vendor_id").alias("VendorID"), F.col("pickup_loc").alias("PULocationID"),
                      F.col("dropoff_loc").alias("DOLocationID"), "trip_distance", F.col("fare").alias("fare_amount"), "total_amount", "congestion_surcharge", "tip_amount", "taxi_type").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def passes(batches):
        seen.add(1)
        yield from batches

    settings = []
    real = store.unsorted_writes
    monkeypatch.setattr(store, "unsorted_writes", lambda s: (settings.append(1), real(s))[1], raising=False)
    archive.write_trip_files(raw.mapInPandas(passes, raw.schema), str(tmp_path / "f"))
    assert settings == [1] and seen.value <= len(params.TAXI_TYPES) * len(archive.LAYOUTS)
    found = {p.name for p in (tmp_path / "f").iterdir()}
    assert found == {f"{t}_tripdata_2025-{m}.parquet" for t in params.TAXI_TYPES for m in ("02", "03", "05", "06")}  # nothing is left beside them
    march = spark.read.parquet(str(tmp_path / "f" / "yellow_tripdata_2025-03.parquet")).collect()
    assert [r.VendorID for r in march] == [0, 2]
    check = {(r.taxi_type, r.path.split("/")[-2][-10:-8], r.ok, r.n_rows) for r in trips.validate_files(spark, str(tmp_path / "f")).collect()}
    assert check == {(t, m, (t, m) not in (("green", "05"), ("yellow", "02")), 2 if m == "03" else 1) for t in params.TAXI_TYPES for m in ("02", "03", "05", "06")}
    assert "tpep_pickup_datetime" not in spark.read.parquet(str(tmp_path / "f" / "yellow_tripdata_2025-02.parquet")).columns
