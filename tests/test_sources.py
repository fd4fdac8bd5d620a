"""Raw-file sources: mixed id widths, unmatched names, missing columns, side inputs."""

import datetime as dt
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cordon.sources import catalog, trips, weather as wsrc, zones


def _raw(prefix, id_type, n=3, drop=None, month=1):
    t0 = dt.datetime(2025, month, 2, 8, 0, 0)
    cols = {
        "VendorID": pa.array([1, 2, None][:n], id_type),
        f"{prefix}_pickup_datetime": pa.array([t0 + dt.timedelta(minutes=i) for i in range(n)],
                                             pa.timestamp("us")),
        f"{prefix}_dropoff_datetime": pa.array([t0 + dt.timedelta(minutes=i + 10) for i in range(n)],
                                              pa.timestamp("us")),
        "passenger_count": pa.array([1.0] * n),
        "trip_distance": pa.array([1.5, 0.0, 2.0][:n]),
        "PULocationID": pa.array([1, 4, 12][:n], id_type),
        "DOLocationID": pa.array([4, 12, 1][:n], id_type),
        "fare_amount": pa.array([10.0, 5.0, 12.0][:n]),
        "tip_amount": pa.array([1.0, None, 0.0][:n]),
        "total_amount": pa.array([14.0, 8.0, 15.0][:n]),
        "congestion_surcharge": pa.array([2.5, None, 0.0][:n]),
    }
    if drop:
        cols.pop(drop)
    return pa.table(cols)


def _write_dir(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    pq.write_table(_raw("tpep", pa.int32(), month=1), d / "yellow_tripdata_2025-01.parquet")
    pq.write_table(_raw("tpep", pa.int64(), month=2), d / "yellow_tripdata_2025-02.parquet")
    pq.write_table(_raw("lpep", pa.int64(), month=1), d / "green_tripdata_2025-01.parquet")
    pq.write_table(_raw("tpep", pa.int64()), d / "fhv_tripdata_2025-01.parquet")
    return str(d)


def test_read_directory_mixed_id_widths(spark, tmp_path):
    d = _write_dir(tmp_path)
    df = trips.read_directory(spark, d)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in trips.UNIFIED_SCHEMA]
    rows = df.collect()
    assert len(rows) == 9  # the fhv file is not read
    by_type = {}
    for r in rows:
        by_type[r.taxi_type] = by_type.get(r.taxi_type, 0) + 1
    assert by_type == {"yellow": 6, "green": 3}
    assert sorted({r.vendor_id for r in rows}, key=lambda v: (v is None, v)) == [1, 2, None]
    # surcharge and tip null -> 0, fare stays as read
    assert all(r.congestion_surcharge is not None and r.tip_amount is not None for r in rows)


def test_read_directory_one_type_absent(spark, tmp_path):
    d = tmp_path / "only_yellow"
    d.mkdir()
    pq.write_table(_raw("tpep", pa.int64()), d / "yellow_tripdata_2025-01.parquet")
    assert trips.read_directory(spark, str(d)).count() == 3


def test_validate_files(spark, tmp_path):
    d = _write_dir(tmp_path)
    pq.write_table(_raw("tpep", pa.int64(), drop="tpep_pickup_datetime"),
                   os.path.join(d, "yellow_tripdata_2025-03.parquet"))
    res = {os.path.basename(r.path): r for r in trips.validate_files(spark, d).collect()}
    assert res["yellow_tripdata_2025-01.parquet"].ok
    assert "VendorID:int32" in res["yellow_tripdata_2025-01.parquet"].id_types
    assert "VendorID:int64" in res["yellow_tripdata_2025-02.parquet"].id_types
    assert res["green_tripdata_2025-01.parquet"].ok
    assert not res["yellow_tripdata_2025-03.parquet"].ok
    assert res["yellow_tripdata_2025-03.parquet"].missing_columns == ["tpep_pickup_datetime"]
    assert res["fhv_tripdata_2025-01.parquet"].taxi_type is None
    assert not res["fhv_tripdata_2025-01.parquet"].ok


def test_local_catalog_reports_unmatched(spark, tmp_path):
    d = _write_dir(tmp_path)
    rows = {os.path.basename(r.path): r for r in catalog.local_catalog(spark, d).collect()}
    assert (rows["yellow_tripdata_2025-02.parquet"].taxi_type,
            rows["yellow_tripdata_2025-02.parquet"].year,
            rows["yellow_tripdata_2025-02.parquet"].month) == ("yellow", 2025, 2)
    assert rows["yellow_tripdata_2025-02.parquet"].size_mb > 0
    assert not rows["fhv_tripdata_2025-01.parquet"].matched
    avail = catalog.available_months(catalog.local_catalog(spark, d)).collect()
    assert {(r.year, r.taxi_type, tuple(r.months)) for r in avail} == {
        (2025, "yellow", (1, 2)), (2025, "green", (1,))}


def test_weather_json_and_cache(spark, tmp_path):
    doc = {"latitude": 40.78, "daily": {"time": ["2025-01-01", "2025-01-02", "2025-01-03"],
                                        "precipitation_sum": [1.1, 0.0, None],
                                        "rain_sum": [1.1, 0.0, 0.0]}}
    p = tmp_path / "weather_2025.json"
    p.write_text(json.dumps(doc, indent=2))
    w = wsrc.read_responses(spark, str(p))
    rows = w.orderBy("date").collect()
    assert [(r.date, r.precipitation_mm) for r in rows] == [
        (dt.date(2025, 1, 1), 1.1), (dt.date(2025, 1, 2), 0.0), (dt.date(2025, 1, 3), None)]
    cache = str(tmp_path / "cache")
    wsrc.save(w, cache)
    assert wsrc.load(spark, cache, 2025).count() == 3
    assert wsrc.load(spark, cache, 2024).count() == 0


def test_zone_lookup_na_is_null(spark, tmp_path):
    p = tmp_path / "lookup.csv"
    p.write_text('"LocationID","Borough","Zone","service_zone"\n'
                 '1,"EWR","Newark Airport","EWR"\n264,"Unknown","N/A","N/A"\n')
    rows = zones.read_lookup(spark, str(p)).collect()
    assert rows[1].Zone is None and rows[1].LocationID == 264


def test_zone_dimension(spark):
    z = zones.zones(spark)
    counts = {r.roster: r["count"] for r in z.groupBy("roster").count().collect()}
    assert counts == {"congestion": 41, "border": 9, "upper": 16, "island": 3, "manhattan": 69}
    assert z.filter(F.col("zone_name").isNotNull()).select("zone_id").distinct().count() == 9
    lookup = spark.createDataFrame([(4, "B", "Four", "s"), (142, "B", "Square", "s")], zones.LOOKUP_SCHEMA)
    named = {(r.zone_id, r.roster): r.zone_name for r in zones.zones(spark, lookup).collect()}
    assert len(named) == 138 and named[4, "manhattan"] == named[4, "congestion"] == "Four" and named[143, "border"] is None


def test_read_type_multi_path(spark, tmp_path):
    d = _write_dir(tmp_path)
    paths = [os.path.join(d, "yellow_tripdata_2025-01.parquet"),
             os.path.join(d, "yellow_tripdata_2025-02.parquet")]
    df = trips.read_type(spark, paths, "yellow")
    assert df.count() == 6 and {r.taxi_type for r in df.collect()} == {"yellow"}
    assert trips.read_type(spark, paths[0], "yellow").count() == 3


def test_published_reader_applies_schema(spark, tmp_path):
    from cordon.sources import published
    p = tmp_path / "daily.csv"
    p.write_text("date,trip_count,total_revenue,avg_surcharge\n2025-01-01,89553,2239738.1,1.76\n")
    df = published.read(spark, "daily_trips", str(p))
    r = df.collect()[0]
    assert r.date == dt.date(2025, 1, 1) and r.trip_count == 89553
    assert [f.dataType.simpleString() for f in df.schema] == ["date", "bigint", "double", "double"]


def test_month_weather_trips(spark):
    from cordon.operators import weather as wx
    w = spark.createDataFrame([(dt.date(2025, 5, 1), 3.0, 3.0), (dt.date(2025, 5, 2), None, 0.0),
                               (dt.date(2025, 6, 1), 9.0, 9.0)],
                              "date date, precipitation_mm double, rain_mm double")
    d = spark.createDataFrame([(dt.date(2025, 5, 1), 10), (dt.date(2025, 6, 1), 20),
                               (dt.date(2025, 5, 3), 30)], "date date, trip_count bigint")
    rows = wx.month_weather_trips(w, d, 5).collect()
    assert [(r.date, r.precipitation_mm, r.trip_count) for r in rows] == [(dt.date(2025, 5, 1), 3.0, 10)]
    assert [r.date for r in wx.wettest_month_trips(w, d).collect()] == [dt.date(2025, 6, 1)]


def test_describe_files(spark, tmp_path):
    d = _write_dir(tmp_path)
    rows = trips.describe_files(spark, d).collect()
    y1 = {r.column_name: r.column_type for r in rows if r.path.endswith("yellow_tripdata_2025-01.parquet")}
    assert y1["VendorID"] == "int32" and y1["tpep_pickup_datetime"] == "timestamp[us]"
    assert len({r.path for r in rows}) == 4


def test_wettest_month_from_joined_days(spark):
    from cordon.operators import weather as wx
    w = spark.createDataFrame([(dt.date(2025, 5, 1), 3.0, 3.0), (dt.date(2025, 6, 1), 9.0, 9.0)],
                              "date date, precipitation_mm double, rain_mm double")
    d = spark.createDataFrame([(dt.date(2025, 5, 1), 10)], "date date, trip_count bigint")
    assert wx.wettest_month_trips(w, d).count() == 0  # June is wettest but has no trips
    assert [r.date for r in wx.wettest_month_trips(w, d, from_joined=True).collect()] == [dt.date(2025, 5, 1)]
