"""End to end over raw monthly files, batch and streaming.

Raw yellow/green monthly files are written from the sf0.001 adapter rows, so
the file-based run must reproduce the registered queries exactly.
"""

import glob
import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E
from conftest import SF001
from cordon.operators import flag as fl
from cordon.plans.run import run
from cordon.sources import adapter
from cordon.streaming import stream


@pytest.fixture(scope="module")
def raw_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raw_trips")
    raw = adapter.raw_trips_from_lineitem(adapter.read_table(spark, SF001, "lineitem"))
    pdf = raw.toPandas()  # 6,000 rows: test fixture only
    for (taxi_type, year, month), part in pdf.groupby(
            [pdf.taxi_type, pdf.pickup_datetime.dt.year, pdf.pickup_datetime.dt.month]):
        prefix = "tpep" if taxi_type == "yellow" else "lpep"
        table = pa.table({
            "VendorID": pa.array(part.VendorID, pa.int32() if month % 2 else pa.int64()),
            f"{prefix}_pickup_datetime": pa.array(part.pickup_datetime, pa.timestamp("us")),
            f"{prefix}_dropoff_datetime": pa.array(part.dropoff_datetime, pa.timestamp("us")),
            "trip_distance": pa.array(part.trip_distance, pa.float64()),
            "PULocationID": pa.array(part.PULocationID, pa.int64()),
            "DOLocationID": pa.array(part.DOLocationID, pa.int64()),
            "fare_amount": pa.array(part.fare_amount, pa.float64()),
            "tip_amount": pa.array(part.tip_amount, pa.float64()),
            "total_amount": pa.array(part.total_amount, pa.float64()),
            "congestion_surcharge": pa.array(part.congestion_surcharge, pa.float64()),
        })
        pq.write_table(table, d / f"{taxi_type}_tripdata_{year}-{month:02d}.parquet")
    return str(d)


def _same(a, b):
    import diffcheck
    ok, msg = diffcheck.compare([tuple(r) for r in a.collect()], a.columns,
                                [tuple(r) for r in b.collect()], b.columns)
    return ok or msg


@pytest.mark.parametrize("fused", [True, False])
def test_full_run_matches_registered_queries(spark, raw_dir, tmp_path, fused):
    weather = adapter.weather(spark, SF001)
    paths = run(spark, raw_dir, str(tmp_path / "out"), weather=weather, fused=fused)
    flagged = spark.read.parquet(paths["flagged"])
    assert flagged.count() == 6000
    assert spark.read.parquet(paths["ghost_audit"]).count() == \
        flagged.filter(F.col("ghost_type").isNotNull()).count()
    q = E.queries()
    for out_name, query in [("compliance", "surcharge_compliance"),
                            ("border_effect", "border_effect"),
                            ("daily_trips_2025", "daily_trips"),
                            ("suspicious_vendors", "suspicious_vendors"),
                            ("velocity_q1_2024", "hourly_speeds_q1_2024")]:
        expected = q[query](spark, SF001)
        got = spark.read.option("header", True).schema(expected.schema).csv(paths[out_name])
        assert _same(got, expected) is True, out_name
    assert len(glob.glob(os.path.join(paths["report"], "*.json"))) == 1
    import json
    doc = json.loads(spark.read.text(paths["report_document"]).collect()[0].value)
    assert set(doc) - {"generated_at"} == {"total_surcharge_revenue", "suspicious_vendors",
                                           "compliance_rate", "missing_surcharge_locations",
                                           "rain_elasticity", "skipped_files"}
    assert isinstance(doc["rain_elasticity"]["p_value"], float)
    sections = {r.section for r in spark.read.json(paths["report"]).collect()}
    assert sections == {"total_surcharge_revenue", "suspicious_vendors", "compliance_rate",
                        "missing_surcharge_locations", "rain_elasticity", "skipped_files"}


def _batch_days(spark):
    clean = fl.clean(fl.flag(adapter.trips(spark, SF001)))
    return (clean.groupBy(F.to_date("pickup_time").alias("date"))
            .agg(F.count(F.lit(1)).alias("trip_count"), F.sum("total_amount").alias("total_revenue"),
                 F.avg("congestion_surcharge").alias("avg_surcharge")))


def test_stream_matches_batch(spark, raw_dir, tmp_path):
    out = str(tmp_path / "daily")
    stream.start_daily_counts(spark, raw_dir, out, checkpoint=str(tmp_path / "ck")).awaitTermination(300)
    assert _same(stream.read_daily_counts(spark, out), _batch_days(spark)) is True


@pytest.mark.parametrize("order", ["oldest", "newest"])
@pytest.mark.parametrize("stray", [False, True])
def test_stream_loses_no_trip(spark, tmp_path, order, stray):
    """48 monthly files of 3 trips, in either order, with or without a pickup dated 2098: 144 of 144."""
    import datetime as dt
    import time
    d = tmp_path / "months"
    d.mkdir()
    months = [(y, m) for y in (2022, 2023, 2024, 2025) for m in range(1, 13)]
    now = time.time() - 10_000
    for k, (y, m) in enumerate(months if order == "oldest" else months[::-1]):
        days = [dt.datetime(y, m, day, 10) for day in (1, 10, 20)]
        if stray and k == 5:
            days[1] = dt.datetime(2098, 1, 1, 10)
        table = pa.table({"VendorID": pa.array([1] * 3, pa.int64()), "tpep_pickup_datetime": pa.array(days, pa.timestamp("us")),
                          "tpep_dropoff_datetime": pa.array([x + dt.timedelta(minutes=20) for x in days], pa.timestamp("us")),
                          "trip_distance": [2.0] * 3, "PULocationID": pa.array([1] * 3, pa.int64()), "DOLocationID": pa.array([2] * 3, pa.int64()),
                          "fare_amount": [9.0] * 3, "tip_amount": [1.0] * 3, "total_amount": [10.0] * 3, "congestion_surcharge": [2.5] * 3})
        path = d / f"yellow_tripdata_{y}-{m:02d}.parquet"
        pq.write_table(table, path)
        os.utime(path, (now + k, now + k))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream.start_daily_counts(spark, str(d), out, checkpoint=ck).awaitTermination(300)
    assert stream.read_daily_counts(spark, out).agg(F.sum("trip_count")).first()[0] == 144
    stream.start_daily_counts(spark, str(d), out, checkpoint=ck).awaitTermination(300)  # nothing new: nothing twice
    assert stream.read_daily_counts(spark, out).agg(F.sum("trip_count")).first()[0] == 144


def test_report_document_shape(spark):
    import json

    from cordon.plans.report import report_document, report_json, report_rows
    vendors = spark.createDataFrame([(2, 10, 5.5), (1, 3, None)],
                                    "vendor_id int, ghost_trip_count bigint, total_suspicious_fare double")
    empty = spark.createDataFrame([], "pickup_loc int, missing_rate double")
    elasticity = spark.createDataFrame([(0.15, 'inelastic "x"')], "correlation double, interpretation string")
    sections = {"suspicious_vendors": vendors, "missing_surcharge_locations": empty, "rain_elasticity": elasticity}
    doc = json.loads(report_document(report_json(sections)).collect()[0].json)
    assert set(doc) == {"generated_at", "suspicious_vendors", "missing_surcharge_locations",
                        "rain_elasticity"}
    assert doc["suspicious_vendors"] == {"vendor_id": {"0": 2, "1": 1}, "ghost_trip_count": {"0": 10, "1": 3},
                                         "total_suspicious_fare": {"0": 5.5, "1": None}}
    assert doc["missing_surcharge_locations"] == {"missing_rate": {}, "pickup_loc": {}}
    assert doc["rain_elasticity"] == {"correlation": 0.15, "interpretation": 'inelastic "x"'}
    rows = {(r.section, r.row, r.metric): (r.number, r.text) for r in report_rows(sections).collect()}
    assert rows["suspicious_vendors", 0, "vendor_id"] == (2.0, None)
    assert rows["rain_elasticity", 0, "interpretation"] == (None, 'inelastic "x"')
    assert ("missing_surcharge_locations", None, "pickup_loc") in rows


def test_cli(spark, raw_dir, tmp_path, capsys):
    import json

    from cordon.plans.run import main
    main([raw_dir, str(tmp_path / "cli"), "--direct", "--year", "2025"])
    paths = json.loads(capsys.readouterr().out)
    for name in ("velocity_pivot_q1_2025", "tip_change", "border_summary", "report_document"):
        assert os.path.isdir(paths[name]), name
    pivot = spark.read.option("header", True).csv(paths["velocity_pivot_q1_2025"])
    assert pivot.columns == ["day_of_week"] + [str(h) for h in range(24)]


def _copy(raw_dir, to):
    import shutil
    shutil.copytree(raw_dir, to)
    return to


def test_run_reports_files_without_pickup_and_reads_missing_columns_as_null(spark, raw_dir, tmp_path):
    import json
    d = _copy(raw_dir, tmp_path / "mixed")
    bad = pa.table({"VendorID": pa.array([1, 2], pa.int64()), "trip_distance": pa.array([1.0, 1.0])})  # no time columns
    pq.write_table(bad, d / "yellow_tripdata_2030-01.parquet")
    pq.write_table(bad, d / "fhv_tripdata_2030-01.parquet")
    name = d / "yellow_tripdata_2025-03.parquet"
    some = pq.read_table(name)
    pq.write_table(some.drop_columns(["congestion_surcharge"]), name)
    paths = run(spark, str(d), str(tmp_path / "out"), fused=False)
    flagged = spark.read.parquet(paths["flagged"])
    assert flagged.count() == 6000
    march = flagged.where("taxi_type = 'yellow' AND year(pickup_time) = 2025 AND month(pickup_time) = 3")
    assert march.count() == some.num_rows and march.where("congestion_surcharge <> 0").count() == 0
    check = {os.path.basename(r.path): (r.ok, r.n_rows) for r in spark.read.parquet(paths["file_check"]).collect()}
    assert check["yellow_tripdata_2030-01.parquet"] == (False, 2) and check["yellow_tripdata_2025-03.parquet"][0] is True
    assert check["fhv_tripdata_2030-01.parquet"][0] is False
    doc = json.loads(spark.read.text(paths["report_document"]).collect()[0].value)
    assert doc["skipped_files"] == {"files": {"0": 1}, "trips": {"0": 2}}


def test_run_stops_on_an_unreadable_footer(spark, raw_dir, tmp_path):
    d = _copy(raw_dir, tmp_path / "broken")
    (d / "yellow_tripdata_2030-01.parquet").write_bytes(b"not parquet")
    with pytest.raises(ValueError, match="2030-01"):
        run(spark, str(d), str(tmp_path / "out"))


def test_imputation_only_where_the_month_is_missing(spark, raw_dir, tmp_path):
    d = _copy(raw_dir, tmp_path / "gap")
    whole = run(spark, str(d), str(tmp_path / "a"), fused=False)
    assert "december_2025_imputed" not in whole
    os.remove(d / "green_tripdata_2025-12.parquet")
    gap = run(spark, str(d), str(tmp_path / "b"), fused=False)
    missing = [tuple(r) for r in spark.read.option("header", True).csv(gap["missing_months"]).select("year", "taxi_type", "month").collect()]
    assert missing == [("2025", "green", "12")]
    assert spark.read.option("header", True).csv(gap["available_months"]).where("year = 2025").count() == 23
    expected = E.queries()["december_imputed"](spark, SF001)
    got = spark.read.option("header", True).schema(expected.schema).csv(gap["december_2025_imputed"])
    assert _same(got, expected) is True


def test_arrow_addresses():
    from cordon.sources.trips import arrow_uri
    uri = arrow_uri()
    assert uri("s3a://b/k.parquet") == "s3://b/k.parquet" and uri("file:///x") == "file:///x"
    assert uri("dbfs:/a/b") == "file:///dbfs/a/b" and uri("hdfs://n/a") == "hdfs://n/a"
    assert uri("wasbs://c@a.blob.core.windows.net/k") == "abfss://c@a.dfs.core.windows.net/k"


def test_stream_over_folder_table(spark, tmp_path):
    import diffcheck
    d = tmp_path / "sf_folder"
    d.mkdir()
    adapter.read_table(spark, SF001, "lineitem").repartition(3).write.parquet(str(d / "lineitem.parquet"))
    got = E.queries()["daily_trips_stream"](spark, str(d))
    want = E.queries()["daily_trips_stream"](spark, SF001)
    assert got.count() > 0
    ok, msg = diffcheck.compare([tuple(r) for r in got.collect()], got.columns,
                                [tuple(r) for r in want.collect()], want.columns)
    assert ok, msg
