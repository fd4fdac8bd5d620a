"""The files that an audit reads and writes, made from the given tables, and the queries that go through them.

Monthly trip files of both types come in four layouts, as the published ones have over the years (id widths, absent and
additional columns, a month without its pickup column); each month is a folder of part files that bears the file's
name, so a month of any size is written and read by many tasks. Everything lies in the store (``store.folder``), once
per version of the table it derives from.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon import params
from cordon.operators import flag as fl
from cordon.plans import store
from cordon.plans.run import write_small
from cordon.sources import adapter, catalog, published, trips, weather, zones

#: Months (year, month) of each type whose files lack the pickup column; of layout "old".
BROKEN = {"green": ((2024, 11), (2025, 5)), "yellow": ((2023, 8), (2025, 2))}
#: Layout of other months by month number modulo 3: types of the ids, columns left out, columns added.
LAYOUTS = {
    "narrow": (0, {"VendorID": "int", "PULocationID": "int", "DOLocationID": "int"}, (), ()),
    "wide": (1, {"VendorID": "bigint", "PULocationID": "bigint", "DOLocationID": "bigint"}, (), ("store_and_fwd_flag",)),
    "old": (2, {"VendorID": "int", "PULocationID": "bigint", "DOLocationID": "bigint"}, ("congestion_surcharge",), ()),
}


def _moved(spark: SparkSession, source: str, target: str, without=()) -> None:
    """Folders ``file=NAME`` of a partitioned write become ``target/NAME``, one rename a month and type; what is left goes."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(source)):
        key, _, name = status.getPath().getName().partition("=")
        if key == "file" and name not in without and not fs.rename(status.getPath(), path(f"{target}/{name}")):
            raise OSError(f"can't rename {status.getPath().toString()}")
    fs.delete(path(source), True)


def write_trip_files(raw: DataFrame, directory: str) -> None:
    """Monthly files of raw trips (``adapter.raw_trips_from_lineitem``) under `directory`; trips without a pickup time have no month.

    A layout's trips are shuffled once, by month, and go to their month's file unsorted. The broken months, a few, are then
    written again from their own files, without the pickup column.
    """
    spark = raw.sparkSession
    year, month = F.year("pickup_datetime"), F.month("pickup_datetime")

    def write(taxi_type: str, layout: str) -> None:
        pickup, dropoff = trips.TIME_COLUMNS[taxi_type]
        rest, ids, without, added = LAYOUTS[layout]
        rows = raw.filter((F.col("taxi_type") == taxi_type) & (month % 3 == rest))
        columns: dict[str, Column] = {pickup: F.col("pickup_datetime").cast("timestamp_ntz"), dropoff: F.col("dropoff_datetime").cast("timestamp_ntz")}
        for f in trips.raw_schema(taxi_type).fields:
            if f.name not in columns and f.name not in without:
                columns[f.name] = F.col(f.name).cast(ids.get(f.name, f.dataType))
        dealt = rows.select(*[c.alias(n) for n, c in columns.items()], year.alias("year"), month.alias("month")).hint("rebalance", "year", "month")
        name = F.format_string(params.TRIP_FILE_FORMAT, F.lit(taxi_type), F.col("year"), F.col("month"))
        files = dealt.select(*columns, *[F.lit("N").alias(c) for c in added], name.alias("file"))
        part = f"{directory}/_{taxi_type}-{layout}"
        files.write.partitionBy("file").parquet(part)
        broken = [params.TRIP_FILE_FORMAT % (taxi_type, y, m) for y, m in BROKEN[taxi_type]] if layout == "old" else []
        if broken:
            again = spark.read.schema(files.schema).parquet(part).filter(F.col("file").isin(broken)).drop(pickup)
            again.write.partitionBy("file").parquet(f"{part}-broken")
            _moved(spark, f"{part}-broken", directory)
        _moved(spark, part, directory, broken)

    parts = [(t, layout) for layout in sorted(LAYOUTS, key=lambda x: x != "old") for t in params.TAXI_TYPES]
    with store.unsorted_writes(spark), ThreadPoolExecutor(4) as pool:  # small jobs beside each other
        list(pool.map(lambda part: write(*part), parts))


def trip_files(spark: SparkSession, sf: str) -> str:
    return store.folder(spark, sf, "files", lambda to: write_trip_files(adapter.raw_trips_from_lineitem(adapter.read_table(spark, sf, "lineitem")), to), "lineitem")


def _named(df: DataFrame) -> DataFrame:
    """``df`` (with ``path``) with the type, year and month that the file's name states."""
    taxi_type, year, month = catalog.parse_trip_path(F.col("path"))
    return df.drop("taxi_type").select(taxi_type.alias("taxi_type"), year.alias("year"), month.alias("month"), *[c for c in df.columns if c != "taxi_type"])


def directory_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Trips of all readable files by type and pickup month: ids of all widths, absent surcharges as 0, broken months left out."""
    files = trip_files(spark, sf)
    skipped = trips.validate_files(spark, files).filter("NOT ok")
    found = trips.read_directory(spark, files, skipped)
    return (found.groupBy("taxi_type", F.year("pickup_time").alias("year"), F.month("pickup_time").alias("month"))
            .agg(F.count(F.lit(1)).alias("trip_count"), F.sum(F.col("vendor_id").cast("bigint")).alias("vendor_sum"), F.count("pickup_loc").alias("zoned_trips"),
                 F.sum(F.col("dropoff_loc").cast("bigint")).alias("dropoff_sum"), F.count_if(F.col("congestion_surcharge") == 0).alias("without_surcharge"),
                 F.sum("fare").alias("total_fare"), F.max("dropoff_time").alias("last_dropoff")))


def file_check(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every month's footers: usable, columns that its layout lacks, types of the ids, rows."""
    check = _named(trips.validate_files(spark, trip_files(spark, sf)))
    return (check.groupBy("taxi_type", "year", "month")
            .agg(F.every("ok").alias("ok"), F.max(F.array_join("missing_columns", ",")).alias("missing_columns"), F.max("id_types").alias("id_types"),
                 F.sum("n_rows").alias("n_rows"), F.count("error").alias("unreadable")))


def file_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns, as stored, of every month's files."""
    return _named(trips.describe_files(spark, trip_files(spark, sf))).drop("path").distinct()


def local(spark: SparkSession, sf: str) -> DataFrame:
    """(taxi_type, year, month) of the usable files at hand: of those listed, the ones whose footers pass."""
    files = trip_files(spark, sf)
    bad = trips.validate_files(spark, files).filter("NOT ok").select("path")
    return catalog.local_months(catalog.local_catalog(spark, files).join(bad, "path", "left_anti"))


def local_files(spark: SparkSession, sf: str) -> DataFrame:
    """Months at hand with whether their files hold bytes, from the listing."""
    return (catalog.local_catalog(spark, trip_files(spark, sf)).filter("matched").groupBy("taxi_type", "year", "month")
            .agg((F.min("size_mb") > 0).alias("has_data")))


def weather_cache(spark: SparkSession, sf: str) -> DataFrame:
    """2024 and 2025 of a cache partitioned by year, after 2025 alone was written again with doubled precipitation."""
    def write(to):
        daily = weather.parse_response(adapter.weather_documents(adapter.read_table(spark, sf, "orders")))
        weather.save(daily, f"{to}/weather")
        again = daily.filter(F.year("date") == 2025).withColumn("precipitation_mm", F.col("precipitation_mm") * 2)
        weather.save(again, f"{to}/weather")

    path = f"{store.folder(spark, sf, 'weather', write, 'orders')}/weather"
    return weather.load(spark, path, 2024).unionByName(weather.load(spark, path, 2025))


def ghost_audit(spark: SparkSession, flagged: DataFrame, sf: str) -> DataFrame:
    """What the audit sink holds per class after a first write of all ghost trips and a second one without stationary trips."""
    def write(to):
        fl.save_audit(flagged, f"{to}/audit")
        _audit_counts(spark.read.parquet(f"{to}/audit"), 1).write.parquet(f"{to}/first")
        fl.save_audit(flagged.filter(F.col("ghost_type") != params.GHOST_STATIONARY), f"{to}/audit")

    to = store.folder(spark, sf, "audit", write, "lineitem")
    return spark.read.parquet(f"{to}/first").unionByName(_audit_counts(spark.read.parquet(f"{to}/audit"), 2))


def _audit_counts(audit: DataFrame, write: int) -> DataFrame:
    return audit.groupBy("ghost_type").agg(F.count(F.lit(1)).alias("trips"), F.sum("fare").alias("total_fare")).withColumn("written", F.lit(write))


def lookup_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A zone lookup written as CSV with N/A for nulls and read back."""
    def write(to):
        lookup = adapter.lookup_from_supplier(adapter.read_table(spark, sf, "supplier"))
        third = F.col("LocationID") % 3 == 0
        write_small(lookup.withColumn("Zone", F.when(~third, F.col("Zone"))).withColumn("service_zone", F.when(third, F.col("service_zone"))), f"{to}/lookup", null="N/A")

    return zones.read_lookup(spark, f"{store.folder(spark, sf, 'lookup', write, 'supplier')}/lookup")


def published_round_trip(spark: SparkSession, daily: DataFrame, sf: str) -> DataFrame:
    """Daily trips written as CSV and read back with their published types."""
    to = store.folder(spark, sf, "published", lambda folder: write_small(daily, f"{folder}/daily"), "lineitem")
    return published.read(spark, "daily_trips", f"{to}/daily")
