"""Trip and weather inputs derived from the benchmark tables.

The benchmark ships TPC-H-like tables, not trip files. These adapters derive
trip-shaped rows from ``lineitem`` and a daily weather series from ``orders``
with one projection each, so every query's work grows with the tables. The
same derivations are written in SQL in ``__spark_entry__.oracle_sql``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.functions.timeexpr import in_range
from cordon.sources.trips import TIME_COLUMNS, project_unified

# Days that move 1998-01-01 to 2025-01-01.
DAY_SHIFT = 9862


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _zone(key, missing):
    """A zone id from a row's key: of all 265 for every third part, else of the last 41; null where `missing`."""
    place = key + F.col("l_linenumber")
    return F.when(~missing, F.when(F.col("l_partkey") % 3 == 0, 1 + place % 265).otherwise(225 + place % 41))


def raw_trips_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Raw-trip columns (type-neutral names) plus the taxi type, one projection.

    A third of the trips use all 265 zones, the others 225-265; some zones, fares, totals and vendors are null.
    """
    pickup = F.expr(
        f"l_shipdate + INTERVAL '{DAY_SHIFT}' DAY + "
        "((l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 104729) % 86400) "
        "* INTERVAL '1' SECOND")
    dur_s = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17
             + F.col("l_linenumber") * 13) % 3600 - 60
    price, quantity = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    return lineitem.select(
        pickup.alias("pickup_datetime"),
        (pickup + dur_s * F.expr("INTERVAL '1' SECOND")).alias("dropoff_datetime"),
        _zone(F.col("l_partkey") * 7, (quantity == 30) & (F.col("l_linenumber") == 3)).alias("PULocationID"),
        _zone(F.col("l_orderkey") * 11, (quantity == 31) & (F.col("l_linenumber") == 2)).alias("DOLocationID"),
        F.when(F.col("l_quantity") <= 2, F.lit(0.0))
         .otherwise(F.col("l_quantity") / 4).alias("trip_distance"),
        F.when(quantity != 32, price).alias("fare_amount"),
        F.when(quantity != 33, price * (1 + F.col("l_tax"))).alias("total_amount"),
        F.when(F.col("l_tax") == 0.08, F.lit(-2.5))
         .when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), F.lit(None).cast("double"))
         .when(F.col("l_returnflag") == "N", F.lit(0.0))
         .otherwise(F.lit(2.5)).alias("congestion_surcharge"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
         .otherwise(price * F.col("l_discount")).alias("tip_amount"),
        F.when(F.col("l_linestatus") == "O", F.lit("yellow"))
         .otherwise(F.lit("green")).alias("taxi_type"),
        F.when(quantity != 34, F.col("l_suppkey") % 7 + 1).alias("VendorID"),
    )


def trips_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Unified trips from ``lineitem`` (same projection as a raw-file read)."""
    raw = raw_trips_from_lineitem(lineitem)
    return project_unified(raw, "pickup_datetime", "dropoff_datetime", F.col("taxi_type"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_lineitem(read_table(spark, sf_dir, "lineitem"))


def weather_from_orders(orders: DataFrame, year: int = 2025) -> DataFrame:
    """Daily weather series (date, precipitation_mm, rain_mm) from ``orders``."""
    day = F.expr(f"CAST(o_orderdate + INTERVAL '{DAY_SHIFT}' DAY AS DATE)")
    shift = _dt.timedelta(days=DAY_SHIFT)
    # The year test is on the stored column so it reaches the Parquet scan.
    first = _dt.datetime(year, 1, 1) - shift
    last = _dt.datetime(year + 1, 1, 1) - shift
    return (orders
            .filter(in_range("o_orderdate", first, last))
            .select(day.alias("date"), "o_totalprice")
            .groupBy("date")
            .agg((F.avg("o_totalprice") / 10000).alias("precipitation_mm"),
                 (F.min("o_totalprice") / 10000).alias("rain_mm")))


def weather(spark: SparkSession, sf_dir: str, year: int = 2025) -> DataFrame:
    return weather_from_orders(read_table(spark, sf_dir, "orders"), year)


def raw_frame(lineitem: DataFrame, taxi_type: str) -> DataFrame:
    """The trips of one type under that type's own raw column names (as its monthly files have them)."""
    pickup, dropoff = TIME_COLUMNS[taxi_type]
    raw = raw_trips_from_lineitem(lineitem).filter(F.col("taxi_type") == taxi_type).drop("taxi_type")
    return raw.withColumnsRenamed({"pickup_datetime": pickup, "dropoff_datetime": dropoff})


def listing_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with an anchor to a trip file behind their own HTML.

    The file's type, year (2023-2025) and month follow from the page id; the green December 2025 is never listed.
    Odd ids write the address from the root, with single quotes and a decoy attribute. Most pages also hold a decoy that is
    no anchor (in a comment, a script, an attribute), or end in a tag whose quote stays open.
    """
    k = F.col("page_id")
    year, month = 2023 + F.floor(k / 24) % 3, F.floor(k / 2) % 12 + 1
    month = F.when((year == 2025) & (month == 12) & (k % 2 == 1), 11).otherwise(month)
    name = F.format_string("%s_tripdata_%d-%02d.parquet", F.when(k % 2 == 0, "yellow").otherwise("green"), year.cast("int"), month.cast("int"))
    anchor = F.when(k % 2 == 0, F.concat(F.lit('<a href="'), name, F.lit('">file</a>'))).otherwise(
        F.concat(F.lit("<a data-href='x' title='a > b' href='/trip-data/"), name, F.lit("'>file</a>")))
    decoys = ['<!-- <a href="yellow_tripdata_2030-01.parquet"> -->', '<script>s = "<a href=green_tripdata_2031-01.parquet>"</script>',
              """<img alt='<a href="yellow_tripdata_2032-01.parquet">'>""", "", ""]
    decoy = F.element_at(F.array(*[F.lit(d) for d in decoys]), (k % 5 + 1).cast("int"))
    tail = F.when(k % 5 == 4, F.lit('<a title="open href=yellow_tripdata_2033-01.parquet>')).otherwise(F.lit(""))
    return pages.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), decoy, anchor, tail).alias("html"))


def weather_documents(orders: DataFrame) -> DataFrame:
    """One archive response per calendar year of ``orders``: parallel arrays of day, precipitation and rain."""
    day = F.expr(f"CAST(o_orderdate + INTERVAL '{DAY_SHIFT}' DAY AS DATE)")
    daily = (orders.groupBy(day.alias("date")).agg((F.avg("o_totalprice") / 10000).alias("p"), (F.min("o_totalprice") / 10000).alias("r")))
    days = F.array_sort(F.collect_list(F.struct("date", "p", "r")))
    return (daily.groupBy(F.year("date").alias("y")).agg(days.alias("d"))  # at most 366 days each
            .select(F.struct(F.transform("d", lambda x: x["date"].cast("string")).alias("time"),
                             F.transform("d", lambda x: x["p"]).alias("precipitation_sum"),
                             F.transform("d", lambda x: x["r"]).alias("rain_sum")).alias("daily")))


def lookup_from_supplier(supplier: DataFrame) -> DataFrame:
    """A zone lookup (LocationID, Borough, Zone, service_zone): supplier k up to 41 names zone 266 - k, one in ten left out."""
    k = F.col("s_suppkey")
    return supplier.filter(k.between(1, 41) & (k % 10 != 0)).select(
        (266 - k).cast("int").alias("LocationID"), F.lit("Manhattan").alias("Borough"), F.col("s_name").alias("Zone"), F.lit("Yellow Zone").alias("service_zone"))


def coordinates_from_supplier(supplier: DataFrame) -> DataFrame:
    """Coordinates (zone_id, lat, lon) of zone 266 - k for each even supplier key k up to 41."""
    k = F.col("s_suppkey")
    return supplier.filter(k.between(1, 41) & (k % 2 == 0)).select(
        (266 - k).cast("int").alias("zone_id"), (F.lit(40.0) + k / 1000).alias("lat"), (F.lit(-74.0) + k / 1000).alias("lon"))
