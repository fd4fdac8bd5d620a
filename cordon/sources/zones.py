"""Zone dimension, zone lookup file and border-zone coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon import params

ZONE_SCHEMA = T.StructType([
    T.StructField("zone_id", T.IntegerType(), False),
    T.StructField("roster", T.StringType(), False),
    T.StructField("zone_name", T.StringType(), True),
])

LOOKUP_SCHEMA = T.StructType([
    T.StructField("LocationID", T.IntegerType()),
    T.StructField("Borough", T.StringType()),
    T.StructField("Zone", T.StringType()),
    T.StructField("service_zone", T.StringType()),
])

ROSTERS = {
    "congestion": params.CONGESTION_ZONE_IDS,
    "border": params.BORDER_ZONE_IDS,
    "upper": params.UPPER_MANHATTAN_IDS,
    "island": params.ISLAND_IDS,
}


# Every zone of the borough: the cordon, its border, the north and the islands.
MANHATTAN_IDS = [zid for ids in ROSTERS.values() for zid in ids]


def zones(spark: SparkSession, lookup: DataFrame | None = None) -> DataFrame:
    """One row per (zone_id, roster), the all-Manhattan roster ``manhattan`` among them.

    Names come from `lookup` (LocationID, Zone), or are those of the border zones.
    """
    rosters = {**ROSTERS, "manhattan": MANHATTAN_IDS}
    rows = [(zid, roster, params.ZONE_NAMES.get(zid)) for roster, ids in rosters.items() for zid in ids]
    named = spark.createDataFrame(rows, ZONE_SCHEMA)
    if lookup is None:
        return named
    names = lookup.select(F.col("LocationID").alias("zone_id"), F.col("Zone").alias("zone_name"))
    return named.drop("zone_name").join(names, "zone_id", "left")


def roster_lookup(spark: SparkSession) -> DataFrame:
    """Lookup-shaped frame (LocationID, Zone) for the named border zones."""
    rows = [(zid, None, name, None) for zid, name in params.ZONE_NAMES.items()]
    return spark.createDataFrame(rows, LOOKUP_SCHEMA)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV; the text N/A reads as null."""
    return (spark.read.option("header", True).option("nullValue", "N/A")
            .schema(LOOKUP_SCHEMA).csv(path))


def coordinates(spark: SparkSession) -> DataFrame:
    """Border-zone map coordinates (zone_id, lat, lon)."""
    schema = T.StructType([
        T.StructField("zone_id", T.IntegerType(), False),
        T.StructField("lat", T.DoubleType(), False),
        T.StructField("lon", T.DoubleType(), False),
    ])
    rows = [(zid, lat, lon) for zid, (lat, lon) in params.BORDER_COORDS.items()]
    return spark.createDataFrame(rows, schema)
