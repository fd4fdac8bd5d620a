"""Raw monthly trip files -> one unified trip table.

Yellow and green files differ only in the prefix of their two timestamp
columns. Each type is read with one multi-file scan under an explicit schema
(ids declared BIGINT so INT32 and INT64 files read together), projected to the
unified 11 columns, and the types are combined with ``unionByName``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon import params

TIME_COLUMNS = {
    "yellow": ("tpep_pickup_datetime", "tpep_dropoff_datetime"),
    "green": ("lpep_pickup_datetime", "lpep_dropoff_datetime"),
}

UNIFIED_COLUMNS = [
    "pickup_time", "dropoff_time", "pickup_loc", "dropoff_loc", "trip_distance",
    "fare", "total_amount", "congestion_surcharge", "tip_amount", "taxi_type",
    "vendor_id",
]

UNIFIED_SCHEMA = T.StructType([
    T.StructField("pickup_time", T.TimestampNTZType()),
    T.StructField("dropoff_time", T.TimestampNTZType()),
    T.StructField("pickup_loc", T.IntegerType()),
    T.StructField("dropoff_loc", T.IntegerType()),
    T.StructField("trip_distance", T.DoubleType()),
    T.StructField("fare", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("congestion_surcharge", T.DoubleType()),
    T.StructField("tip_amount", T.DoubleType()),
    T.StructField("taxi_type", T.StringType()),
    T.StructField("vendor_id", T.IntegerType()),
])


def raw_schema(taxi_type: str) -> T.StructType:
    """The raw columns read from a file of `taxi_type` (only those used)."""
    pickup, dropoff = TIME_COLUMNS[taxi_type]
    return T.StructType([
        T.StructField("VendorID", T.LongType()),
        T.StructField(pickup, T.TimestampNTZType()),
        T.StructField(dropoff, T.TimestampNTZType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
    ])


def project_unified(raw: DataFrame, pickup: str, dropoff: str, taxi_type: Column) -> DataFrame:
    """Rename and cast raw columns to the unified schema.

    Surcharge and tip null -> 0; fare, distance, total and ids stay null.
    """
    return raw.select(
        F.col(pickup).cast("timestamp_ntz").alias("pickup_time"),
        F.col(dropoff).cast("timestamp_ntz").alias("dropoff_time"),
        F.col("PULocationID").cast("int").alias("pickup_loc"),
        F.col("DOLocationID").cast("int").alias("dropoff_loc"),
        F.col("trip_distance").cast("double").alias("trip_distance"),
        F.col("fare_amount").cast("double").alias("fare"),
        F.col("total_amount").cast("double").alias("total_amount"),
        F.coalesce(F.col("congestion_surcharge"), F.lit(0)).cast("double").alias("congestion_surcharge"),
        F.coalesce(F.col("tip_amount"), F.lit(0)).cast("double").alias("tip_amount"),
        taxi_type.cast("string").alias("taxi_type"),
        F.col("VendorID").cast("int").alias("vendor_id"),
    )


def to_unified(raw: DataFrame, taxi_type: str) -> DataFrame:
    """Project one taxi type's raw frame to the unified schema."""
    pickup, dropoff = TIME_COLUMNS[taxi_type]
    return project_unified(raw, pickup, dropoff, F.lit(taxi_type))


def unify(*frames: DataFrame) -> DataFrame:
    """UNION ALL of unified frames, by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_type(spark: SparkSession, paths, taxi_type: str) -> DataFrame:
    """One multi-file scan of raw files of one taxi type, unified."""
    if isinstance(paths, str):
        paths = [paths]
    raw = spark.read.schema(raw_schema(taxi_type)).parquet(*paths)
    return to_unified(raw, taxi_type)


def read_directory(spark: SparkSession, directory: str, without: DataFrame | None = None) -> DataFrame:
    """Unified trips from every `{yellow|green}_tripdata_*.parquet` in a directory.

    Such a name is a file, or a folder of part files. The type comes from the name, so a file named neither way is
    not read (it is reported by ``catalog.local_catalog`` instead); the name is tested on the listing, so files of the
    other type are not opened. Files whose ``path`` is in `without` are left out; a column that a file lacks reads as null.
    """
    frames = []
    for taxi_type in params.TAXI_TYPES:
        raw = spark.read.schema(raw_schema(taxi_type)).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(directory)
        path = F.col("_metadata.file_path")
        raw = raw.filter(path.rlike(rf"/{taxi_type}_tripdata_[^/]*\.parquet(/[^/]*)?$"))
        if without is not None:
            bad = without.select(_plain_path(F.col("path")).alias("_bad"))
            raw = raw.withColumn("_file", _plain_path(path)).join(bad, F.col("_file") == F.col("_bad"), "left_anti")
        frames.append(to_unified(raw, taxi_type))
    return unify(*frames)


def _plain_path(path: Column) -> Column:
    """A path in one spelling: ``file:/x`` and ``file:///x`` are the same."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def arrow_uri():
    """A function from a path that Spark lists to the address under which pyarrow opens it.

    A closure, so that a task that carries it doesn't need this package.
    """
    def uri(path: str) -> str:
        scheme, sep, rest = path.partition("://")
        if scheme in ("s3a", "s3n"):
            return "s3" + sep + rest
        if scheme in ("wasb", "wasbs"):
            return "abfss" + sep + rest.replace(".blob.", ".dfs.", 1)
        if path.startswith("dbfs:/"):
            return "file:///dbfs/" + path[len("dbfs:/"):].lstrip("/")
        return path

    return uri


def validate_files(spark: SparkSession, directory: str) -> DataFrame:
    """One row per Parquet file: type from its name, pickup column present, rows, error.

    ``ok`` asks for a known type and the pickup column only; other absent columns read as
    null and are listed. ``error`` tells why a footer could not be read (null if it could):
    such a file is not known to be bad, so ``run`` stops on it instead of leaving it out.
    File footers are opened inside tasks (pyarrow), so a catalog of thousands
    of files is checked in parallel.
    """
    from cordon.sources.catalog import list_files

    files = list_files(spark, directory, "*.parquet").select("path")
    out = T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("taxi_type", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("missing_columns", T.ArrayType(T.StringType())),
        T.StructField("id_types", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("error", T.StringType()),
    ])

    # Plain data only: the task function must not need this package on executors.
    expected = {t: [f.name for f in raw_schema(t).fields] for t in TIME_COLUMNS}
    pickup_of = {t: c[0] for t, c in TIME_COLUMNS.items()}
    unknown_type_expected = list(TIME_COLUMNS["yellow"])
    columns = out.fieldNames()
    to_arrow = arrow_uri()

    def check(batches):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                name = next((part for part in path.rsplit("/", 2)[:0:-1] if "_tripdata" in part), "")  # the file, or its folder
                taxi_type = ("yellow" if "yellow_tripdata" in name
                             else "green" if "green_tripdata" in name else None)
                want = expected[taxi_type] if taxi_type else unknown_type_expected
                try:
                    filesystem, inner = pafs.FileSystem.from_uri(to_arrow(path))
                    with filesystem.open_input_file(inner) as fh:
                        footer = pq.read_metadata(fh)
                    schema = footer.schema.to_arrow_schema()
                    cols = set(schema.names)
                    id_types = ",".join(
                        f"{c}:{schema.field(c).type}" for c in ("VendorID", "PULocationID", "DOLocationID")
                        if c in cols)
                    missing = [c for c in want if c not in cols]
                    rows.append((path, taxi_type, taxi_type is not None and pickup_of[taxi_type] in cols,
                                 missing, id_types, footer.num_rows, None))
                except Exception as exc:  # kept in the result; run() raises it
                    rows.append((path, taxi_type, False, [], None, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(check, out)


def describe_files(spark: SparkSession, directory: str, glob: str = "*.parquet") -> DataFrame:
    """Raw schema description: one row per (file, column) with the physical type.

    Footers are read inside tasks; the task function carries plain data only.
    """
    from cordon.sources.catalog import list_files

    files = list_files(spark, directory, glob).select("path")
    out = T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("column_type", T.StringType()),
    ])
    columns = out.fieldNames()
    to_arrow = arrow_uri()

    def describe(batches):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                filesystem, inner = pafs.FileSystem.from_uri(to_arrow(path))
                with filesystem.open_input_file(inner) as fh:
                    schema = pq.read_schema(fh)
                rows += [(path, i, f.name, str(f.type)) for i, f in enumerate(schema)]
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(describe, out)
