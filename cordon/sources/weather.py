"""Daily weather series: archive JSON documents in, partitioned Parquet cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE_SCHEMA = T.StructType([
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
        T.StructField("rain_sum", T.ArrayType(T.DoubleType())),
    ])),
])


def parse_response(responses: DataFrame) -> DataFrame:
    """Parallel arrays daily.time / precipitation_sum / rain_sum -> one row per day."""
    day = F.explode(F.arrays_zip(
        F.col("daily.time").alias("time"),
        F.col("daily.precipitation_sum").alias("precipitation_sum"),
        F.col("daily.rain_sum").alias("rain_sum"),
    )).alias("d")
    return (responses.select(day)
            .select(F.to_date(F.col("d.time")).alias("date"),
                    F.col("d.precipitation_sum").alias("precipitation_mm"),
                    F.col("d.rain_sum").alias("rain_mm")))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Archive JSON documents (one per file, possibly multi-line) -> daily rows."""
    raw = spark.read.schema(RESPONSE_SCHEMA).option("multiLine", True).json(path)
    return parse_response(raw)


def save(weather: DataFrame, path: str) -> None:
    """Cache daily weather partitioned by year (overwrites those years only)."""
    (weather.withColumn("year", F.year("date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year").parquet(path))


def load(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Cached weather of one year (partition-pruned read)."""
    return (spark.read.parquet(path).filter(F.col("year") == year)
            .select("date", "precipitation_mm", "rain_mm"))
