"""The row-local classifier and daily counts on a stream of trip files.

``flag`` has no state and no shuffle, so it runs unchanged on a streaming
DataFrame. Pickup times in this data can be stray by decades, so no watermark
on them may decide which trips count: a watermark would jump to the newest
stray pickup and every later file would be dropped as late. Daily counts are
therefore kept as additive partial sums, one folder per micro-batch, and
summed when read. No trip is dropped, whatever the order of the files; a
batch that is run again overwrites its own folder, so each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.operators.flag import clean, flag
from cordon.sources.trips import raw_schema, to_unified, unify


def read_stream(spark: SparkSession, directory: str, max_files: int = 16) -> DataFrame:
    """Unified trips from yellow and green files arriving in `directory`."""
    frames = []
    for taxi_type in ("yellow", "green"):
        raw = (spark.readStream.schema(raw_schema(taxi_type))
               .option("pathGlobFilter", f"{taxi_type}_tripdata_*.parquet")
               .option("maxFilesPerTrigger", max_files)
               .parquet(directory))
        frames.append(to_unified(raw, taxi_type))
    return unify(*frames)


def flagged_stream(spark: SparkSession, directory: str) -> DataFrame:
    return flag(read_stream(spark, directory))


def partial_daily(flagged: DataFrame) -> DataFrame:
    """Additive sums of clean trips per pickup day (one row per day; null days too)."""
    return (clean(flagged).groupBy(F.to_date("pickup_time").alias("date"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("sum_total"),
                 F.sum("congestion_surcharge").alias("sum_surcharge"),
                 F.count("congestion_surcharge").alias("n_surcharge")))


def read_daily_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """Trips per pickup day so far: the partial sums of all batches, summed."""
    return (spark.read.parquet(out_path).groupBy("date")
            .agg(F.sum("n").alias("trip_count"), F.sum("sum_total").alias("total_revenue"),
                 (F.sum("sum_surcharge") / F.sum("n_surcharge")).alias("avg_surcharge")))


def write_daily_counts(flagged: DataFrame, out_path: str, checkpoint: str,
                       available_now: bool = True):
    """Start writing partial daily sums of a flagged stream; returns the running query."""
    out = out_path.rstrip("/")

    def store(batch: DataFrame, batch_id: int) -> None:
        partial_daily(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = flagged.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def start_daily_counts(spark: SparkSession, directory: str, out_path: str,
                       checkpoint: str | None = None, available_now: bool = True):
    """Daily counts over the trip files of `directory`; read them with ``read_daily_counts``.

    The checkpoint defaults to a folder under the cluster's shared
    ``spark.checkpoint.dir``, so a restarted driver resumes exactly.
    """
    from cordon.session import checkpoint_dir

    if checkpoint is None:
        checkpoint = f"{checkpoint_dir(spark).rstrip('/')}/cordon-stream-daily"
    return write_daily_counts(flagged_stream(spark, directory), out_path, checkpoint, available_now)


def _is_directory(spark: SparkSession, path: str) -> bool:
    """Is `path` a folder of files (Spark's table layout) rather than one file?"""
    from cordon.sources.catalog import list_files
    first = list_files(spark, path).select("path").limit(1).collect()
    return bool(first) and not first[0].path.rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1])


def lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged trips from the benchmark ``lineitem`` table, read as a stream.

    A table stored as a folder is streamed as is; a single file is streamed
    from its parent folder through a file-name filter (file streams watch
    folders).
    """
    from cordon.sources.adapter import read_table, trips_from_lineitem

    path = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    schema = read_table(spark, sf_dir, "lineitem").schema
    reader = spark.readStream.schema(schema)
    if _is_directory(spark, path):
        raw = reader.parquet(path)
    else:
        raw = reader.option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir.rstrip("/"))
    return flag(trips_from_lineitem(raw))


def run_daily_counts(spark: SparkSession, flagged: DataFrame, root: str) -> DataFrame:
    """Daily counts over everything available now; the result is a table under `root` (a shared folder)."""
    import uuid

    base = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = write_daily_counts(flagged, f"{base}/daily", f"{base}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return read_daily_counts(spark, f"{base}/daily")
