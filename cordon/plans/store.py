"""Flagged trips materialised once, partitioned by pickup year and month.

Every aggregate reads this table instead of re-deriving trips and flags from
the raw input, so the raw scan, the unify projection and the classifier run
once per input version. The table lives in the cluster's shared checkpoint
folder (``spark.checkpoint.dir``), keyed by the source files' paths, sizes and
modification times, and is reused only when its write committed (``_SUCCESS``).
Losing an executor mid-write just re-runs the write's tasks; a reader never
sees a half-written table.
"""

from __future__ import annotations

import hashlib
import threading
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cordon.operators.flag import flag
from cordon.session import checkpoint_dir
from cordon.sources import adapter
from cordon.sources.catalog import list_files

# Month directories prune month and quarter queries.
PARTITION_COLUMNS = ["pickup_year", "pickup_month"]
# Bump when the stored columns, the classifier or the layout change.
STORE_VERSION = "store-v9"
FLAG_COLUMNS = ["trip_duration_min", "avg_speed_mph", "ghost_type"]
# A task that writes a partitioned table keeps so many files open; with more partitions in
# one task, Spark sorts the rows that are left.
OPEN_FILES = 200
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def store_root(spark: SparkSession) -> str:
    """Folder of materialised tables: ``cordon.store.dir`` if set, else the
    shared checkpoint folder."""
    return (spark.conf.get("cordon.store.dir", None) or checkpoint_dir(spark)).rstrip("/")


def writable(spark: SparkSession) -> bool:
    """Can a folder be made in the store?"""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = spark._jvm.org.apache.hadoop.fs.Path(store_root(spark))
    try:
        return bool(root.getFileSystem(conf).mkdirs(root))
    except Py4JJavaError as e:
        if "AccessControl" in str(e) or "ermission denied" in str(e) or "Read-only" in str(e):
            return False
        raise


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(f"{path}/_SUCCESS")
        return True
    except AnalysisException:
        return False


def _fingerprint(spark: SparkSession, source: str) -> str:
    """Stable key of a source file set: count, paths, sizes and modification times.

    Listed by Spark through the source's own file system and reduced to one row there.
    """
    r = list_files(spark, source).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h"),
        F.max("modificationTime").alias("t")).collect()[0]
    text = f"{STORE_VERSION}|{','.join(PARTITION_COLUMNS)}|{r.n}:{r.h}:{r.t}"
    return hashlib.sha1(text.encode()).hexdigest()[:16]


# (session, source) -> (fingerprint, DataFrame): the file index is built once.
_OPENED: dict = {}
# One writer per process: concurrent queries wait for the first materialisation.
_LOCK = threading.RLock()


@contextmanager
def unsorted_writes(spark: SparkSession):
    """Partitioned writes in here append each row to its partition's open file.

    Otherwise Spark sorts every task's rows by partition first, which spills whole rows where
    a task holds more of them than its share of memory.
    """
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(OPEN_FILES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def with_partitions(trips: DataFrame) -> DataFrame:
    """Add the partition columns and deal the rows for the write.

    The rebalance brings a month's rows together; adaptive execution then splits a large
    month over many tasks and merges small ones, so neither one input split nor one month
    ends in a single task, and a month has few files. Nothing is sorted. Columns that follow
    from a row's others are better added behind this, so that they aren't shuffled.
    """
    return (trips.withColumns({"pickup_year": F.year("pickup_time"), "pickup_month": F.month("pickup_time")})
            .hint("rebalance", "pickup_year", "pickup_month"))


def write_flagged(flagged: DataFrame, path: str) -> None:
    """Write flagged trips partitioned by pickup year and month (replaces what is there)."""
    with unsorted_writes(flagged.sparkSession):
        (with_partitions(flagged).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy(*PARTITION_COLUMNS).parquet(path))


def _pointed(spark: SparkSession, pointer: str) -> str | None:
    """The committed table a pointer names, or None."""
    try:
        rows = spark.read.text(pointer).collect()  # one short line
    except AnalysisException:
        return None
    target = rows[0].value.strip() if rows else ""
    return target if target and _exists(spark, target) else None


def _target(spark: SparkSession, sf_dir: str, kind: str, write, table: str) -> tuple[str, str]:
    """Fingerprint and folder of `kind` derived from one table at `sf_dir`, made by ``write(folder)`` where there is none yet.

    Each writer writes its own folder and then points ``current`` at it;
    data folders are never overwritten, so a reader holding one never sees
    its files replaced, even when two processes materialise at once.
    """
    import uuid

    fp = _fingerprint(spark, f"{sf_dir.rstrip('/')}/{table}.parquet")
    base = f"{store_root(spark)}/cordon-{kind}-{fp}"
    target = _pointed(spark, f"{base}/current")
    if target is None:
        target = f"{base}/w-{uuid.uuid4().hex}"
        write(target)
        (spark.createDataFrame([(target,)], "value string").coalesce(1)
         .write.mode("overwrite").text(f"{base}/current"))
    return fp, target


def _materialised(spark: SparkSession, sf_dir: str, kind: str, build,
                  partition_by=()) -> DataFrame:
    """Open (writing first if needed) the `kind` table derived from `sf_dir`."""
    source = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    key = (spark.sparkContext.applicationId, store_root(spark), source, kind)

    def write(target):
        writer = build().write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with unsorted_writes(spark):
            writer.parquet(target)

    with _LOCK:
        opened = _OPENED.get(key)
        if opened is not None:
            return opened[1]
        fp, target = _target(spark, sf_dir, kind, write, "lineitem")
        df = spark.read.parquet(target)
        _OPENED[key] = (fp, df)
        return df


def folder(spark: SparkSession, sf_dir: str, kind: str, write, table: str) -> str:
    """A folder of files derived from one table, made by ``write(folder)`` once per source version."""
    key = (spark.sparkContext.applicationId, store_root(spark), f"{sf_dir.rstrip('/')}/{table}.parquet", kind)

    def whole(target):
        write(target)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(done, True).close()

    with _LOCK:
        if key not in _OPENED:
            _OPENED[key] = _target(spark, sf_dir, kind, whole, table)
        return _OPENED[key][1]


def refresh() -> None:
    """Look at the sources again at the next use (their listing is read once a session)."""
    with _LOCK:
        _OPENED.clear()


def clean_store(spark: SparkSession) -> list[str]:
    """Remove the store's tables that no open table of this process uses; returns their paths.

    For maintenance, when no other application uses the store.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(store_root(spark))
    fs = root.getFileSystem(conf)
    with _LOCK:
        used = {f"cordon-{key[3]}-{fp}" for key, (fp, _) in _OPENED.items() if key[1] == store_root(spark)}
        gone = []
        for s in fs.listStatus(root) if fs.exists(root) else []:
            name = s.getPath().getName()
            if name.startswith("cordon-") and name not in used:
                gone.append(s.getPath())
            elif name in used:
                current = _pointed(spark, f"{s.getPath().toString()}/current")
                gone += [w.getPath() for w in fs.listStatus(s.getPath())
                         if w.getPath().getName().startswith("w-") and w.getPath().getName() != (current or "").rsplit("/", 1)[-1]]
        for path in gone:
            fs.delete(path, True)
        return [path.toString() for path in gone]


def dealt_flagged(trips: DataFrame) -> DataFrame:
    """Flagged trips as the store holds them; the flags follow from a row, so only trips are shuffled."""
    return flag(with_partitions(trips))


def flagged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged trips derived from ``lineitem`` at `sf_dir`, materialised once."""
    return _materialised(spark, sf_dir, "flagged",
                         lambda: dealt_flagged(adapter.trips(spark, sf_dir)),
                         PARTITION_COLUMNS)


def unflagged(flagged: DataFrame) -> DataFrame:
    """The unified trip columns of a flagged table (partition columns kept)."""
    return flagged.drop(*FLAG_COLUMNS)


def base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused base aggregate of clean trips, materialised once beside the flagged table."""
    from cordon.operators.flag import clean
    from cordon.plans.fused import BASE_PARTITION, base_aggregate, with_year

    return _materialised(spark, sf_dir, "base",
                         lambda: with_year(base_aggregate(clean(flagged_table(spark, sf_dir)))),
                         BASE_PARTITION)
