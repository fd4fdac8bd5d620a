"""Reading the given tables and writing intermediate ones to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from cordon.session import checkpoint_dir

#: Rows of an Arrow batch handed to Python; keeps batches of long texts small.
BATCH_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and this package on the executors (as ``--py-files`` would put it there)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if not getattr(context, "_cordon_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="cordon-code-")), "cordon-code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
        context._cordon_shipped = True
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_written_path", None)
        if path:
            jvm, jsc = t.sparkSession._jvm, t.sparkSession._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name in columns:
        name = "_" + name
    return name
