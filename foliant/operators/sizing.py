"""Size checks and lineage cuts used before a plan depends on either."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_SCAN_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small scan one partition per core.

    A file with a single row group is read by one task whatever its split
    size. Only inputs below ``SMALL_SCAN_BYTES`` are moved; larger ones have
    enough splits, and shuffling them would cost more than it brings.
    """
    if not hasattr(df, "_jdf"):  # no plan statistics over a remote session
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SMALL_SCAN_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Unset on a local master it becomes a fresh temporary folder; unset on a
    cluster it is an error, because executors could not share a local one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    where = tempfile.mkdtemp(prefix="foliant-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """Write a table once into the shared folder and go on from the files.

    For results that are small beside what they come from and are used more
    than once. Losing an executor afterwards costs no recomputation, and later
    readers see only the columns they need. The files go when the application
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
