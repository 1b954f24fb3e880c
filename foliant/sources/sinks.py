"""Writers for corpora, reports and the metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 JSON lines; characters outside ASCII are written as they are."""
    df.write.mode(mode).json(path)


def write_feed(df: DataFrame, path: str, steps_per_file: int = 10_000) -> None:
    """A training feed as Parquet, ordered by step inside ranges of steps."""
    ranged = df.withColumn("step_range", F.expr(f"step div {steps_per_file}"))
    (
        ranged.repartition("step_range")
        .sortWithinPartitions("step", "seq")
        .write.partitionBy("step_range")
        .parquet(path)
    )


def append_log(
    report: DataFrame, path: str, command: str, run: str | None = None, **extra: str
) -> None:
    """Append report rows with the time, the command and extra fields.

    ``run`` names the job: its rows lie in a partition of their own, which the write
    replaces when it commits. A job that is repeated, or was killed halfway and is
    started again, then stands in the log once. Without it every call appends.
    """
    stamped = report.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd, HH:mm:ss").alias("logged_at"),
        F.lit(command).alias("command"),
        *[F.lit(v).alias(k) for k, v in extra.items()],
        *report.columns,
    )
    if run is None:
        stamped.write.mode("append").json(path)
        return
    (
        stamped.withColumn("run", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .json(path)
    )
