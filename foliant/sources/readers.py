"""Readers for JSON lines, split-object JSON, tables and job settings."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import config as C
from foliant.operators.mixing import first_rows


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TEXT = _strings("text")
INSTRUCTION_LINES = _strings("input", "output")
COPY_PAIRS = _strings("prompt", "response")
MIXED_LINES = T.StructType(
    [
        *_strings("text", "input", "output"),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
    ]
)


def read_json_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = TEXT,
    numbered: bool = True,
) -> DataFrame:
    """One JSON object per line from a file, a glob or a list of either.

    ``source`` is the file a row came from. ``numbered`` adds ``row_id``, the
    dense position in the order of the list, then of file names.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    cols = [F.col(f.name) for f in schema.fields]

    def one(place: int, path: str) -> DataFrame:
        return spark.read.schema(schema).json(path).select(
            *cols,
            F.col("_metadata.file_path").alias("source"),
            F.lit(place).alias("_place"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_order"),
        )

    rows = reduce(DataFrame.unionByName, [one(i, p) for i, p in enumerate(paths)])
    if not numbered:
        return rows.drop("_place", "_start", "_order")
    return _number_by_split(rows)


def _number_by_split(rows: DataFrame) -> DataFrame:
    """Number rows inside their input split and add the rows of earlier splits.

    Files count in the order of the list, those of one pattern by name. A
    split is read by one task from its start to its end, so a row's rank in it
    is the distance from its first row, and no row moves. The table of splits
    has one row per split, which the driver that plans them holds anyway; it
    is broadcast.
    """
    split = ["_place", "source", "_start"]
    sizes = rows.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first")
    )
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    offsets = sizes.select(*split, (before - F.col("_first")).alias("_shift"))
    return (
        rows.join(F.broadcast(offsets), split)
        .withColumn("row_id", F.col("_shift") + F.col("_order"))
        .drop("_place", "_start", "_order", "_shift")
    )


def read_split_json(
    spark: SparkSession, path: str, split: str, schema: T.StructType = COPY_PAIRS
) -> DataFrame:
    """One JSON object ``{"train": [...], "test": [...]}``; one of its two lists."""
    if split not in ("train", "test"):
        raise ValueError(f"split {split!r} is neither 'train' nor 'test'")
    whole = T.StructType([T.StructField(s, T.ArrayType(schema)) for s in ("train", "test")])
    raw = spark.read.schema(whole).option("multiLine", True).json(path)
    listed = raw.select(F.posexplode(split).alias("row_id", "_r"))
    return listed.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        *[F.col("_r")[f.name].alias(f.name) for f in schema.fields],
    )


def read_table(
    spark: SparkSession,
    where: str,
    split: str | None = None,
    lang: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A table by catalog name or path, filtered by its split and language.

    The filters reach the scan: as partition pruning where the columns are
    partitions, else as pushed filters.
    """
    if fmt == "table":
        df = spark.table(where)
    else:
        df = spark.read.format(fmt).load(where)
    if split is not None and "split" in df.columns:
        df = df.filter(F.col("split") == split)
    if lang is not None:
        df = df.filter(F.col("lang") == lang)
    return df


def read_first(df: DataFrame, n: int = C.BOUNDED_READ_ROWS, require: bool = False) -> DataFrame:
    """The first n rows in corpus order; a shorter corpus gives what it has."""
    return first_rows(df, n, "row_id", require)


def _read_json(spark: SparkSession, path: str) -> dict | list:
    """A small settings file, read through Spark so that any file system works."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one settings file")
    return json.loads(rows[0][0])


def read_tasks(spark: SparkSession, path: str) -> list[C.Task]:
    """The task list of an evaluation: a JSON array, or the tasks of a job file."""
    data = _read_json(spark, path)
    listed = data["train"]["tasks"] if isinstance(data, dict) else data
    return [
        C.Task(t["task_type"], t["task_name"], t["num_instance"], t["truncation"]) for t in listed
    ]


def read_mix(spark: SparkSession, path: str) -> list[C.MixEntry]:
    """The corpus mixture of a job file."""
    data = _read_json(spark, path)
    return [
        C.MixEntry(m["name"], float(m["partition"]), m["truncation"])
        for m in data["train"]["corpus"]
    ]


def read_chunks(spark: SparkSession, path: str) -> C.Chunks:
    data = _read_json(spark, path)
    return C.Chunks(data["chunk_size"], data["num_memory"])
