"""Training and evaluation samples straight from JSON-lines files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from foliant import config as C
from foliant.operators import samples
from foliant.sources import readers


def training_samples(
    spark: SparkSession,
    paths: str | Sequence[str] | None,
    tokens: C.Tokens = C.Tokens(),
    max_length: int = 4096,
    min_length: int = 512,
    max_per_source: int | None = None,
    seed: int = 42,
) -> DataFrame | None:
    """Samples of every file, each file cut to an exact random number.

    ``paths`` is a file, a glob or a list; lines may have any of the three
    sample shapes. The cut counts the samples that are long enough.
    """
    if paths is None:
        return None
    rows = readers.read_json_lines(spark, paths, readers.MIXED_LINES)
    made = samples.mixed_samples(rows, tokens, min_length, max_length, keep=("source",))
    if max_per_source is None:
        return made
    return samples.sample_per_source(made, max_per_source, seed=seed)


def evaluation_samples(
    spark: SparkSession,
    paths: str | Sequence[str] | None,
    tokens: C.Tokens = C.Tokens(),
    max_length: int = 4096,
    min_length: int = 512,
    max_rows: int | None = None,
) -> DataFrame | None:
    """Samples of the first rows in file order; instruction rows without labels."""
    if paths is None:
        return None
    rows = readers.read_json_lines(spark, paths, readers.MIXED_LINES)
    if max_rows is not None:
        rows = readers.read_first(rows, max_rows)
    return samples.mixed_samples(rows, tokens, min_length, max_length, with_labels=False)
