"""Columns that are computed exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that no later filter computes them again.

    The optimizer moves a filter below the projection it reads from by copying
    the projected expression into it; a filter on the length of tokenized text
    would tokenize every row twice, or on the wrong side of a shuffle. A
    one-element ``inline`` is not crossed by filters.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(made)))
