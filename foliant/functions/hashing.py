"""Repeatable randomness: every draw is a digest of a key, never ``rand()``.

A retried task, another number of partitions or another engine gets the same
value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str | int) -> Column:
    """Hex MD5 of the parts joined with ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hex_to_long(hex_digest: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex characters as a non-negative BIGINT."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("bigint")


def draw(*parts: Column | str | int) -> Column:
    """A BIGINT uniform in [0, 2**32) that depends only on the parts."""
    return hex_to_long(digest(*parts))


def draw_below(bound: Column | int, *parts: Column | str | int) -> Column:
    """A draw in [0, bound); null for a bound that is not positive."""
    limit = bound if isinstance(bound, Column) else F.lit(bound)
    return F.when(limit > 0, F.pmod(draw(*parts), limit.cast("bigint")))
