"""Numbering and running totals that never sort one key in one task.

A window over a whole key is one task per key, and a window without a key is
one task for everything. Here the order column is cut into blocks: rows are
ranked or summed inside their block, the (much smaller) block totals are
summed in turn, and each row adds the total of the blocks before its own. A
key that holds a third of all rows is spread over its blocks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import hashing

# 16 bits of a digest: at most 65,536 buckets per key.
_BUCKET_DIGITS = 4
BUCKETS = 16**_BUCKET_DIGITS
_BROADCAST_KEYS = 16
_NUMBERS = (T.NumericType, T.BooleanType)

# Block widths in bits of the order column. Row ids may be sparse, so their
# blocks are themselves blocked: no window sees more than 2**24 block totals.
# Turn and line numbers are dense enough for one level.
ID_SHIFTS = (16, 40)
TURN_SHIFTS = (14,)


def _totals_before(
    blocks: DataFrame, by: list[str], block: str, values: list[str], shifts: tuple[int, ...]
) -> DataFrame:
    """Replace each block's totals by the totals of all earlier blocks."""
    if not shifts:
        before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.select(
            *by, block, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values]
        )
    upper = f"{block}u"
    nested = blocks.withColumn(upper, F.shiftright(block, shifts[0]))
    outer = nested.groupBy(*by, upper).agg(*[F.sum(v).alias(v) for v in values])
    outer = _totals_before(
        outer, by, upper, values, tuple(s - shifts[0] for s in shifts[1:])
    ).withColumnsRenamed({v: f"{v}_outer" for v in values})
    before = (
        Window.partitionBy(*by, upper).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = nested.select(
        *by,
        upper,
        block,
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values],
    )
    return inner.join(outer, [*by, upper]).select(
        *by, block, *[(F.col(v) + F.col(f"{v}_outer")).alias(v) for v in values]
    )


def running_sums(
    df: DataFrame,
    order: str,
    values: dict[str, Column],
    by: Sequence[str] = (),
    shifts: tuple[int, ...] = TURN_SHIFTS,
) -> DataFrame:
    """Add inclusive running sums of ``values`` per key in the order of a BIGINT.

    ``order`` must be unique within the key and not negative. A window task
    sees at most ``2**shifts[0]`` rows.

    Rows and block totals both come from ``df``. A table that holds only
    numbers besides its keys is read and shuffled once: a block's totals are
    read off its last row, with all columns, so both sides ask for the same
    exchange. With texts or arrays the totals are a second, narrow reading,
    combined before its shuffle.
    """
    by = list(by)
    cols = {f"_v{i}": expr for i, expr in enumerate(values.values())}
    # Never null, or a null check on one side alone would part the exchanges.
    block = F.coalesce(F.shiftright(F.col(order).cast("bigint"), shifts[0]), F.lit(0))
    rows = df.withColumns({**cols, "_block": block})
    inside = (
        Window.partitionBy(*by, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.withColumns({c: F.sum(c).over(inside) for c in cols})
    if all(isinstance(f.dataType, _NUMBERS) for f in df.schema.fields if f.name not in by):
        last = F.max_by(F.struct(*summed.columns), order).alias("_last")
        blocks = summed.groupBy(*by, "_block").agg(last)
        blocks = blocks.select(*by, "_block", *[F.col("_last")[c].alias(c) for c in cols])
    else:
        blocks = rows.groupBy(*by, "_block").agg(*[F.sum(c).alias(c) for c in cols])
    before = _totals_before(
        blocks, by, "_block", list(cols), tuple(s - shifts[0] for s in shifts[1:])
    ).withColumnsRenamed({c: f"{c}_before" for c in cols})
    joined = summed.join(before, [*by, "_block"])
    return joined.select(
        *[F.col(c) for c in df.columns if c not in values],
        *[
            (F.col(c) + F.col(f"{c}_before")).alias(name)
            for c, name in zip(cols, values, strict=True)
        ],
    )


def id_positions(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    out: str = "pos",
    shifts: tuple[int, ...] = ID_SHIFTS,
) -> DataFrame:
    """Dense 0-based position per key in the order of a unique BIGINT id."""
    numbered = running_sums(df, order, {out: F.lit(1).cast("bigint")}, by, shifts)
    return numbered.withColumn(out, F.col(out) - 1)


def shuffled_positions(
    df: DataFrame,
    row_id: str,
    seed: int,
    by: Sequence[str] = (),
    out: str = "pos",
    first: int | None = None,
    known_keys: int | None = None,
) -> DataFrame:
    """Dense 0-based position in a random but repeatable order, per key.

    The order is that of an MD5 digest of key, id and seed. Its leading 16
    bits split every key into up to 65,536 even buckets: bucket counts give
    each bucket its offset, and rows are ranked inside the bucket.

    ``first`` keeps exactly the first N positions of each key. Buckets that
    start beyond N are dropped by the offset join, before the rows are ranked.
    The offset table is broadcast when the number of keys is known
    (``known_keys``) to be small; otherwise it is joined on
    (key, bucket), which splits a hot key as well.
    """
    by = list(by)
    rows = df.withColumn("_digest", hashing.digest(*[F.col(c) for c in by], F.col(row_id), seed))
    rows = rows.withColumn("_bucket", F.substring("_digest", 1, _BUCKET_DIGITS))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_digest", row_id)
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    if first is None and set(df.columns) <= {*by, row_id}:
        # Nothing but ids: counts and ranks share one exchange.
        counts = ranked.groupBy(*by, "_bucket").agg(F.max("_rank").alias("_n"))
    else:
        counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65,536 bucket rows per key, whatever the number of rows.
    earlier = (
        Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    few_keys = not by or (known_keys is not None and known_keys <= _BROADCAST_KEYS)
    position = (F.col("_offset") + F.col("_rank") - 1).cast("bigint").alias(out)
    columns = [F.col(c) for c in df.columns]
    if first is None:
        offsets = F.broadcast(offsets) if few_keys else offsets
        return ranked.join(offsets, [*by, "_bucket"]).select(*columns, position)
    offsets = offsets.filter(F.col("_offset") < first)
    offsets = F.broadcast(offsets) if few_keys else offsets
    kept = rows.join(offsets, [*by, "_bucket"]).withColumn("_rank", F.row_number().over(inside))
    return kept.select(*columns, position).filter(F.col(out) < first)
