"""Batches padded to their longest row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import config as C
from foliant.functions import tokens as tk
from foliant.operators.once import with_once
from foliant.operators.ordered import shuffled_positions
from foliant.operators.sizing import settle


# What fills an array column, by the first text its name contains.
FILLS = {"attention_mask": 0, "label": C.IGNORE}


def pad_value(column: str, pad: int = C.PAD, fills: dict[str, int] | None = None) -> int:
    """Fill of a column: that of the caller's name, or else of the first text it contains."""
    if fills and column in fills:
        return fills[column]
    return next((fill for part, fill in FILLS.items() if part in column), pad)


def depth_of(kind: T.DataType) -> int:
    """How deep lists of numbers are nested; 0 for anything else."""
    if not isinstance(kind, T.ArrayType):
        return 0
    inner = kind.elementType
    if isinstance(inner, T.ArrayType):
        below = depth_of(inner)
        return below + 1 if below else 0
    return 1 if isinstance(inner, T.NumericType) else 0


def pad_nested(lists: Column, depth: int, length: Column, value: int, side: str = "right") -> Column:
    """Lists nested ``depth`` deep with every innermost one padded to ``length``."""
    if depth == 1:
        return tk.pad_to(lists, length, value, side)
    return F.transform(lists, lambda inner: pad_nested(inner, depth - 1, length, value, side))


def _inner_positions(mask: Column, depth: int) -> Column:
    """Running count of ones minus one in every innermost list, 0 where the mask is 0."""
    if depth > 1:
        return F.transform(mask, lambda inner: _inner_positions(inner, depth - 1))
    ones = F.lit(0).cast("bigint")
    return F.transform(
        mask,
        lambda m, i: F.when(m == 0, 0).otherwise(
            (F.aggregate(F.slice(mask, F.lit(1), i + 1), ones, lambda n, x: n + x) - 1).cast("int")
        ),
    )


def batch_lengths(
    df: DataFrame, depths: dict[str, int], batch_size: int, row_id: str, seed: int
) -> DataFrame:
    """Batch, place and padded length per row, from ids and sizes alone."""
    narrow = df.select(row_id, *[tk.longest(F.col(c), d).alias(f"_n_{c}") for c, d in depths.items()])
    placed = shuffled_positions(narrow, row_id, seed, out="pos")
    placed = placed.withColumn("batch_id", F.expr(f"pos div {batch_size}"))
    batch = Window.partitionBy("batch_id")  # batch_size rows
    return placed.select(
        row_id,
        "batch_id",
        (F.col("pos") % batch_size).cast("int").alias("place"),
        *[F.max(f"_n_{c}").over(batch).alias(f"_len_{c}") for c in depths],
    )


def with_position_ids(df: DataFrame, mask: str, out: str = "position_ids") -> DataFrame:
    """Add the running count of ones minus one, 0 wherever the mask is 0.

    A mask with one block of ones counts from the block's start. One with
    holes ranks the places of its ones and sorts the zeros back in.
    """
    at = F.transform(mask, lambda m, i: F.struct(i.alias("at"), m.alias("m")))
    ones = F.filter(at, lambda p: p["m"] != 0)
    zeros = F.filter(at, lambda p: p["m"] == 0)
    df = with_once(
        df, {"_ones": F.transform(ones, lambda p: p["at"]), "_zeros": F.transform(zeros, lambda p: p["at"])}
    )
    first, last = F.array_min("_ones"), F.array_max("_ones")
    solid_block = (last - first + 1 == F.size("_ones")) | (F.size("_ones") == 0)
    df = with_once(df, {"_first": first, "_solid": solid_block})
    solid = F.transform(mask, lambda m, i: F.when(m == 0, 0).otherwise(i - F.col("_first")))
    ranked = F.concat(
        F.transform("_ones", lambda p, rank: F.struct(p.alias("at"), rank.alias("n"))),
        F.transform("_zeros", lambda p: F.struct(p.alias("at"), F.lit(0).alias("n"))),
    )
    holed = F.transform(F.array_sort(ranked), lambda p: p["n"])
    return df.withColumn(out, F.when(F.col("_solid"), solid).otherwise(holed)).drop(
        "_ones", "_zeros", "_first", "_solid"
    )


def collate(
    df: DataFrame,
    batch_size: int,
    row_id: str = "row_id",
    seed: int = 42,
    pad: int = C.PAD,
    side: str = "right",
    add_position_ids: bool = False,
    fills: dict[str, int] | None = None,
) -> DataFrame:
    """Rows in shuffled batches, every list of numbers padded to the batch maximum.

    Lists may be nested: the maximum is that of the innermost lists of a batch. The
    table is written once, since its arrays may be costly; batches are laid out on ids
    and sizes of what was written, and the arrays are joined to the layout. Other columns
    pass through. ``fills`` names other fills than the default ones.
    """
    depths = {f.name: d for f in df.schema.fields if (d := depth_of(f.dataType))}
    df = settle(df)
    layout = batch_lengths(df, depths, batch_size, row_id, seed)
    joined = df.join(layout, row_id)
    padded = [
        pad_nested(F.col(c), d, F.col(f"_len_{c}"), pad_value(c, pad, fills), side).alias(c)
        for c, d in depths.items()
    ]
    others = [c for c in df.columns if c not in depths]
    out = joined.select("batch_id", "place", *others, *padded)
    if add_position_ids:
        for mask in (c for c in depths if "attention_mask" in c):
            name = mask.replace("attention_mask", "position_ids")
            if depths[mask] == 1:
                out = with_position_ids(out, mask, name)
            else:
                out = out.withColumn(name, _inner_positions(F.col(mask), depths[mask]))
    return out


def stack_batches(padded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per batch: each column an array of its rows in place order."""
    rows = F.array_sort(F.collect_list(F.struct("place", *columns)))
    grouped = padded.groupBy("batch_id").agg(rows.alias("_rows"))  # batch_size rows each
    return grouped.select("batch_id", *[F.col(f"_rows.{c}").alias(c) for c in columns])
