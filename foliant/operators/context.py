"""Arriving tokens as full chunks and the tail that is left, per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import config as C
from foliant.operators.ordered import TURN_SHIFTS, running_sums


def context_state(
    df: DataFrame,
    chunks: C.Chunks = C.Chunks(),
    key: str = "conv_id",
    turn: str = "turn",
    size: str = "n_tokens",
    shifts: tuple[int, ...] = TURN_SHIFTS,
) -> DataFrame:
    """State after each arrival: tokens so far, full chunks, and the tail."""
    total = running_sums(df, turn, {"total_tokens": F.col(size)}, [key], shifts)
    n = chunks.chunk_size
    return total.withColumns(
        {
            "chunks_done": F.expr(f"total_tokens div {n}"),
            "tail": F.col("total_tokens") % n,
        }
    )


def emitted_chunks(
    df: DataFrame,
    chunk_size: int,
    key: str = "conv_id",
    turn: str = "turn",
    ids: str = "input_ids",
    shifts: tuple[int, ...] = TURN_SHIFTS,
) -> DataFrame:
    """Full chunks of each key's tokens in turn order; the tail is not emitted.

    Every arrival is cut at the chunk boundaries it crosses and the pieces of
    one chunk are put together, so no task holds more than a chunk of a key.
    """
    sized = df.filter(F.size(ids) > 0).withColumn("_n", F.size(ids))
    placed = running_sums(sized, turn, {"_end": F.col("_n")}, [key], shifts)
    placed = placed.withColumn("_start", F.col("_end") - F.col("_n"))
    first = F.expr(f"_start div {chunk_size}")
    last = F.expr(f"(_end - 1) div {chunk_size}")

    def piece(c):
        low = F.greatest(c * chunk_size - F.col("_start"), F.lit(0)).cast("int")
        high = F.least((c + 1) * chunk_size - F.col("_start"), F.col("_n")).cast("int")
        return F.struct(c.alias("chunk_id"), F.slice(ids, low + 1, high - low).alias("piece"))

    pieces = placed.select(
        key, F.col("_start"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p")
    )
    chunks = pieces.groupBy(key, "p.chunk_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_start"), F.col("p.piece").alias("piece")))).alias("_p")
    )
    joined = chunks.select(
        key, "chunk_id", F.flatten(F.transform("_p", lambda p: p["piece"])).alias("input_ids")
    )
    return joined.filter(F.size("input_ids") == chunk_size)
