"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are words plus one end mark. Documents beyond the largest length are
cut into whole sequences and a rest, so nothing is lost. Pieces are dealt by
the digest of their id into groups of about ``GROUP_TOKENS``; a group is packed
by one task as its rows arrive, longest first. A piece goes into the bin with
the least room that holds it. If there is none, a bin is opened whose cost
(length plus ``OVERHEAD``) per token it can still expect to hold is least:
large bins while much is left, smaller ones towards the end. At the end every
bin shrinks to the smallest permitted length that holds its contents.

More groups cost at most a few part-filled bins each; the group size is a
parameter, and so is the column of lengths.

Defined cases: null and empty texts are their end mark; rows that repeat an id
are packed each; a null id is packed like any other; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
GROUP_TOKENS = 4_000_000
PACKED = (
    "doc_id bigint, piece int, first bigint, length bigint, pack_group int, bin int, "
    "position bigint, capacity bigint"
)


def word_count(text: str = "text") -> Column:
    """Words of a text plus one end mark."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint") + 1


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> list[tuple[int, int, int]]:
    """(bin, position, capacity) of each piece; pieces come longest first."""
    sizes = sorted(sizes)
    left = sum(lengths)
    room: list[tuple[int, int]] = []
    used: list[int] = []
    placed: list[tuple[int, int]] = []
    for length in lengths:
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            fits = [s for s in sizes if s >= length]
            free = min(fits, key=lambda s: ((s + OVERHEAD) / min(s, left), s))
            number = len(used)
            used.append(0)
        placed.append((number, used[number]))
        used[number] += length
        left -= length
        if free > length:
            insort(room, (free - length, number))
    final = [next(s for s in sizes if s >= u) for u in used]
    return [(b, p, final[b]) for b, p in placed]


def _pack(sizes: Sequence[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups follow each other whole; one group is held at a time."""

    def packed(group: int, rows: list[tuple]) -> pa.RecordBatch:
        bins = best_fit([r[3] for r in rows], sizes)
        columns = zip(*[(*r, group, *b) for r, b in zip(rows, bins, strict=True)], strict=True)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names
        )

    group, rows = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for row in zip(*columns, strict=True):
            if row[4] != group and rows:
                yield packed(group, rows)
                rows = []
            group = row[4]
            rows.append(row[:4])
    if rows:
        yield packed(group, rows)


def pack(
    docs: DataFrame,
    sizes: Sequence[int] = SIZES,
    row_id: str = "doc_id",
    length: Column | None = None,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: its place in its document, its bin, and the bin's length."""
    largest = max(sizes)
    rows = docs.select(
        F.col(row_id).cast("bigint").alias("doc_id"),
        (word_count() if length is None else length).cast("bigint").alias("total"),
    )
    tokens = rows.agg(F.sum("total")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    last = F.floor((F.col("total") - 1) / largest).cast("int")
    pieces = rows.select("doc_id", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("bigint") * largest
    pieces = pieces.select(
        "doc_id",
        "piece",
        first.alias("first"),
        F.least(F.lit(largest), F.col("total") - first).cast("bigint").alias("length"),
        F.pmod(F.xxhash64("doc_id", "total", "piece"), F.lit(groups)).cast("int").alias("pack_group"),
    )
    dealt = pieces.repartition("pack_group").sortWithinPartitions(
        "pack_group", F.desc("length"), "doc_id", "piece"
    )
    wanted = tuple(sizes)
    return dealt.mapInArrow(lambda batches: _pack(wanted, batches), PACKED)
