"""A word vocabulary counted from the corpus, and encoding with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import tokens as tk

MAX_BROADCAST_VOCAB = 1_000_000


def build_vocabulary(df: DataFrame, text: str = "text", size: int = 32000) -> DataFrame:
    """The ``size`` most frequent words, ids from ``UNK + 1`` in rank order.

    Words are counted before the shuffle; the top is taken without a full
    sort, and only those rows are ranked in one place.
    """
    counts = (
        df.select(F.explode(tk.words(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = [F.col("n").desc(), F.col("word").asc()]
    top = counts.orderBy(*order).limit(size)
    # At most ``size`` rows are left here.
    rank = F.row_number().over(Window.orderBy(*order))
    return top.select("word", "n", (rank + C.UNK).cast("int").alias("token_id"))


def encode_with_vocabulary(
    df: DataFrame,
    vocabulary: DataFrame,
    row_id: str = "row_id",
    text: str = "text",
    out: str = "input_ids",
    most: int = MAX_BROADCAST_VOCAB,
) -> DataFrame:
    """Token ids of every row; words outside the vocabulary become ``UNK``.

    A vocabulary of at most ``most`` words, which is counted and not assumed, goes to
    the tasks, and words are looked up a column batch at a time: no text is
    shuffled. A larger one is joined on the word, where frequent words are split by
    the adaptive skew join, and rows are put together again by their ids.
    """
    listed = vocabulary.select("word", "token_id")
    known = listed.limit(most + 1).toArrow()
    if known.num_rows > most:
        return _encode_by_join(df, listed, row_id, text, out)
    vocab = known["word"].combine_chunks()
    token_ids = known["token_id"].combine_chunks()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1)
            place = pc.index_in(parts.flatten(), value_set=vocab)
            found = pc.fill_null(token_ids.take(place), C.UNK).cast(pa.int32())
            ends = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [row_id, out])

    split = F.coalesce(tk.words(F.col(text)), F.array().cast("array<string>"))
    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, split.alias("_words")).mapInArrow(look_up, f"`{row_id}` {kind}, `{out}` array<int>")


def _encode_by_join(
    df: DataFrame, known: DataFrame, row_id: str, text: str, out: str
) -> DataFrame:
    placed = df.select(row_id, text).repartition(row_id)
    tokens = placed.select(row_id, F.posexplode_outer(tk.words(F.col(text))).alias("pos", "word"))
    looked = tokens.join(known, "word", "left")
    found = F.struct("pos", F.coalesce("token_id", F.lit(C.UNK)).alias("id"))
    collected = looked.groupBy(row_id).agg(
        F.collect_list(F.when(F.col("word").isNotNull(), found)).alias("_t")
    )
    return collected.select(
        row_id, F.transform(F.array_sort("_t"), lambda t: t["id"]).alias(out)
    )
