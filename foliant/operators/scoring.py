"""Scores and losses over tables of logits or log-probabilities.

Arrays of logits are reduced to scalars in the row that holds them, so only
scalars are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant import config as C
from foliant.functions import tokens as tk
from foliant.functions import vectors as vx
from foliant.operators.sizing import settle

# A bigram counted at least total / HOT_SHARE times is hot: there can be at
# most HOT_SHARE of them, which bounds what is broadcast.
HOT_SHARE = 200_000

# Pairs a task combines at a time, and tokens per bucket of the counts.
COMBINED, BUCKET = 1 << 21, 1 << 20


# --- per position ----------------------------------------------------------


def with_nll(
    df: DataFrame,
    logits: str = "logits",
    label: str = "label",
    out: str = "nll",
    ignore: int | None = C.IGNORE,
) -> DataFrame:
    """Negative log-probability of the label; 0 where the label is ignored."""
    scored = vx.with_log_sum_exp(df, logits, "_lse")
    nll = -vx.log_prob(F.col(logits), F.col("_lse"), F.col(label))
    if ignore is not None:
        nll = F.when(F.col(label) == ignore, F.lit(0.0)).otherwise(nll)
    return scored.withColumn(out, nll).drop("_lse")


def with_softmax(df: DataFrame, logits: str = "logits", out: str = "probs") -> DataFrame:
    scored = vx.with_log_sum_exp(df, logits, "_lse")
    return scored.withColumn(out, vx.softmax(F.col(logits), F.col("_lse"))).drop("_lse")


def with_min_max(df: DataFrame, values: str, out: str = "scaled") -> DataFrame:
    """Array scaled to [0, 1] by its own minimum and maximum."""
    edged = df.withColumns({"_arr": vx.doubles(F.col(values))}).withColumns(
        {"_low": F.array_min("_arr"), "_high": F.array_max("_arr")}
    )
    return edged.withColumn(out, vx.min_max(F.col("_low"), F.col("_high"), F.col("_arr"))).drop(
        "_arr", "_low", "_high"
    )


# --- losses ----------------------------------------------------------------


def prefix_masked_ce(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    nll: str = "nll",
    mask: str = "mask",
    out: str = "loss",
) -> DataFrame:
    """Sum of losses from the first masked-in position on, over the ones.

    Zeros after that position still count in the sum. ``keys`` name one chunk,
    so a window sees at most a chunk of positions.
    """
    chunk = Window.partitionBy(*keys)
    first = F.min(F.when(F.col(mask) == 1, F.col(pos))).over(chunk)
    started = df.withColumn("_first", first)
    return started.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.when(F.col(pos) >= F.col("_first"), F.col(nll)).otherwise(0.0)),
            F.sum(F.when(F.col(mask) == 1, 1).otherwise(0)),
        ).alias(out)
    )


def ignore_index_ce(
    df: DataFrame, sample: str, label: str = "label", nll: str = "nll", overall: bool = True
) -> DataFrame:
    """Mean loss over valid labels per sample, 0 without any.

    ``overall`` adds a row with a null sample: the mean over all valid labels,
    or the plain sum when there is none.
    """
    valid = F.count_if(F.col(label) != C.IGNORE)
    summed = F.sum(F.when(F.col(label) == C.IGNORE, 0.0).otherwise(F.col(nll)))
    per_sample = df.groupBy(sample).agg(summed.alias("loss_sum"), valid.alias("valid"))
    mean = F.coalesce(F.try_divide("loss_sum", "valid"), F.lit(0.0))
    rows = per_sample.select(sample, mean.alias("loss"), "loss_sum", "valid")
    if not overall:
        return rows
    grand = per_sample.agg(F.sum("loss_sum").alias("loss_sum"), F.sum("valid").alias("valid"))
    return rows.unionByName(
        grand.select(
            F.lit(None).cast(per_sample.schema[sample].dataType).alias(sample),
            F.when(F.col("valid") > 0, F.try_divide("loss_sum", "valid"))
            .otherwise(F.col("loss_sum"))
            .alias("loss"),
            "loss_sum",
            "valid",
        )
    )


def shifted(
    df: DataFrame, sample: str, pos: str = "pos", label: str = "label", last: str | None = None
) -> DataFrame:
    """Pair the logits at t with the label at t + 1; the last logits go unused.

    A join on (sample, pos) rather than a window over the whole sample.
    """
    labels = df.select(sample, (F.col(pos) - 1).alias(pos), label)
    return df.drop(label).join(labels, [sample, pos])


def chunk_loss_sum(
    df: DataFrame,
    sample: str,
    chunk: str,
    denominator: str = "denominator",
    label: str = "label",
    nll: str = "nll",
) -> DataFrame:
    """Chunk sums of the loss, added up and divided once per sample."""
    valid = F.count_if(F.col(label) != C.IGNORE)
    summed = F.sum(F.when(F.col(label) == C.IGNORE, 0.0).otherwise(F.col(nll)))
    per_chunk = df.groupBy(sample, chunk).agg(
        summed.alias("chunk_loss"), valid.alias("valid"), F.max(denominator).alias("denominator")
    )
    return per_chunk.groupBy(sample).agg(
        F.try_divide(F.sum("chunk_loss"), F.max("denominator")).alias("loss"),
        F.sum("valid").alias("valid"),
    )


def kl_masked(
    df: DataFrame,
    keys: Sequence[str],
    teacher: str = "teacher",
    student: str = "student",
    mask: str = "mask",
    temperature: float = 1.0,
    out: str = "kl",
) -> DataFrame:
    """KL(teacher || student) summed over masked-in positions, per such position.

    A sample without such a position has a null result.
    """
    df = vx.with_log_sum_exp(df, teacher, "_tl", temperature)
    df = vx.with_log_sum_exp(df, student, "_sl", temperature)
    row = vx.kl(F.col(teacher), F.col("_tl"), F.col(student), F.col("_sl"), temperature)
    row = F.when(F.col(mask) == 1, row)
    return df.withColumn("_kl", row).groupBy(*keys).agg(F.avg("_kl").alias(out))


def mse_masked(
    df: DataFrame,
    keys: Sequence[str],
    teacher: str = "teacher",
    student: str = "student",
    mask: str = "mask",
    out: str = "mse",
) -> DataFrame:
    """Squared gap of masked-in positions over the elements of all positions."""
    gap = F.when(F.col(mask) == 1, vx.squared_gap(F.col(teacher), F.col(student))).otherwise(0.0)
    sized = df.select(*keys, gap.alias("_gap"), F.size(teacher).alias("_n"))
    return sized.groupBy(*keys).agg(F.try_divide(F.sum("_gap"), F.sum("_n")).alias(out))


def blended(kl: Column, ce: Column, kl_share: float = C.KL_SHARE, ce_share: float = C.CE_SHARE) -> Column:
    return kl * kl_share + ce * ce_share


def criterion(name: str) -> Callable[..., DataFrame]:
    """Loss by name, whatever the case."""
    known = {"mse": mse_masked, "kldiv": kl_masked, "ce": prefix_masked_ce}
    if name.lower() not in known:
        raise ValueError(f"criterion {name!r} is not one of {sorted(known)}")
    return known[name.lower()]


# --- bigram scorer ---------------------------------------------------------


def token_pairs(
    df: DataFrame,
    chunk_size: int,
    cuts: Sequence[int | None] = (None,),
    keep: str = "sample_id",
    ids: str = "input_ids",
) -> DataFrame:
    """Adjacent tokens of every sample with their band: ``keep, band, prev, tok``.

    A band holds the positions from the cut before it up to its own; the last
    cut is ``None``. Chunks restart at multiples of ``chunk_size``, so the first token
    of a chunk has no predecessor. A sample without pairs leaves one row with null
    tokens.
    """
    known = df.select(keep, F.coalesce(ids, F.array().cast("array<int>")).alias("_ids"))
    # The array stays beside its positions: structs of two tokens would be made for every pair.
    rows = known.select(keep, "_ids", F.posexplode_outer("_ids").alias("_at", "_prev"))
    at = F.coalesce("_at", F.lit(0)) + 1
    valid = F.col("_at").isNotNull() & (at < F.size("_ids")) & (at % chunk_size != 0)
    band = F.lit(len(cuts) - 1)
    for k, cut in reversed(list(enumerate(cuts))):
        if cut is not None:
            band = F.when(at < cut, F.lit(k)).otherwise(band)
    return rows.filter(valid | (at == 1)).select(
        keep,
        band.alias("band"),
        F.when(valid, F.col("_prev")).alias("prev"),
        F.when(valid, F.get("_ids", at)).alias("tok"),
    )


def count_pairs(df: DataFrame, chunk_size: int, ids: str = "input_ids") -> DataFrame:
    """Occurrences ``n`` of each (prev, tok) of the pairs that ``token_pairs`` finds.

    Pairs are taken from whole batches of arrays, both tokens packed into one number. A task
    combines about ``COMBINED`` pairs at a time by sorting them and deals what is left to buckets,
    one per ``BUCKET`` tokens of all; a bucket adds up its parts. A pair comes once per
    such turn, however frequent it is.
    """

    def counted(rows: DataFrame) -> DataFrame:
        pairs = token_pairs(rows.select(F.lit(0).alias("_all"), ids), chunk_size, keep="_all", ids=ids)
        known = pairs.filter(F.col("prev").isNotNull())
        return known.groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("n"))

    if df.schema[ids].dataType.elementType != T.IntegerType():
        return counted(df)  # two longs do not fit into one number
    holed = F.coalesce(F.exists(ids, lambda x: x.isNull()), F.lit(False))
    tokens, n_holed = df.agg(F.sum(F.size(ids)), F.count_if(holed)).first()
    buckets = max((tokens or 0) // BUCKET, 1)

    def tally(packed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(packed)
        packed, n = packed[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        return packed[first], np.add.reduceat(n, first)

    def packed_pairs(lists: pa.ListArray) -> np.ndarray:
        ends = lists.offsets.to_numpy()
        sizes = np.diff(ends)
        values = lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
        at = np.arange(1, len(values) + 1) - np.repeat(ends[:-1] - ends[0], sizes)
        found = np.flatnonzero((at < np.repeat(sizes, sizes)) & (at % chunk_size != 0))
        return values[found] << 32 | values[found + 1] & 0xFFFFFFFF

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        packed, n = np.unique(np.concatenate(held), return_counts=True)
        mixed = packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (packed, n)]
        numbers = pa.array(np.arange(buckets, dtype=np.int32))
        rows = pa.RecordBatch.from_arrays([numbers, *lists], ["bucket", "pairs", "ns"])
        return rows.filter(pa.array(sizes > 0))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(packed_pairs(batch.column(0)))
            size += len(held[-1])
            if size >= COMBINED:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def add_up(parts: pa.Table) -> pa.Table:
        packed, n = (parts.column(c).combine_chunks().flatten().to_numpy() for c in ("pairs", "ns"))
        packed, n = tally(packed, n)
        found = {"prev": (packed >> 32).astype(np.int32), "tok": packed.astype(np.int32), "n": n}
        return pa.table(found)

    arrays = df.filter(F.col(ids).isNotNull() & ~holed).select(ids)
    parts = arrays.mapInArrow(combine, "bucket int, pairs array<bigint>, ns array<bigint>")
    counts = parts.groupBy("bucket").applyInArrow(add_up, "prev int, tok int, n bigint")
    if not n_holed:
        return counts
    both = counts.unionByName(counted(df.filter(holed)))
    return both.groupBy("prev", "tok").agg(F.sum("n").alias("n"))


def fit_bigrams(counts: DataFrame) -> DataFrame:
    """Add-one bigram model: ``ln((n(a, b) + 1) / (n(a) + V))`` per seen bigram.

    ``counts`` has each ``prev``, ``tok`` once with its number ``n``, as ``count_pairs`` makes
    them. V counts the distinct tokens of all pairs. The counts are written out once: they are
    used four times below and in scoring, and are far smaller than the text they come from.
    Counts of first tokens have a row per token of the vocabulary at most, and are broadcast.
    """
    counts = settle(counts)
    firsts = counts.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    ends = counts.select(F.explode(F.array("prev", "tok")).alias("t"))
    vocab = ends.agg(F.count_distinct("t").alias("v")).scalar()
    return counts.join(F.broadcast(firsts), "prev").select(
        "prev", "tok", "n", F.log((F.col("n") + 1) / (F.col("n_prev") + vocab)).alias("logprob")
    )


def score_bigrams(pairs: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of log-probabilities and number of scored pairs per key.

    Bigrams that make up at least one in ``HOT_SHARE`` of all pairs are looked up in a
    broadcast of their log-probabilities: there are ``HOT_SHARE`` of them at most, and
    their occurrences meet no shuffle before they are summed. A bigram below that has
    less than a ``HOT_SHARE``-th of all occurrences, so no task of the join is hot;
    its occurrences pass by the hashed model and are not sorted. A key without pairs
    has a null sum.
    """
    keys = list(keys)
    pair = ["prev", "tok"]
    total = model.agg(F.sum("n").alias("total")).scalar()
    is_hot = F.col("n") * HOT_SHARE >= total
    hot = model.filter(is_hot).select(*pair, F.col("logprob").alias("_hot"))
    looked = pairs.join(F.broadcast(hot), pair, "left")
    rare = model.filter(~is_hot).select(*pair, F.col("logprob").alias("_hot"))
    near = looked.filter(F.col("_hot").isNotNull() | F.col("prev").isNull())
    far = looked.filter(F.col("_hot").isNull() & F.col("prev").isNotNull()).drop("_hot")
    scored = near.unionByName(far.join(rare.hint("shuffle_hash"), pair))
    return scored.groupBy(*keys).agg(F.sum("_hot").alias("logprob"), F.count("_hot").alias("pairs"))


def perplexity(logprob: Column, pairs: Column) -> Column:
    """exp(-mean log-probability); null without a scored token."""
    return F.exp(-F.try_divide(logprob, pairs))


def sample_perplexity(
    df: DataFrame, sample: str = "sample_id", logprobs: str = "logprobs"
) -> DataFrame:
    """Perplexity per sample from one array of log-probabilities per chunk."""
    sized = df.select(
        sample, vx.sum_of(vx.doubles(F.col(logprobs))).alias("_s"), F.size(logprobs).alias("_n")
    )
    return (
        sized.groupBy(sample)
        .agg(F.sum("_s").alias("_s"), F.sum("_n").alias("scored_tokens"))
        .filter(F.col("scored_tokens") > 0)
        .select(
            sample,
            "scored_tokens",
            perplexity(F.col("_s"), F.col("scored_tokens")).alias("perplexity"),
        )
    )


def first_result(df: DataFrame, sample: str, seq: str, result: str, out: str) -> DataFrame:
    """The result of each sample's first chunk that has one."""
    return (
        df.filter(F.col(result).isNotNull())
        .groupBy(sample)
        .agg(F.min_by(result, seq).alias(out))
    )


def score_chunks_with(
    chunks: DataFrame,
    make_scorer: Callable[[], Callable[[list[list[int]]], list[list[float]]]],
    sample: str = "sample_id",
    seq: str = "seq",
    ids: str = "input_ids",
) -> DataFrame:
    """Score chunks with a Python model, made once per Python worker.

    The model gets a list of chunks and returns the log-probabilities of the
    tokens after the first of each. Chunks arrive in sample order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scores = scorer([[int(x) for x in c] for c in batch[ids]])
            yield pd.DataFrame({sample: batch[sample], seq: batch[seq], "logprobs": scores})

    ordered = chunks.select(sample, seq, ids).sortWithinPartitions(sample, seq)
    return ordered.mapInPandas(run, f"{sample} bigint, {seq} int, logprobs array<double>")


def text_encoder(
    make_encoder: Callable[[], Callable[[str], list[int]]],
) -> Callable[[Column], Column]:
    """A Python tokenizer, made once per Python worker, as a column function."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            yield batch.map(lambda t: None if t is None else list(encoder(t)))

    return encode


def tokenize_with(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[str], list[int]]],
    text: str = "text",
    out: str = "input_ids",
) -> DataFrame:
    """Add the ids a Python tokenizer gives."""
    return df.withColumn(out, text_encoder(make_encoder)(F.col(text)))
