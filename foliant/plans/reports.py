"""Evaluation: perplexity per sample and one report row per task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import tokens as tk
from foliant.operators import mixing, scoring
from foliant.operators.sizing import settle

REPORT_KEYS = ("task_id", "task_name", "task_type", "num_instance", "truncation")


def task_report(
    samples: DataFrame, chunk_size: int, value: str = "perplexity", unscored: bool = False
) -> DataFrame:
    """Average, maximum and minimum over the samples of each task.

    ``unscored`` adds the number of samples without a value.
    """
    lost = [F.count_if(F.col(value).isNull()).alias("unscored")] if unscored else []
    return samples.groupBy(*REPORT_KEYS).agg(
        F.lit(chunk_size).alias("chunk_size"),
        F.count(value).alias("samples"),
        *lost,
        F.avg(value).alias("avg"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
    )


def perplexity_samples(
    docs: DataFrame,
    truncations: Sequence[int | None],
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    text: str = "text",
    row_id: str = "row_id",
    model: DataFrame | None = None,
    training: DataFrame | None = None,
    only: DataFrame | None = None,
    unscored: bool = False,
) -> DataFrame:
    """Perplexity of each document at each truncation, all from one tokenization.

    Chunks restart at fixed multiples, so a shorter truncation is a prefix of
    a longer one: every token is scored once, at the longest truncation, and
    falls into the band of the shortest truncation that contains it. A
    truncation sums its own band and all shorter ones.

    Token ids are written once, words hashed on batches; the bigram model is fitted on that table
    and scores the same table. ``model`` is
    another model, ``training`` other texts to fit on, and ``only`` the ids to score.
    Documents without a scored token are left out, or kept with a null perplexity
    (``unscored``).
    """
    ordered: list[int | None] = sorted({t for t in truncations if t is not None})
    if None in truncations:
        ordered.append(None)

    if tokens.encoder is None:
        tokens = replace(tokens, encoder=tk.word_encoder(tokens.vocab_size))

    def ids_of(df: DataFrame) -> DataFrame:
        ids = tk.tokenize(F.col(text), tokens).alias("input_ids")
        return settle(df.select(F.col(row_id).cast("bigint").alias("sample_id"), ids))

    # Beyond the longest truncation pairs are counted for the model alone.
    cuts = ordered + ([] if ordered[-1] is None else [None])
    n = chunks.chunk_size
    if model is not None and only is not None:
        docs = docs.join(only.select(row_id), row_id, "left_semi")
    own = ids_of(docs)
    pairs = scoring.token_pairs(own, n, cuts)
    if model is None:
        fitted_on = own if training is None else ids_of(training)
        model = scoring.fit_bigrams(scoring.count_pairs(fitted_on, n))
    scorable = pairs.filter(F.col("band") < len(ordered))
    if only is not None:
        chosen = only.select(F.col(row_id).cast("bigint").alias("sample_id"))
        scorable = scorable.join(chosen, "sample_id", "left_semi")
    scored = scoring.score_bigrams(scorable, model, ["sample_id", "band"])
    per_truncation = F.array(
        *[
            F.struct(
                F.lit(t).cast("int").alias("truncation"),
                F.sum(F.when(F.col("band") <= i, F.col("logprob"))).alias("logprob"),
                F.sum(F.when(F.col("band") <= i, F.col("pairs"))).alias("scored_tokens"),
            )
            for i, t in enumerate(ordered)
        ]
    )
    rows = scored.groupBy("sample_id").agg(per_truncation.alias("_t"))
    flat = rows.select("sample_id", F.inline("_t"))
    if not unscored:
        flat = flat.filter(F.col("scored_tokens") > 0)
    return flat.select(
        "sample_id",
        "truncation",
        F.coalesce("scored_tokens", F.lit(0)).alias("scored_tokens"),
        scoring.perplexity(F.col("logprob"), F.col("scored_tokens")).alias("perplexity"),
    )


def perplexity_report(
    corpora: dict[str, DataFrame],
    tasks: Sequence[C.Task],
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    text: str = "text",
    row_id: str = "row_id",
    model: DataFrame | None = None,
) -> DataFrame:
    """The report of every perplexity task; each corpus is scored once.

    A task with ``num_instance`` covers the first rows of its corpus; a corpus
    with fewer is an error, whatever the other tasks. When all tasks of a corpus
    have one, only those rows are scored. ``unscored`` counts a task's samples
    without a scored token; they are in no average.
    """
    other = [t.task_type for t in tasks if t.task_type != C.PERPLEXITY]
    if other:
        raise ValueError(f"not perplexity tasks: {other}")
    spark = next(iter(corpora.values())).sparkSession
    frame = F.broadcast(mixing.tasks_frame(spark, tasks))
    parts = []
    for name in dict.fromkeys(t.task_name for t in tasks):
        docs = corpora[name]
        own = [t for t in tasks if t.task_name == name]
        bounds = [t.num_instance for t in own if t.num_instance is not None]
        numbered = only = None
        if bounds:
            found = docs.select(row_id).count()
            if found < max(bounds):
                raise ValueError(f"corpus {name!r} has {found} rows, {max(bounds)} are required")
            numbered = mixing.numbered_rows(docs.select(row_id), row_id)
            if len(bounds) == len(own):
                only = numbered.filter(F.col("row_no") <= max(bounds))
        samples = perplexity_samples(
            docs, [t.truncation for t in own], chunks, tokens, text, row_id, model, only=only, unscored=True
        )
        mine = frame.filter(F.col("task_name") == name)
        # Null-safe: a task without truncation meets the untruncated scores.
        joined = samples.withColumnRenamed("truncation", "_t").join(
            mine, F.col("_t").eqNullSafe(F.col("truncation"))
        )
        if numbered is not None:
            rows = numbered.select(F.col(row_id).cast("bigint").alias("sample_id"), "row_no")
            joined = joined.join(rows, "sample_id").filter(
                F.col("num_instance").isNull() | (F.col("row_no") <= F.col("num_instance"))
            )
        parts.append(joined.select(*REPORT_KEYS, "sample_id", "scored_tokens", "perplexity"))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return task_report(every, chunks.chunk_size, unscored=True)
