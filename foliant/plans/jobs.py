"""From a settings file to its result: the evaluation report and the training feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant import config as C
from foliant.plans.feed import training_feed
from foliant.plans.reports import perplexity_report
from foliant.sources import readers
from foliant.sources.catalog import Corpora


def evaluation_report(
    spark: SparkSession,
    settings: str,
    corpora: Corpora,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
) -> DataFrame:
    """The report of every task a settings file lists, over corpora found by name."""
    tasks = readers.read_tasks(spark, settings)
    named = {name: corpora.read(name) for name in dict.fromkeys(t.task_name for t in tasks)}
    return perplexity_report(named, tasks, chunks, tokens)


def job_feed(
    spark: SparkSession,
    settings: str,
    corpora: Corpora,
    iters: int,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    k: int = 2,
    seed: int = 42,
) -> DataFrame:
    """The training feed of a job file's mixture, over corpora found by name."""
    mix = readers.read_mix(spark, settings)
    named = {m.name: corpora.read(m.name) for m in mix}
    return training_feed(named, mix, iters, None, chunks, tokens, k, seed=seed)
