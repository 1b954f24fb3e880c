"""The ordered table of chunk-plan rows a trainer would consume."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant import config as C
from foliant.operators import mixing
from foliant.plans import planners


def training_feed(
    corpora: dict[str, DataFrame],
    mix: Sequence[C.MixEntry],
    iters: int,
    tags: dict[str, tuple[str, ...]] | None = None,
    chunks: C.Chunks = C.Chunks(),
    tokens: C.Tokens = C.Tokens(),
    k: int = 2,
    row_id: str = "row_id",
    seed: int = 42,
) -> DataFrame:
    """Mixture, plan and reservoir in one: rows keyed by (step, seq).

    ``tags`` names the task types of each corpus, all that it can be planned
    for without. A step is one drawn
    document, so it serves as the sample id of its chunks. The reservoir decides in
    the document's row, so nothing is shuffled between plan and feed.
    """
    parts = mixing.mixture_parts(corpora, mix, iters, row_id, seed)
    plans = [
        planners.plan_tasks(
            parts[m.name],
            chunks,
            tokens,
            m.truncation,
            tags[m.name] if tags else None,
            row_id="step",
            seed=seed,
            reservoir=k,
        )
        for m in mix
    ]
    plan = reduce(lambda a, b: a.unionByName(b), plans)
    return plan.withColumnRenamed("sample_id", "step")
