"""Element-wise mixes and norms of named vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import vectors as vx


def mix_vectors(
    df: DataFrame,
    name: str,
    vector: str,
    weight: str | None = None,
    model: str | None = None,
    fixed: str | None = None,
) -> DataFrame:
    """Weighted sum of all vectors of a name, element by element.

    With ``model``, every model must have every name, and one weight that is the
    same at all its names (if there are weights); with ``fixed``, its values must
    agree wherever a name occurs. Both are checked at once.

    Without a weight column every vector of a name has weight 1 / count. The
    sums are combined before the shuffle, so a name that owns most vectors
    costs one row per task and element.
    """
    if model is not None:
        check_mix(df, model, name, None)
        if weight:
            given = F.count_distinct(weight) + F.count_if(F.col(weight).isNull())
            odd = df.groupBy(model).agg(given.alias("n")).filter("n <> 1").limit(5).collect()
            if odd:
                raise ValueError(f"not one weight each for models {[r[0] for r in odd]}")
    if fixed is not None:
        odd = disagreeing_names(df, name, fixed).limit(5).collect()
        if odd:
            raise ValueError(f"fixed values differ for {[r[0] for r in odd]}")
    cells = df.select(
        name,
        (F.col(weight) if weight else F.lit(1.0)).alias("_w"),
        F.posexplode(vx.doubles(F.col(vector))).alias("pos", "x"),
    )
    sums = cells.groupBy(name, "pos").agg(
        F.sum(F.col("_w") * F.col("x")).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    value = F.col("_s") if weight else F.col("_s") / F.col("_n")
    return sums.select(name, "pos", value.alias("value"))


def check_mix(df: DataFrame, model: str, name: str, weights: Sequence[float] | None) -> None:
    """Every model must have every name, and weights one entry per model."""
    models = df.select(model).distinct().count()
    if weights is not None and len(weights) != models:
        raise ValueError(f"{len(weights)} weights for {models} models")
    partial = df.groupBy(name).agg(F.count_distinct(model).alias("n")).filter(F.col("n") != models)
    if not partial.isEmpty():
        raise ValueError("names differ between models")


def assemble(cells: DataFrame, name: str) -> DataFrame:
    """Vectors from (name, pos, value) rows; one vector's elements per group."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return cells.groupBy(name).agg(F.transform(rows, lambda r: r["value"]).alias("vector"))


def disagreeing_names(df: DataFrame, name: str, value: str) -> DataFrame:
    """Names whose unmixable values are not the same everywhere; null is a value."""
    agreed = df.groupBy(name).agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.count(value).alias("given"),
        F.count(F.lit(1)).alias("all"),
    )
    partly = (F.col("given") > 0) & (F.col("given") < F.col("all"))
    return agreed.filter((F.col("low") != F.col("high")) | partly).select(name)


def norm_report(
    df: DataFrame, step: str, param: str = "param", grad: str = "grad", eps: float = 1e-6
) -> DataFrame:
    """Average and maximum of update norms and of their ratio to the parameter.

    A missing update has norm 0.
    """
    normed = df.select(
        step,
        F.coalesce(vx.l2_norm(vx.doubles(F.col(grad))), F.lit(0.0)).alias("g"),
        vx.l2_norm(vx.doubles(F.col(param))).alias("p"),
    ).withColumn("r", F.col("g") / (F.col("p") + eps))
    return normed.groupBy(step).agg(
        F.avg("g").alias("avg_norm"),
        F.max("g").alias("max_norm"),
        F.avg("r").alias("avg_ratio"),
        F.max("r").alias("max_ratio"),
    )
