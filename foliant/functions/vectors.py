"""Column functions on ARRAY<DOUBLE> rows of logits or vectors.

The maximum and the sum of exponentials are added by ``with_log_sum_exp`` as
columns of their own first; inside a lambda they would be evaluated once per
element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def l2_norm(arr: Column) -> Column:
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x))


def doubles(arr: Column) -> Column:
    return arr.cast("array<double>")


def with_log_sum_exp(
    df: DataFrame, logits: str, out: str = "log_sum_exp", temperature: float = 1.0
) -> DataFrame:
    """Add ln(sum(exp(x / T))) of an array column, computed around its maximum."""
    scaled, top = f"_{out}_scaled", f"_{out}_max"
    arr = doubles(F.col(logits))
    if temperature != 1.0:
        arr = F.transform(arr, lambda x: x / temperature)
    return (
        df.withColumn(scaled, arr)
        .withColumn(top, F.array_max(scaled))
        .withColumn(
            out,
            F.col(top)
            + F.log(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x - F.col(top)))),
        )
        .drop(scaled, top)
    )


def log_prob(logits: Column, log_sum_exp: Column, label: Column) -> Column:
    """ln softmax(logits)[label], label counted from 0; null outside the array."""
    return F.get(doubles(logits), label) - log_sum_exp


def softmax(logits: Column, log_sum_exp: Column) -> Column:
    return F.transform(doubles(logits), lambda x: F.exp(x - log_sum_exp))


def min_max(low: Column, high: Column, arr: Column) -> Column:
    """(x - low) / (high - low); null elements for a constant row."""
    return F.transform(doubles(arr), lambda x: F.try_divide(x - low, high - low))


def kl(teacher: Column, teacher_lse: Column, student: Column, student_lse: Column, temperature: float = 1.0) -> Column:
    """sum(p * (ln p - ln q)) of one position."""
    terms = F.zip_with(
        doubles(teacher),
        doubles(student),
        lambda t, s: F.exp(t / temperature - teacher_lse)
        * ((t / temperature - teacher_lse) - (s / temperature - student_lse)),
    )
    return sum_of(terms)


def squared_gap(teacher: Column, student: Column) -> Column:
    return sum_of(
        F.zip_with(doubles(teacher), doubles(student), lambda t, s: (t - s) * (t - s))
    )
