import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives as op

TABLE = "vec_id bigint, embedding array<double>, label int"


def brute(rows, anchors, positives=5, negatives=5):
    """All pairs, by the words of the contract, on rows with different ids."""
    fit = [
        (i, [math.floor(256 * x) for x in v], y)
        for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, va, ya in fit:
        if a is None or not anchors(a):
            continue
        scored = [
            (-sum(x * y for x, y in zip(va, v, strict=True)), i is None, i or 0, i, y)
            for i, v, y in fit
            if i != a and len(v) == len(va)
        ]
        scored.sort(key=lambda r: r[:3])
        own = [r for r in scored if r[4] == ya][:positives]
        for p in own:
            within = [r for r in scored if r[4] != ya and -80 * p[0] <= -100 * r[0] <= -100 * p[0]]
            out += [(a, p[3], k + 1, r[3], -p[0], -r[0]) for k, r in enumerate(within[:negatives])]
    return sorted(out, key=str)


def mined(spark, rows, anchors, **options):
    vectors = op.whole_vectors(spark.createDataFrame(rows, TABLE))
    return sorted(map(tuple, op.mine(vectors, anchors, **options).collect()), key=str)


def vectors(seed, n, d=24, labels=3, near=0.3):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, d)) / math.sqrt(d)
    for k in range(n // 2, n):
        made[k] = made[k - n // 2] + rng.normal(size=d) * near / math.sqrt(d)
    return [(k, [float(x) for x in made[k]], int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("near", [0.05, 1.0])
def test_as_brute_force(spark, near):
    rows = vectors(3, 300, near=near)
    expected = brute(rows, lambda i: i % 10 == 0)
    assert expected
    assert mined(spark, rows, F.col("id") % 10 == 0) == expected


def test_same_however_cut(spark):
    rows = vectors(4, 200)
    assert mined(spark, rows, F.col("id") % 9 == 0, block=500) == mined(spark, rows, F.col("id") % 9 == 0)


def test_hot_label_ties_and_copies(spark):
    rng = random.Random(2)
    rows = [(k, [float(rng.randrange(3)), 1.0, float(rng.randrange(2))], 0 if k % 3 else rng.randrange(4)) for k in range(250)]
    assert mined(spark, rows, F.col("id") % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.9, 0.4], 2), (3, None, 1), (4, [1.0, 1.0], None),
        (5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, [inf, 1.0], 1), (8, [1.0], 2), (9, [], 1), (10, [], 1),
        (11, [], 2), (12, [-1.0, -0.5], 1), (None, [0.9, 0.4], 2), (20, [0.0, 0.0], 2), (13, [2.0, 0.1, 0.0], 3),
    ]
    got = mined(spark, rows, F.col("id").isin(0, 2, 8, 10, 12, 20))
    assert got == brute(rows, lambda i: i in (0, 2, 8, 10, 12, 20))
    assert (10, 9, 1, 11, 0, 0) in got
    # A squared length of 4e18 and more takes no part.
    assert mined(spark, [(0, [9e8], 1), (1, [1.0], 1), (2, [1.0], 2)], F.col("id") == 0) == []
    assert mined(spark, [(0, [1e300], 1), (1, [1.0], 1)], F.lit(True)) == []
    assert mined(spark, [], F.lit(True)) == []


def test_repeated_rows_and_extra_columns(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (2, [0.9], 2)]
    df = spark.createDataFrame(rows, TABLE)
    for name in ("id", "score", "block", "twin", "k", "positive_id"):
        df = df.withColumn(name, F.lit("x"))
    got = op.mine(op.whole_vectors(df), F.col("id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 58880)]


def test_large_scores_are_exact(spark):
    rows = [(k, [float(3_000_000 + k), float(5_000_000 - k), 1.0 / 256 * k], k % 2) for k in range(40)]
    assert mined(spark, rows, F.col("id") < 3) == brute(rows, lambda i: i < 3)


@pytest.mark.parametrize("width", [0, 1, 16, 17, 64])
@pytest.mark.parametrize("share", [-1.0, 0.0, 0.3, 0.7, 1.0])
def test_index_finds_all_pairs(width, share):
    rng = np.random.default_rng(width)
    rows = (rng.normal(size=(150, width)) * 40).astype(np.int64)
    asks = rows[:30] + rng.integers(-2, 3, size=(30, width))
    index = op.Index(rows, np.arange(150), np.zeros(150, bool), np.zeros(150, int))
    scores = asks @ rows.T
    least = np.floor(scores.max(axis=1, initial=0) * share).astype(np.int64)
    i, j, s = index.search(asks, least)
    assert sorted(map(list, zip(i.tolist(), j.tolist(), strict=True))) == np.argwhere(scores >= least[:, None]).tolist()
    assert (scores[i, j] == s).all()


def test_index_leaves_out_dimensions():
    """With a high threshold most dimensions of weak rows are not indexed, and nothing is lost."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([np.eye(64, dtype=np.int64)[:50] * 3, (rng.normal(size=(50, 64)) * 40).astype(np.int64)])
    asks = rows[60:70]
    index = op.Index(rows, np.arange(100), np.zeros(100, bool), np.zeros(100, int))
    least = (asks**2).sum(axis=1) // 2
    i, j, _ = index.search(asks, least)
    assert sorted(map(list, zip(i.tolist(), j.tolist(), strict=True))) == np.argwhere(asks @ rows.T >= least[:, None]).tolist()
