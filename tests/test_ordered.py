"""Numbering and running totals against plain Python, with tiny blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import ordered


def rows_of(seed, keys=("hot", "b", "c"), n=600):
    """Sparse unique ids; the key ``hot`` holds most rows."""
    rng = random.Random(seed)
    ids = rng.sample(range(5000), n)
    return [(keys[0] if rng.random() < 0.7 else rng.choice(keys), i, rng.randint(0, 9)) for i in ids]


SCHEMA = "key string, id bigint, x int"


@pytest.mark.parametrize("shifts", [(14,), (2, 4), (1, 3, 6), (16, 40)])
@pytest.mark.parametrize("payload", [False, True])
def test_running_sums(spark, shifts, payload):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if payload:
        df = df.withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    got = ordered.running_sums(df, "id", {"s": F.col("x"), "n": F.lit(1)}, ["key"], shifts)
    made = {(r.key, r.id): (r.s, r.n) for r in got.collect()}
    expected, sums = {}, {}
    for k, i, x in sorted(rows):
        s, n = sums.get(k, (0, 0))
        sums[k] = expected[(k, i)] = (s + x, n + 1)
    assert made == expected
    assert got.columns[: len(df.columns)] == df.columns


@pytest.mark.parametrize("shifts", [(16, 40), (3, 5)])
def test_id_positions_are_dense(spark, shifts):
    df = spark.createDataFrame(rows_of(2), SCHEMA)
    made = {r.id: r.pos for r in ordered.id_positions(df, "id", shifts=shifts).collect()}
    assert made == {i: p for p, i in enumerate(sorted(made))}


def digest(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 8])
def test_shuffled_positions_ignore_partitioning(spark, partitions):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = ordered.shuffled_positions(df, "id", 42, ["key"]).collect()
    order = {}
    for k, i, _ in sorted(rows, key=lambda r: digest(r[0], r[1], 42)):
        order.setdefault(k, []).append(i)
    assert {(r.key, r.id): r.pos for r in got} == {
        (k, i): p for k, ids in order.items() for p, i in enumerate(ids)
    }


@pytest.mark.parametrize("known", [None, 3])
def test_first_positions(spark, known):
    rows = rows_of(4)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = ordered.shuffled_positions(df, "id", 1, ["key"]).filter("pos < 20")
    first = ordered.shuffled_positions(df, "id", 1, ["key"], first=20, known_keys=known)
    assert sorted(first.collect()) == sorted(whole.collect())
    assert first.groupBy("key").count().filter("count != 20").count() == 0


def test_numbers_alone_are_read_once(spark, tmp_path):
    spark.createDataFrame(rows_of(5), SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("key", "id", "x")
    got = ordered.running_sums(df, "id", {"s": F.col("x")}, ["key"])
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
