"""Mixtures, samples, distractors and reservoirs against plain Python."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant import config as C
from foliant.operators import collate, mixing, samples
from foliant.plans import feed


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def corpus(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.col("id").alias("row_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    )


MIX = [C.MixEntry("a", 0.5, 10), C.MixEntry("b", 0.5)]


def test_mixture(spark):
    corpora = {"a": corpus(spark, 80), "b": corpus(spark, 90, 1000)}
    rows = mixing.mixture_feed(corpora, MIX, 100, seed=3).collect()
    assert sorted(r.step for r in rows) == list(range(100))
    assert len({(r.name, r.row_id) for r in rows}) == 100
    share = sum(r.name == "a" for r in rows)
    assert 30 < share < 70
    for r in rows:
        assert (r.row_id >= 1000) == (r.name == "b")
        assert (draw("step", r.step, 3) / 2**32 < 0.5) == (r.name == "a")
        assert r.truncation == (10 if r.name == "a" else None)


def test_mixture_of_one_and_exhaustion(spark):
    whole = mixing.mixture_feed({"a": corpus(spark, 5)}, [C.MixEntry("a", 1.0)], 5)
    assert sorted(r.row_id for r in whole.collect()) == list(range(5))
    with pytest.raises(PySparkException, match="exhausted"):
        mixing.mixture_feed({"a": corpus(spark, 5)}, [C.MixEntry("a", 1.0)], 6).collect()


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        mixing.mixture_draws(spark, ["a", "b"], [0.5, 0.4], 10)


def test_exact_sample_per_source(spark):
    df = corpus(spark, 300).withColumn(
        "source", F.when(F.col("row_id") < 200, "hot").otherwise(F.col("row_id").cast("string"))
    )
    got = samples.sample_per_source(df, 17)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert counts.pop("hot") == 17 and set(counts.values()) == {1} and len(counts) == 100
    expected = sorted(range(200), key=lambda i: hashlib.md5(f"hot|{i}|42".encode()).hexdigest())
    kept = {r.row_id for r in got.filter("source = 'hot'").collect()}
    assert kept == set(expected[:17])


def reservoir(doc, n, k, seed):
    """The reservoir loop, with the same draws."""
    slots, released = [], {}
    for c in range(n):
        if c < k:
            slots.append(c)
            continue
        j = draw(doc, c, seed, "slot") % (c + 1)
        if j < k:
            released[slots[j]] = c
            slots[j] = c
        else:
            released[c] = c
    kept = [c for c in slots if c != n - 1]
    return kept[::-1], released


@pytest.mark.parametrize("k", [1, 2, 5])
def test_reservoir_is_the_loop(spark, k):
    sizes = {doc: doc for doc in range(1, 40)}
    df = spark.createDataFrame([*sizes.items(), (99, 0), (100, None)], "sample_id bigint, n int")
    got = {}
    for r in mixing.chunk_reservoir(df, F.col("n"), k, seed=5).collect():
        got.setdefault(r.sample_id, []).append(r)
    assert set(got) == set(sizes)
    for doc, n in sizes.items():
        kept, released = reservoir(doc, n, k, 5)
        mine = got[doc]
        visits = sorted((r.visit, r.seq) for r in mine if r.outcome == "kept")
        assert [c for _, c in visits] == kept
        assert {r.seq: r.released_at for r in mine if r.released_at is not None} == released
        assert [r.outcome for r in mine if r.seq == n - 1] == ["last"]


def test_reservoir_is_uniform(spark):
    rows = spark.range(2000).withColumnRenamed("id", "sample_id")
    fates = mixing.chunk_reservoir(rows, F.lit(10), 3)
    assert "Exchange" not in fates._jdf.queryExecution().executedPlan().toString()
    kept = fates.filter(F.col("slot").isNotNull() & F.col("released_at").isNull())
    counts = [r["count"] for r in kept.groupBy("seq").count().collect()]
    assert len(counts) == 10 and all(500 < c < 700 for c in counts)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_distractor_by_position(spark, n):
    books = corpus(spark, n, 50)
    rows = mixing.distractor_by_position(corpus(spark, 25).select("row_id"), books).collect()
    assert {r.row_id: r.disturb for r in rows} == {i: f"text {50 + i % n}" for i in range(25)}


def test_random_distractor_qualifies(spark):
    books = corpus(spark, 30, 85)
    rows = mixing.distractor_at_random(
        corpus(spark, 200).select("row_id"), books, min_chars=8, cap=8, seed=1
    ).collect()
    assert len(rows) == 200
    assert {r.disturb for r in rows} == {f"text {i}" for i in range(100, 115)}


def test_first_rows(spark):
    df = corpus(spark, 20).repartition(5)
    assert [r.row_id for r in mixing.first_rows(df, 3).collect()] == [0, 1, 2]
    assert mixing.first_rows(df, 30).count() == 20
    with pytest.raises(ValueError):
        mixing.first_rows(df, 30, require=True)


def test_training_feed(spark):
    corpora = {
        "a": samples.lm_rows(corpus(spark, 30)),
        "b": samples.lm_rows(corpus(spark, 30), tag=C.PERPLEXITY),
    }
    tags = {"a": (C.LANGUAGE_MODELING,), "b": (C.PERPLEXITY,)}
    rows = feed.training_feed(corpora, MIX, 20, tags, C.Chunks(2, 1)).collect()
    assert {r.step for r in rows} == set(range(20))
    assert {r.outcome for r in rows} >= {"kept", "last"}


# --- batches ---------------------------------------------------------------


def test_collate(spark):
    rows = [(1, [1, 2, 3], "x"), (2, [4], "y")]
    df = spark.createDataFrame(rows, "row_id bigint, input_ids array<int>, name string").withColumns(
        {"labels": F.col("input_ids"), "attention_mask": F.transform("input_ids", lambda x: F.lit(1))}
    )
    out = {r.row_id: r for r in collate.collate(df, 2, add_position_ids=True).collect()}
    assert out[2].input_ids == [4, 0, 0] and out[2].labels == [4, -100, -100]
    assert out[2].attention_mask == [1, 0, 0] and out[2].position_ids == [0, 0, 0]
    assert out[1].position_ids == [0, 1, 2] and out[1].name == "x"
    left = {r.row_id: r for r in collate.collate(df, 2, side="left", add_position_ids=True).collect()}
    assert left[2].input_ids == [0, 0, 4] and left[2].position_ids == [0, 0, 0]
    batch = collate.stack_batches(collate.collate(df, 2), ["input_ids"]).collect()
    assert len(batch) == 1 and sorted(batch[0].input_ids) == [[1, 2, 3], [4, 0, 0]]


def test_fills_go_by_what_a_name_contains(spark):
    names = {"label_ids": -100, "my_labels": -100, "label_attention_mask": 0, "attention_mask_2": 0, "ids": 9, "odd": 5}
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "row_id bigint, a array<int>")
    df = df.select("row_id", *[F.col("a").alias(n) for n in names])
    rows = {r.row_id: r for r in collate.collate(df, 2, pad=9, fills={"odd": 5}).collect()}
    assert {n: rows[2][n] for n in names} == {n: [4, v, v] for n, v in names.items()}


def test_nested_lists(spark):
    """Every innermost list of a batch gets the length of its longest one."""
    rows = [(1, [[1, 2, 3], []], ["a"], [[[1]], [[2, 3], []]]), (2, [[4]], ["b", "c"], []), (3, [], [], [[[5, 6, 7]]])]
    df = spark.createDataFrame(rows, "row_id bigint, x array<array<int>>, names array<string>, y array<array<array<int>>>")
    df = df.withColumn("x_attention_mask", F.transform("x", lambda a: F.transform(a, lambda v: F.lit(1))))
    right = {r.row_id: r for r in collate.collate(df, 3, add_position_ids=True).collect()}
    assert right[1].x == [[1, 2, 3], [0, 0, 0]] and right[2].x == [[4, 0, 0]] and right[3].x == []
    assert right[1].y == [[[1, 0, 0]], [[2, 3, 0], [0, 0, 0]]] and right[3].y == [[[5, 6, 7]]]
    assert right[2].names == ["b", "c"]
    assert right[1].x_position_ids == [[0, 1, 2], [0, 0, 0]]
    left = {r.row_id: r for r in collate.collate(df, 3, side="left", add_position_ids=True).collect()}
    assert left[2].x == [[0, 0, 4]] and left[2].x_position_ids == [[0, 0, 0]]


def test_holes_in_nested_masks(spark):
    df = spark.createDataFrame([(1, [[1, 0, 1, 1], [0, 1]])], "row_id bigint, attention_mask array<array<int>>")
    assert collate.collate(df, 1, add_position_ids=True).first().position_ids == [[0, 0, 1, 2], [0, 0, 0, 0]]


@pytest.mark.parametrize(
    "mask, expected",
    [
        ([1, 0, 1, 1, 0, 1], [0, 0, 1, 2, 0, 3]),
        ([0, 1, 1], [0, 0, 1]),
        ([0, 0], [0, 0]),
        ([], []),
    ],
)
def test_position_ids(spark, mask, expected):
    df = spark.createDataFrame([(mask,)], "m array<int>")
    assert collate.with_position_ids(df, "m").first().position_ids == expected
