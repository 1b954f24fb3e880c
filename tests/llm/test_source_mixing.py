import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import source_mixing as op

DOCS = "doc_id bigint, text string, source string"


def level(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {}, list(names), float(sum(sizes.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= most * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            rest -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 5, "b": 1, "c": 1000, "d": 2, None: 30},
        {"a": 0, "b": 10, None: 0},
        {"é": 7, "z": 700, "Z": 3, "": 50, "aa": 41},
        {"only": 12},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in op.targets(df).collect()}
    expected = level(sizes)
    assert got.keys() == expected.keys()
    assert all(got[s] == pytest.approx(expected[s]) for s in got)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def pmf(n, k, d):
    whole = math.comb(n, d)
    return {x: math.comb(k, x) * math.comb(n - k, d - x) / whole for x in range(max(0, d + k - n), min(k, d) + 1)}


@pytest.mark.parametrize("n,k,d", [(50, 20, 25), (10, 1, 5), (7, 7, 3), (400, 399, 200), (1, 1, 0), (0, 0, 0)])
def test_hypergeometric_inverts_the_distribution(spark, n, k, d):
    draws = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    ints = [F.lit(v).cast("bigint") for v in (n, k, d)]
    got = Counter(r[0] for r in draws.select(op.hypergeometric(*ints, F.col("u"))).collect())
    for x, p in pmf(n, k, d).items():
        assert got[x] / 2000 == pytest.approx(p, abs=1.01 / 2000)


def test_hypergeometric_of_many(spark):
    n, k, d = (F.lit(v).cast("bigint") for v in (65_536, 20_000, 32_768))
    x = spark.range(400).select(op.hypergeometric(n, k, d, (F.col("id") + 0.5) / 400).alias("x"))
    mean, spread = x.agg(F.avg("x"), F.stddev("x")).first()
    assert mean == pytest.approx(10_000, abs=1)
    assert spread == pytest.approx(math.sqrt(32_768 * 20_000 / 65_536 * (1 - 20_000 / 65_536) * 32_768 / 65_535), rel=0.03)


@pytest.mark.parametrize("shards", [1, 7, 32])
def test_tree_splits_exactly(spark, shards):
    quotas = [500, 0, 3, 1200, 77]
    df = spark.createDataFrame(list(enumerate(quotas)), "number int, blocks bigint")
    rows = op.splitting_tree(df, shards).collect()
    assert len(rows) == shards * len(quotas)
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["blocks"] >= 0
        by_source[r["number"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert [by_source[k] for k in range(5)] == quotas
    assert set(by_shard) == set(range(shards))
    assert max(by_shard.values()) - min(by_shard.values()) <= math.ceil(math.log2(shards)) or shards == 1


def test_blocks_are_disjoint(spark):
    sources = spark.createDataFrame([(0, 1000), (1, 0), (2, 37)], "number int, quota bigint")
    rows = op.block_plan(sources, 10, shards=4).collect()
    assert sorted((r["number"], r["block"]) for r in rows) == [(0, b) for b in range(100)] + [(2, b) for b in range(4)]
    assert {(r["number"], r["place"]) for r in rows} == {(0, b) for b in range(100)} | {(2, b) for b in range(4)}
    shard = {(r["number"], r["place"]): r["shard"] for r in rows}
    assert [shard[0, p] for p in range(100)] == sorted(shard[0, p] for p in range(100))


def make(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def corpus():
    rows = [(k, "word " * (1 + k * 7 % 40), "hot" if k % 3 else f"s{k % 5}") for k in range(600)]
    return [*rows, (1000, "one big " * 3000, "zz"), (1001, "tail", "zz")]


def test_every_source_meets_its_target(spark):
    rows = corpus()
    got = op.mix(make(spark, rows)).select("*", op.taken_words().alias("taken")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    size = {i: len(t.split()) for i, t, _ in rows}
    own, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        own[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert [d["turn"] for d in r["draws"]] == list(range(len(r["draws"])))
    expected = level(dict(own))
    for s in own:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 0.5
    # Repetitions are whole turns: no document is read twice more than another of its source.
    for s in own:
        counts = {len(r["draws"]) for r in got if r["source"] == s}
        assert max(counts) - min(counts) <= 1


def test_reruns_agree_however_dealt(spark):
    df = make(spark, corpus())
    one, two = (sorted(map(str, op.mix(x, shards=3).collect())) for x in (df.coalesce(1), df.repartition(9)))
    assert one == two


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, "x y", None), (3, "k l m", "a"), (3, "k l m", "a"),
            (4, "w " * 200_000, "b"), (5, " \t\n", None)]
    df = make(spark, rows)
    for name in ("number", "size", "draws", "bucket", "target"):
        df = df.withColumn(name, F.lit("x"))
    got = op.mix(df, shards=2).select("*", op.taken_words().alias("taken")).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    by = defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
    expected = level({"a": 6, "b": 200_000, None: 4})
    assert all(abs(by[s] - expected[s]) <= 0.5 for s in by)
    assert op.mix(df.limit(0), shards=2).collect() == []
    assert [r["draws"] for r in op.mix(make(spark, [(1, None, None)]), shards=2).collect()] == [[]]


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        op.mix(make(spark, [(k, "x", str(k)) for k in range(3)]))


def test_written_shards(spark, tmp_path):
    df = make(spark, corpus())
    mixed = op.mix(df, shards=3)
    op.write_shards(df, mixed, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    drawn = mixed.select("doc_id", F.inline("draws"))
    assert Counter(map(tuple, back.select("doc_id", "turn", "words", "shard").collect())) == Counter(
        map(tuple, drawn.select("doc_id", "turn", "words", "shard").collect())
    )
    text = {i: t for i, t, _ in corpus()}
    assert all(r["text"] == text[r["doc_id"]] for r in back.collect())


def test_no_python_in_the_plan(spark):
    plan = op.mix(make(spark, corpus()), shards=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
