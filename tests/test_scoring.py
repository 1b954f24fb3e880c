"""Losses, perplexity, context accounting and vectors against numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import tokens as tk
from foliant.operators import context, parameters, samples, scoring, vocabulary
from foliant.plans import planners, reports

RNG = np.random.default_rng(0)
LOGITS = RNG.normal(size=(12, 5)) * 3
OTHER = RNG.normal(size=(12, 5)) * 3
LABELS = [int(x) for x in RNG.integers(0, 5, 12)]


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


NLL = [-math.log(softmax(LOGITS)[i][y]) for i, y in enumerate(LABELS)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (i // 4, i % 4, LOGITS[i].tolist(), OTHER[i].tolist(), LABELS[i], int(i % 4 != 0))
        for i in range(12)
    ]
    return spark.createDataFrame(
        rows,
        "sample_id bigint, pos int, logits array<double>, student array<double>, label int, mask int",
    )


def test_nll_and_softmax(table):
    rows = scoring.with_softmax(scoring.with_nll(table)).orderBy("sample_id", "pos").collect()
    assert np.allclose([r.nll for r in rows], NLL)
    assert np.allclose([r.probs for r in rows], softmax(LOGITS))
    ignored = scoring.with_nll(table.withColumn("label", F.lit(-100))).collect()
    assert {r.nll for r in ignored} == {0.0}


def test_shifted_pairs(table):
    rows = scoring.with_nll(scoring.shifted(table, "sample_id")).collect()
    assert len(rows) == 9
    for r in rows:
        i = r.sample_id * 4 + r.pos
        assert math.isclose(r.nll, -math.log(softmax(LOGITS)[i][LABELS[i + 1]]))


def test_min_max(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([2.0, 2.0],)], "v array<double>")
    assert [r.scaled for r in scoring.with_min_max(df, "v").collect()] == [[0, 1], [None, None]]


def losses(spark, nll, mask, labels=None):
    rows = [(1, i, float(x), m, (labels or [0] * 9)[i]) for i, (x, m) in enumerate(zip(nll, mask))]
    return spark.createDataFrame(rows, "s bigint, pos int, nll double, mask int, label int")


def test_prefix_masked_ce(spark):
    df = losses(spark, [1, 2, 3, 4], [0, 1, 0, 1])
    assert scoring.prefix_masked_ce(df, ["s"]).first().loss == 4.5
    assert scoring.prefix_masked_ce(losses(spark, [1, 2], [0, 0]), ["s"]).first().loss is None


def test_ignore_index_ce(spark):
    df = losses(spark, [1, 2, 3], [1, 1, 1], [0, -100, 4])
    rows = {r.s: r for r in scoring.ignore_index_ce(df, "s").collect()}
    assert rows[1].loss == rows[None].loss == 2.0 and rows[1].valid == 2
    none = scoring.ignore_index_ce(losses(spark, [1, 2], [1, 1], [-100, -100]), "s").collect()
    assert {(r.s, r.loss, r.valid) for r in none} == {(1, 0.0, 0), (None, 0.0, 0)}


def test_kl_and_mse(table):
    t, s = softmax(LOGITS / 2), softmax(OTHER / 2)
    kl = (t * (np.log(t) - np.log(s))).sum(-1).reshape(3, 4)[:, 1:].mean(-1)
    got = scoring.kl_masked(table.withColumnRenamed("logits", "teacher"), ["sample_id"], temperature=2.0)
    assert np.allclose([r.kl for r in got.orderBy("sample_id").collect()], kl)
    sq = ((LOGITS - OTHER) ** 2).reshape(3, 4, 5)[:, 1:].sum((1, 2)) / 20
    got = scoring.mse_masked(table.withColumnRenamed("logits", "teacher"), ["sample_id"])
    assert np.allclose([r.mse for r in got.orderBy("sample_id").collect()], sq)


def test_criterion_names():
    assert scoring.criterion("MSE") is scoring.mse_masked
    with pytest.raises(ValueError):
        scoring.criterion("huber")


def test_sample_perplexity(spark):
    rows = [(1, 0, [-1.0, -2.0]), (1, 1, [-3.0]), (2, 0, [])]
    df = spark.createDataFrame(rows, "sample_id bigint, seq int, logprobs array<double>")
    got = scoring.sample_perplexity(df).collect()
    assert len(got) == 1 and math.isclose(got[0].perplexity, math.exp(2))


DOCS = ["a b a b a b c", "a b c d", "b", "", "c c c c c c c c a b"]


def bigram_reference(chunk, truncation):
    docs = [["<s>", *d.split()] for d in DOCS]
    cut = lambda ws: [ws[i : i + chunk] for i in range(0, len(ws), chunk)]
    pairs = lambda ws: [p for c in cut(ws) for p in zip(c, c[1:])]
    every = [p for d in docs for p in pairs(d)]
    n2, n1 = Counter(every), Counter(a for a, _ in every)
    v = len({t for p in every for t in p})
    out = {}
    for i, d in enumerate(docs):
        ps = pairs(d[:truncation])
        if ps:
            lps = [math.log((n2[p] + 1) / (n1[p[0]] + v)) for p in ps]
            out[i] = math.exp(-sum(lps) / len(lps))
    return out


@pytest.mark.parametrize("hot_share", [10_000, 2, 0])
def test_bigram_perplexity(spark, monkeypatch, hot_share):
    """All bigrams hot, some hot and none hot give the same scores."""
    monkeypatch.setattr(scoring, "HOT_SHARE", hot_share)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "row_id bigint, text string")
    got = reports.perplexity_samples(docs, [3, 6, None], C.Chunks(4, 2)).collect()
    for truncation in (3, 6, None):
        mine = {r.sample_id: r.perplexity for r in got if r.truncation == truncation}
        expected = bigram_reference(4, truncation)
        assert mine.keys() == expected.keys()
        assert all(math.isclose(mine[i], expected[i]) for i in mine)


def test_report_over_first_instances(spark):
    docs = spark.createDataFrame(
        [(i * 10, d) for i, d in enumerate(DOCS)], "row_id bigint, text string"
    )
    expected = bigram_reference(4, None)
    for tasks in (
        [C.Task(C.PERPLEXITY, "d", 2, None)],
        [C.Task(C.PERPLEXITY, "d", 2, None), C.Task(C.PERPLEXITY, "d", None, 3)],
    ):
        rows = reports.perplexity_report({"d": docs}, tasks, C.Chunks(4, 2)).orderBy("task_id").collect()
        assert rows[0].samples == 2
        assert math.isclose(rows[0]["max"], max(expected[0], expected[1]))
    assert rows[1].samples == len(bigram_reference(4, 3))
    with pytest.raises(ValueError):
        reports.perplexity_report({"d": docs}, [C.Task("copy", "d", 1, None)])


@pytest.mark.parametrize("cuts", [(None,), (3, 6, None), (1, 2, 5, None)])
@pytest.mark.parametrize("n", [1, 4])
def test_pairs_and_their_bands(spark, cuts, n):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(4) for _ in range(rng.randrange(30))]) for i in range(40)] + [(90, []), (91, [7]), (92, None)]
    df = spark.createDataFrame(rows, "sample_id bigint, input_ids array<int>")
    expected = Counter()
    for i, ids in rows:
        for p in range(1, len(ids or [])):
            if p % n:
                band = next(b for b, c in enumerate(cuts) if c is None or p < c)
                expected[i, band, ids[p - 1], ids[p]] += 1
    got = scoring.token_pairs(df, n, cuts).collect()
    assert Counter(tuple(r) for r in got if r.prev is not None) == expected
    # A sample without pairs keeps a row.
    assert {r.sample_id for r in got} == {i for i, _ in rows}


@pytest.mark.parametrize("n", [1, 4])
@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_pairs_are_counted_as_token_pairs_finds_them(spark, monkeypatch, n, kind):
    """Several turns and buckets, negative ids, null ids beside them, and arrays without pairs."""
    monkeypatch.setattr(scoring, "COMBINED", 50)
    monkeypatch.setattr(scoring, "BUCKET", 40)
    rng = random.Random(4)
    ids = [-2, 0, 3, 2**31 - 1, -(2**31)]
    rows = [(i, [rng.choice(ids) for _ in range(rng.randrange(40))]) for i in range(60)] + [(90, []), (91, [7]), (92, None)]
    for holes in ([], [(93, [0, None, 3, 3, 3, 0]), (94, [None])]):
        df = spark.createDataFrame(rows + holes, f"sample_id bigint, input_ids array<{kind}>").repartition(3)
        expected = Counter((r.prev, r.tok) for r in scoring.token_pairs(df, n).collect() if r.prev is not None)
        got = scoring.count_pairs(df, n).collect()
        assert {(r.prev, r.tok): r.n for r in got} == expected and len(got) == len(expected)


def test_no_struct_is_made_per_pair(spark):
    df = spark.createDataFrame([(1, [1, 2])], "sample_id bigint, input_ids array<int>")
    plan = scoring.token_pairs(df, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan


def test_unscored_samples_are_counted(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, ""), (2, None), (3, "b c")], "row_id bigint, text string")
    tasks = [C.Task(C.PERPLEXITY, "d", None, None), C.Task(C.PERPLEXITY, "d", 2, 1), C.Task(C.PERPLEXITY, "d", 3, 2)]
    rows = reports.perplexity_report({"d": docs}, tasks, C.Chunks(4, 2)).orderBy("task_id").collect()
    assert [(r.samples, r.unscored) for r in rows] == [(2, 2), (0, 2), (1, 2)]
    assert rows[1].avg is None and rows[0].avg > 0


@pytest.mark.parametrize("other", [5, None])
def test_a_short_corpus_is_an_error_beside_any_task(spark, other):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "row_id bigint, text string")
    tasks = [C.Task(C.PERPLEXITY, "d", 2_000_000, None), C.Task(C.PERPLEXITY, "d", other, 3)]
    with pytest.raises(ValueError, match="required"):
        reports.perplexity_report({"d": docs}, tasks, C.Chunks(4, 2))


def test_one_tokenization_serves_fit_and_score(spark, monkeypatch):
    made = []
    monkeypatch.setattr(reports.tk, "tokenize", lambda *a, f=tk.tokenize: made.append(1) or f(*a))
    docs = spark.createDataFrame(list(enumerate(DOCS)), "row_id bigint, text string")
    plan = reports.perplexity_samples(docs, [3, None], C.Chunks(4, 2))._jdf.queryExecution().executedPlan()
    assert len(made) == 1 and "regexp" not in plan.toString().lower()


def test_vocabulary(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "row_id bigint, text string")
    vocab = vocabulary.build_vocabulary(docs, size=2)
    assert [(r.word, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("c", 4), ("b", 5)]
    docs = docs.unionByName(spark.createDataFrame([(99, None)], "row_id bigint, text string"))
    got = vocabulary.encode_with_vocabulary(docs, vocab)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    ids = {r.row_id: r.input_ids for r in got.collect()}
    big = vocabulary.encode_with_vocabulary(docs, vocab, most=1)
    assert ids == {r.row_id: r.input_ids for r in big.collect()}
    assert ids[1] == [3, 5, 4, 3] and ids[3] == [] and ids[99] == []


# --- context ---------------------------------------------------------------


def arrivals(spark, sizes, key=1):
    rows = [(key, t, list(range(sum(sizes[:t]), sum(sizes[: t + 1])))) for t in range(len(sizes))]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, input_ids array<int>").withColumn(
        "n_tokens", F.size("input_ids")
    )


def test_buffer_fixture(spark):
    df = arrivals(spark, [50, 30, 60]).select("conv_id", "turn", "n_tokens")
    rows = context.context_state(df, C.Chunks(64, 2)).orderBy("turn").collect()
    assert [r.chunks_done for r in rows] == [0, 1, 2]
    assert [r["tail"] for r in rows] == [50, 16, 12]


@pytest.mark.parametrize("shifts", [(14,), (1, 2)])
def test_emitted_chunks(spark, shifts):
    sizes = [5, 0, 17, 1, 1, 30, 2]
    got = context.emitted_chunks(arrivals(spark, sizes), 8, shifts=shifts).orderBy("chunk_id").collect()
    assert [r.input_ids for r in got] == [list(range(i, i + 8)) for i in range(0, 56, 8)]


# --- vectors ---------------------------------------------------------------


def test_mix_vectors(spark):
    rows = [("m1", "a", [1.0, 2.0], 0.25), ("m2", "a", [5.0, 6.0], 0.75)]
    df = spark.createDataFrame(rows, "model string, name string, v array<double>, w double")
    even = parameters.assemble(parameters.mix_vectors(df, "name", "v"), "name")
    assert even.first().vector == [3.0, 4.0]
    assert parameters.assemble(parameters.mix_vectors(df, "name", "v", "w"), "name").first().vector == [4.0, 5.0]
    assert parameters.mix_vectors(df, "name", "v", "w", model="model").count() == 2
    for wrong in (F.lit(None).cast("double"), F.col("w") + F.size("v") * F.rand(1)):
        several = df.unionByName(df.withColumn("name", F.lit("b"))).withColumn("w", wrong)
        with pytest.raises(ValueError, match="weight"):
            parameters.mix_vectors(several, "name", "v", "w", model="model")
    parameters.check_mix(df, "model", "name", [0.5, 0.5])
    with pytest.raises(ValueError):
        parameters.check_mix(df, "model", "name", [1.0])
    odd = df.unionByName(df.filter("model = 'm1'").withColumn("name", F.lit("b")))
    with pytest.raises(ValueError):
        parameters.check_mix(odd, "model", "name", None)


def test_norm_report(spark):
    rows = [(1, [3.0, 4.0], [0.0, 1.0]), (1, [0.0, 2.0], None)]
    df = spark.createDataFrame(rows, "step int, param array<double>, grad array<double>")
    r = parameters.norm_report(df, "step").first()
    assert (r.avg_norm, r.max_norm) == (0.5, 1.0)
    assert math.isclose(r.max_ratio, 1 / (5 + 1e-6))


def test_plans_take_another_tokenizer(spark):
    docs = spark.createDataFrame([(1, "a bb ccc dddd"), (2, "x")], "row_id bigint, text string")
    encoder = scoring.text_encoder(lambda: lambda t: [len(w) + 10 for w in t.split()])
    tokens = C.Tokens(encoder=encoder)
    rows = planners.lm_plan(docs, C.Chunks(3, 1), tokens).orderBy("sample_id", "seq").collect()
    assert [r.input_ids for r in rows] == [[1, 11, 12], [13, 14], [1, 11]]
    got = reports.perplexity_samples(docs, [None], C.Chunks(3, 1), tokens)
    assert {r.sample_id: r.scored_tokens for r in got.collect()} == {1: 3, 2: 1}
    pairs = spark.createDataFrame([(1, "a", "b")], "row_id bigint, input string, output string")
    with pytest.raises(ValueError):
        samples.sft_samples(pairs, tokens)


def test_seams(spark):
    docs = spark.createDataFrame([(1, "a bb"), (2, None)], "row_id bigint, text string")
    made = scoring.tokenize_with(docs, lambda: lambda t: [len(w) for w in t.split()])
    assert {r.row_id: r.input_ids for r in made.collect()} == {1: [1, 2], 2: None}
    chunks = spark.createDataFrame([(1, 0, [5, 6, 7])], "sample_id bigint, seq int, input_ids array<int>")
    scored = scoring.score_chunks_with(chunks, lambda: lambda cs: [[-float(x) for x in c[1:]] for c in cs])
    assert scored.first().logprobs == [-6.0, -7.0]
