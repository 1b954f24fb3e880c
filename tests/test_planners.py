"""Samples and chunk plans on hand-worked rows."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant import config as C, workloads
from foliant.functions import tokens as tk
from foliant.operators import samples
from foliant.plans import planners

SMALL = C.Chunks(4, 2)


def text(n):
    return " ".join(f"w{i}" for i in range(n))


def one(spark, **values):
    row = spark.range(1).select(F.lit(7).cast("bigint").alias("row_id"))
    return row.withColumns({k: F.lit(v) for k, v in values.items()})


def collected(plan):
    return plan.orderBy("sample_id", "seq").collect()


def ids_of(spark, value, bos=True):
    return spark.range(1).select(tk.tokenize(F.lit(value), add_bos=bos).alias("i")).first().i


def test_lm_plan(spark):
    rows = collected(planners.lm_plan(one(spark, text=text(8)), SMALL))
    ids = ids_of(spark, text(8))
    assert [r.input_ids for r in rows] == [ids[:4], ids[4:8], ids[8:]]
    assert [r.has_loss for r in rows] == [True, True, False]
    assert rows[0].labels == ids[1:4] and rows[0].loss_denominator == 3
    assert rows[2].loss_kind is None and rows[2].labels == []


def test_perplexity_plan_scores_no_first_token(spark):
    rows = collected(planners.perplexity_plan(one(spark, text=text(4)), SMALL, truncation=5))
    assert [len(r.labels) for r in rows] == [3, 0]
    assert all(r.has_loss and r.loss_kind == "ppl" for r in rows)


def test_empty_text_without_bos_has_no_chunk(spark):
    conf = C.Tokens(add_bos=False)
    assert collected(planners.lm_plan(one(spark, text=""), SMALL, conf)) == []


def test_chunks_restore_the_text(spark):
    docs = spark.createDataFrame([(i, text(i)) for i in range(20)], "row_id bigint, text string")
    rows = collected(planners.lm_plan(docs, SMALL))
    back = {}
    for r in rows:
        back.setdefault(r.sample_id, []).append(r.input_ids)
    for i, parts in back.items():
        assert sum(parts, []) == ids_of(spark, text(i))
        assert all(len(p) == 4 for p in parts[:-1])


def test_qa_plan(spark):
    df = one(spark, prompt=text(5), response="x y z", train_prompt=False)
    rows = collected(planners.qa_plan(df, SMALL))
    # 6 prompt ids and 4 response ids in chunks of 4, 4 and 2.
    assert [r.loss_mask for r in rows] == [[0, 0, 0], [0, 1, 1], [1]]
    assert [r.has_loss for r in rows] == [False, True, True]
    assert [r.loss_denominator for r in rows] == [None, 2, 1]
    assert rows[1].labels == rows[1].input_ids[1:]


def test_qa_plan_first_chunk_never_has_loss(spark):
    df = one(spark, prompt="a", response="b", train_prompt=True)
    assert [r.has_loss for r in collected(planners.qa_plan(df, SMALL))] == [False]


def test_qa_plan_truncates_the_prompt(spark):
    df = one(spark, prompt=text(9), response="x y", train_prompt=True)
    rows = collected(planners.qa_plan(df, SMALL, truncation=8))
    p, r = ids_of(spark, text(9)), ids_of(spark, "x y")
    assert sum((x.input_ids for x in rows), []) == p[:2] + p[-3:] + r
    assert not any(x.prompt_emptied for x in rows)
    assert all(x.prompt_emptied for x in collected(planners.qa_plan(df, SMALL, truncation=3)))


def test_copy_pair_plan(spark):
    good = one(spark, prompt=text(3), response=text(2))
    bad = one(spark, prompt=text(4), response=text(2)).withColumn("row_id", F.lit(8))
    rows = collected(planners.copy_pair_plan(good.unionByName(bad), SMALL))
    assert [(r.segment, r.prefix_repeat, r.has_loss) for r in rows] == [
        ("prompt", False, False),
        ("repeat", True, True),
    ]
    assert rows[1].labels == rows[1].input_ids
    assert planners.copy_pair_violations(bad, SMALL).count() == 1
    with pytest.raises(PySparkException):
        planners.copy_pair_plan(bad, SMALL, strict=True).collect()


def shifted_row(spark, mask="[1, 1, 1, 1, 1]", distill=False):
    return one(spark, distill=distill).withColumns(
        {
            "input_ids": F.from_json(F.lit("[1, 5, 6, 7, 2]"), "array<int>"),
            "labels": F.from_json(F.lit("[-100, -100, 6, 7, 2]"), "array<int>"),
            "attention_mask": F.from_json(F.lit(mask), "array<int>"),
        }
    )


def test_shifted_label_plan(spark):
    rows = collected(planners.shifted_label_plan(shifted_row(spark), SMALL))
    assert [r.labels for r in rows] == [[-100, 6, 7, 2], [-100]]
    assert [r.loss_denominator for r in rows] == [3, 3]
    assert {r.loss_kind for r in rows} == {"ignore_index"}
    distilled = collected(planners.shifted_label_plan(shifted_row(spark, distill=True), SMALL))
    assert all(r.forward_teacher and r.loss_kind == "kl" for r in distilled)
    with pytest.raises(PySparkException):
        planners.shifted_label_plan(shifted_row(spark, "[1, 1, 0, 1, 1]"), SMALL).collect()


def test_copy_back_plan(spark):
    rows = collected(planners.copy_back_plan(one(spark, text=text(9)), SMALL))
    ids = ids_of(spark, text(9))[:8]
    assert [r.input_ids for r in rows] == [ids[:4], ids[4:], [2, *ids[:3]], ids[3:7]]
    assert [r.labels for r in rows] == [None, None, ids[:4], ids[4:]]
    assert [r.loss_denominator for r in rows] == [None, None, 8, 8]
    assert collected(planners.copy_back_plan(one(spark, text="a"), SMALL)) == []
    cut = collected(planners.copy_back_plan(one(spark, text=text(9)), SMALL, truncation=4))
    assert len(cut) == 2


def test_memory_plan(spark):
    df = one(spark, text=text(20))
    rows = collected(planners.memory_utilization_plan(df, SMALL, truncation=8))
    assert [len(r.input_ids) for r in rows] == [8, 4]
    assert [r.do_not_compress for r in rows] == [False, True]
    for wrong in (7, 10):
        with pytest.raises(ValueError):
            planners.memory_utilization_plan(df, SMALL, truncation=wrong)


def news(spark, story=4, method="lm"):
    return one(spark, disturb=text(400), context=text(story), summation="s t", method=method).withColumns(
        {
            "questions": F.array(F.lit("q one"), F.lit("q two")),
            "answers": F.array(F.lit("a one"), F.lit("a two")),
        }
    )


@pytest.mark.parametrize("method, kind", [("lm", "ce"), ("distill", "kl")])
def test_news_plan_v1(spark, method, kind):
    chunks = C.Chunks(64, 2)
    rows = collected(planners.news_plan_v1(news(spark, method=method), chunks, truncation=192))
    context = [r for r in rows if r.segment == "context"]
    turns = [r for r in rows if r.segment != "context"]
    ids = sum((r.input_ids for r in context), [])
    # The budget is a whole number of chunks; the story stands in it unbroken.
    assert len(ids) % 64 == 0 and 64 <= len(ids) <= 192
    story = ids_of(spark, C.NEWS_V1_PREFIX + text(4), bos=False)
    prefix = ids_of(spark, C.NEWS_V1_PREFIX)
    assert ids[: len(prefix)] == prefix
    assert any(ids[i : i + len(story)] == story for i in range(len(ids)))
    assert [r.segment for r in turns] == ["question", "question", "summary"]
    assert [r.loss_kind for r in turns] == [kind] * 3
    assert all(r.do_not_compress for r in turns)
    lengths = [len(r.input_ids) for r in turns]
    assert [r.clear_cache for r in turns] == [None, *lengths[:-1]]
    reply = len(ids_of(spark, "Answer: a one"))
    assert turns[0].loss_denominator == reply
    assert len(turns[0].loss_mask) == lengths[0] - (method == "lm")


def test_news_plan_v1_unshifted_mask(spark):
    rows = collected(planners.news_plan_v1(news(spark), C.Chunks(64, 2), truncation=64, compat=True))
    turn = next(r for r in rows if r.segment == "question")
    assert len(turn.loss_mask) == len(turn.input_ids) == len(turn.labels) + 1


def test_news_plan_v1_long_story_fills_the_budget(spark):
    rows = collected(planners.news_plan_v1(news(spark, 500), C.Chunks(64, 2), truncation=128))
    ids = sum((r.input_ids for r in rows if r.segment == "context"), [])
    prefix = ids_of(spark, C.NEWS_V1_PREFIX)
    assert ids[: len(prefix)] == prefix and ids[len(prefix) : 2 * len(prefix) - 1] == prefix[1:]


@pytest.mark.parametrize("plan", [planners.news_plan_v1, planners.news_plan_v2])
def test_news_hashes_a_question_and_an_answer_once(spark, plan):
    """Ids and mask of a turn come from one encoding, as do prefix, story and distractor."""
    made = plan(news(spark, 3000), C.Chunks(64, 2))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"md5\(cast\(lambda", made)) == 5


def test_dispatched_news_hash_as_little(spark):
    rows = news(spark, 3000).withColumn("answers", F.transform("answers", lambda a: F.array(a, F.lit("other"))))
    rows = rows.withColumn("task_type", F.lit(C.NEWS_V1))
    planned = planners.plan_tasks(rows, C.Chunks(64, 2), C.Tokens(), 192, override=C.NEWS_V1, seed=42)
    made = planned._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"md5\(cast\(lambda", made)) == 5
    alone = planners.news_plan_v1(news(spark, 3000), C.Chunks(64, 2), truncation=192)
    assert [r.input_ids for r in collected(planned)] == [r.input_ids for r in collected(alone)]


def news_rows(spark):
    """Short and long stories, unequal sides of turns, nulls, and blanks only."""
    long = text(300)
    rows = [
        (1, text(4), text(400), ["q one", "q two"], ["a one", "a two"], "s t", "lm"),
        (2, text(500), text(400), [long, "q"], ["a", long], long, "distill"),
        (3, "", " ", ["", " \n"], ["", "\t"], "", "lm"),
        (4, text(60), text(2), ["q", "left out"], ["a"], "s", "distill"),
        (5, None, text(9), ["q"], ["a"], "s", "lm"),
        (6, text(9), None, [None, "q"], ["a", None], None, "distill"),
        (7, text(9), text(9), None, ["a"], "s", "lm"),
        (8, text(9), text(9), [], [], "s", None),
    ]
    names = "row_id long, context string, disturb string, questions array<string>, answers array<string>, "
    return spark.createDataFrame(rows, names + "summation string, method string").coalesce(2)


def test_news_plans_of_batches_are_those_of_words(spark):
    words, batches = C.Tokens(), tk.in_batches()
    chunks = C.Chunks(64, 2)
    for plan in (
        lambda conf: planners.news_plan_v1(news_rows(spark), chunks, conf, 192),
        lambda conf: planners.news_plan_v1(news_rows(spark), chunks, conf, 64, compat=True),
        lambda conf: planners.news_plan_v2(news_rows(spark), chunks, conf, 256, 30, 224),
        lambda conf: planners.plan_tasks(news_rows(spark), chunks, conf, 192, override=C.NEWS_V1),
    ):
        assert collected(plan(batches)) == collected(plan(words))
        # No word is hashed by an expression of the row.
        assert "md5(cast(lambda" not in plan(batches)._jdf.queryExecution().analyzed().toString()


def test_catalog_news_plan_hashes_words_in_batches(spark, tmp_path, monkeypatch):
    docs = [(i, "\n".join(f"line {i} {j} " + text(j * i % 90) for j in range(i % 40)), "en", "web") for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    ordered = lambda: workloads.QUERIES["catalog_news_plan"](spark, str(tmp_path)).orderBy("sample_id", "seq")
    made = ordered()
    assert "md5(cast(lambda" not in made._jdf.queryExecution().analyzed().toString()
    got = made.collect()
    monkeypatch.setattr(tk, "in_batches", lambda conf: conf)
    assert got and got == ordered().collect()


def test_news_plan_v2(spark):
    rows = collected(
        planners.news_plan_v2(news(spark), C.Chunks(64, 2), window=256, low=192, high=224)
    )
    ids = sum((r.input_ids for r in rows if r.segment == "context"), [])
    assert 192 <= len(ids) <= 224
    turns = [r for r in rows if r.segment != "context"]
    assert all(r.loss_kind == "kl+ce" and r.forward_teacher for r in turns)
    assert all(len(r.input_ids) <= 256 - len(ids) for r in turns)
    assert all(r.labels == r.input_ids[1:] for r in turns)


def test_plan_tasks(spark):
    df = one(spark, text=text(8), task_type=C.LANGUAGE_MODELING)
    assert {r.task_type for r in collected(planners.plan_tasks(df, SMALL, override=C.PERPLEXITY))} == {
        C.PERPLEXITY
    }
    tags = (C.LANGUAGE_MODELING, C.COPY_BACK)
    other = df.withColumns({"task_type": F.lit(C.COPY_BACK), "row_id": F.lit(8)})
    both = planners.plan_tasks(df.unionByName(other), SMALL, task_types=tags)
    assert both.groupBy("task_type").count().count() == 2
    assert both.columns == planners.PLAN_COLUMNS
    with pytest.raises(ValueError):
        planners.plan_tasks(df, SMALL, override="random memory utilization")
    unknown = df.withColumn("task_type", F.concat(F.lit("odd"), F.col("row_id").cast("string")))
    with pytest.raises(PySparkException):
        planners.plan_tasks(unknown, SMALL, task_types=tags).count()


def test_plan_fields():
    with pytest.raises(ValueError):
        planners.plan_row(unknown=1)


# --- samples ---------------------------------------------------------------


def test_sft_sample(spark):
    df = one(spark, input=text(6), output="x y")
    # Room for 3 of the 7 prompt ids: bos, none of the first half, one of the last.
    row = samples.sft_samples(df, min_length=1, max_length=5).first()
    x = ids_of(spark, "x y", bos=False)
    assert row.input_ids == [1, *ids_of(spark, "w5", bos=False), *x, 2]
    assert row.labels == [-100, -100, *x, 2]
    assert row.attention_mask == [1] * 5 and row.length == 5 and row["index"] == 7
    assert samples.sft_samples(df, min_length=5, max_length=5).count() == 0


def test_sft_halves_meet_in_one_word(spark):
    df = one(spark, input=text(9), output="x y")
    row = samples.sft_samples(df, min_length=1, max_length=8, keep_text=True).first()
    # Half is 3: bos, w0, w1 | w6, w7, w8, joined as w1w6.
    assert row.input_ids[:5] == ids_of(spark, "w0 w1w6 w7 w8")
    assert row.text.startswith("w0 w1w6 w7 w8") and row.text.endswith("x y")
    bare = samples.sft_samples(df, max_length=8, with_labels=False).first()
    assert bare.input_ids == ids_of(spark, "w0 w1w6 w7 w8") and "labels" not in bare


def test_sft_edges(spark):
    # No room for a half: the whole prompt stays.
    full = samples.sft_samples(one(spark, input=text(3), output="x y"), min_length=1, max_length=3)
    assert full.first().length == 1 + 3 + 2 + 1
    none = samples.sft_samples(one(spark, input="a", output=" "), min_length=1, max_length=9)
    long = samples.sft_samples(one(spark, input="a", output=text(10)), min_length=1, max_length=9)
    assert none.count() == long.count() == 0


def test_mixed_samples_dispatch(spark):
    schema = "row_id bigint, text string, input string, output string, input_ids array<int>, labels array<int>"
    rows = [
        (1, text(5), "ignored", "ignored", None, None),
        (2, None, text(5), "x y", None, None),
        (3, None, None, None, [1, 5, 6, 7], [1, -100, 6, 7]),
        (4, None, None, None, [1] * 50, [1] * 50),
    ]
    made = {r.row_id: r for r in samples.mixed_samples(spark.createDataFrame(rows, schema), min_length=2, max_length=20).collect()}
    assert set(made) == {1, 2, 3}
    assert made[1].labels == made[1].input_ids
    assert made[2].labels[:6] == [-100] * 6 and made[2].input_ids[-1] == 2
    assert made[3].labels == [1, -100, 6, 7]
    empty = spark.createDataFrame([(5, None, None, None, None, None)], schema)
    with pytest.raises(PySparkException):
        samples.mixed_samples(empty).collect()


def test_map_rows_augments(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "row_id bigint, text string")

    def split(row_id, text, _index):
        words = text.split()
        return {"i": [_index] * len(words), "w": words} if words else None

    got = samples.map_rows(df, split, "i bigint, w string", index="row_id", augment=True)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b")]


def test_contracts(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "prompt string, response string")
    good, bad = samples.split_violations(df, ["prompt", "response"])
    assert good.count() == 1 and bad.first().missing == ["response"]
    assert samples.flag("true") and not samples.flag("false")
    with pytest.raises(ValueError):
        samples.flag("yes")


def wide(spark):
    """Two rows of each tag, with the columns of all tags."""
    n = SMALL.chunk_size
    words = [f"w{k}" for k in range(40)]
    plain = {
        "text": " ".join(words), "prompt": " ".join(words[: n - 1]), "response": " ".join(words[: n - 2]),
        "train_prompt": True, "disturb": " ".join(words * 3), "context": "a story", "summation": "the end",
        "method": "lm", "distill": False,
    }
    rows = []
    tags = [
        C.LANGUAGE_MODELING, C.PERPLEXITY, C.QUESTION_ANSWERING, C.AUTO_ENCODING, C.NEWS_V1, C.NEWS_V2,
        C.MEMORY_UTILIZATION, C.SHIFTED_LABELS, C.COPY_BACK,
    ]
    for k, tag in enumerate(tags * 2):
        ids = list(range(5, 5 + 2 * n + k % 3))
        rows.append(
            {"row_id": k, "task_type": tag, **plain, "questions": ["why", "how"], "answers": [["so"], ["thus", "x"]],
             "input_ids": ids, "labels": ids, "attention_mask": [1] * len(ids)}
        )
    kinds = {
        "row_id": "bigint", "train_prompt": "boolean", "distill": "boolean", "questions": "array<string>",
        "answers": "array<array<string>>", "input_ids": "array<int>", "labels": "array<int>", "attention_mask": "array<int>",
    }
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema), tags


def test_dispatch_over_all_tags_is_one_pass(spark, tmp_path):
    df, tags = wide(spark)
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    cut = 2 * SMALL.chunk_size
    plan = planners.plan_tasks(df, SMALL, truncation=cut)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = collected(plan)
    assert {r.task_type for r in got} == set(tags)
    for tag in tags:
        alone = collected(planners.plan_tasks(df.filter(F.col("task_type") == tag), SMALL, truncation=cut, override=tag))
        assert sorted(map(str, alone)) == sorted(str(r) for r in got if r.task_type == tag), tag


def test_dispatch_without_truncation(spark):
    df, tags = wide(spark)
    cut_only = [C.NEWS_V1, C.MEMORY_UTILIZATION]
    rest = df.filter(~F.col("task_type").isin(*cut_only))
    assert {r.task_type for r in collected(planners.plan_tasks(rest, SMALL))} == set(tags) - set(cut_only)
    with pytest.raises(PySparkException):
        planners.plan_tasks(df, SMALL).count()
    texts = rest.filter(F.col("task_type") == C.LANGUAGE_MODELING).select("row_id", "task_type", "text")
    assert planners.plan_tasks(texts, SMALL).count() > 0
