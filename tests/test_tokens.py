"""Token-array functions on hand-worked cases."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import tokens as tk
from foliant.operators import scoring

INTS = "array<int>"


def ints(values):
    return (json.dumps(values), INTS)


@pytest.fixture(autouse=True)
def columns(spark):
    """Columns exist only beside a session."""
    globals().update({name: F.col(name) for name in "abpr"})


@pytest.mark.parametrize("n", [0, 1, 3, 5, 9])
def test_slices_are_python_slices(evaluate, n):
    xs = [1, 2, 3, 4, 5]
    assert evaluate(tk.first_n(a, n), a=ints(xs)) == xs[:n]
    assert evaluate(tk.last_n(a, n), a=ints(xs)) == (xs[-n:] if n else [])
    assert evaluate(tk.drop_first(a, n), a=ints(xs)) == xs[n:]
    assert evaluate(tk.drop_last(a, n), a=ints(xs)) == xs[: max(5 - n, 0)]


def test_first_n_of_negative_count(evaluate):
    assert evaluate(tk.first_n(a, -3), a=ints([1, 2])) == []


def test_head_truncation(evaluate):
    assert evaluate(tk.head_truncate(a, None), a=ints([1, 2, 3])) == [1, 2, 3]
    assert evaluate(tk.head_truncate(a, 2), a=ints([1, 2, 3])) == [1, 2]


def test_words_and_ids(evaluate):
    assert evaluate(tk.words(F.col("t")), t=("  a\tbb\n\x0bc ", "string")) == ["a", "bb", "c"]
    assert evaluate(tk.words(F.col("t")), t=("", "string")) == []
    ids = evaluate(tk.tokenize(F.col("t")), t=("a b a", "string"))
    assert ids[0] == C.BOS and ids[1] == ids[3] and min(ids[1:]) >= 3
    assert evaluate(tk.tokenize(F.col("t"), add_bos=False), t=("", "string")) == []


@pytest.mark.parametrize(
    "size, trunc, expected",
    [
        (10, 8, [1, 2, 8, 9, 10]),  # odd room: the tail has one more
        (10, 7, [1, 2, 9, 10]),
        (10, 13, list(range(1, 11))),
        (10, 3, []),
        (10, 2, []),
        (10, 4, [10]),
    ],
)
def test_middle_truncation_of_prompts(evaluate, size, trunc, expected):
    cut = tk.middle_truncate_prompt(p, r, trunc)
    assert evaluate(cut, p=ints(list(range(1, size + 1))), r=ints([7, 8, 9])) == expected


def test_labels(evaluate):
    assert evaluate(tk.shift_labels(a), a=ints([7, 8, 9])) == [8, 9, -100]
    assert evaluate(tk.shift_labels(a), a=ints([])) == []
    assert evaluate(tk.mask_all_but_last(a, F.lit(2)), a=ints([5, 6, 7])) == [-100, 6, 7]
    assert evaluate(tk.ignore_masked(a, b), a=ints([5, 6, 7]), b=ints([1, 0, 1])) == [5, -100, 7]
    assert evaluate(tk.valid_labels(a), a=ints([-100, 1, -100])) == 1


def test_append_eos(evaluate):
    done = tk.append_eos({"input_ids": a})["input_ids"]
    assert evaluate(done, a=ints([5, 2])) == [5, 2]
    assert evaluate(done, a=ints([5, 7])) == [5, 7, 2]
    many = tk.append_eos({"input_ids": a, "position_ids": b, "attention_mask": p})
    given = {"a": ints([5, 7]), "b": ints([3, 4]), "p": ints([1, 0])}
    assert evaluate(many["position_ids"], **given) == [3, 4, 5]
    assert evaluate(many["attention_mask"], **given) == [1, 0, 0]
    with pytest.raises(ValueError):
        tk.append_eos({"input_ids": a, "other": b})


def test_remove_first_eos(evaluate):
    made = tk.remove_first_eos({"input_ids": a, "labels": b})
    given = {"a": ints([5, 2, 6, 2]), "b": ints([1, 2, 3, 4])}
    assert evaluate(made["input_ids"], **given) == [5, 6, 2]
    assert evaluate(made["labels"], **given) == [1, 3, 4]
    with pytest.raises(PySparkException):
        evaluate(made["input_ids"], a=ints([5]), b=ints([1]))
    lenient = tk.remove_first_eos({"input_ids": a}, strict=False)["input_ids"]
    assert evaluate(lenient, a=ints([5])) == [5]


def test_chunks(evaluate):
    assert evaluate(tk.chunk_arrays(a, 2), a=ints([1, 2, 3, 4, 5])) == [[1, 2], [3, 4], [5]]
    assert evaluate(tk.chunk_arrays(a, 2), a=ints([])) == []
    assert evaluate(tk.adjacent_pairs(a), a=ints([5])) == []
    pairs = evaluate(tk.adjacent_pairs(a), a=ints([5, 6, 7]))
    assert [(x.prev, x.tok) for x in pairs] == [(5, 6), (6, 7)]


def test_padding(evaluate):
    assert evaluate(tk.pad_to(a, F.lit(3), 0), a=ints([4])) == [4, 0, 0]
    assert evaluate(tk.pad_to(a, F.lit(3), 0, "left"), a=ints([4])) == [0, 0, 4]
    assert evaluate(tk.pad_mask(a, F.lit(3)), a=ints([4])) == [1, 0, 0]
    assert evaluate(tk.position_ids_contiguous(a), a=ints([0, 1, 1, 0])) == [0, 0, 1, 0]


def test_nested(evaluate):
    nested = ("[[1, 2], [2]]", "array<array<int>>")
    assert evaluate(tk.replace_value(a, 2, 0, 2), a=nested) == [[1, 0], [0]]
    assert evaluate(tk.longest(a), a=nested) == 2
    assert evaluate(tk.longest(a), a=("[]", "array<array<int>>")) == 0
    assert evaluate(tk.same_length(a, b), a=ints([1]), b=ints([2]))
    assert not evaluate(tk.same_length(a, b), a=ints([1]), b=ints([2, 3]))


def test_random_ids_repeat_and_stay_below_the_vocabulary(evaluate):
    made = evaluate(tk.random_ids(F.lit(5), 200, 50), a=ints([]))
    again = evaluate(tk.random_ids(F.lit(5), 200, 50), a=ints([]))
    assert made == again and len(made) == 200
    assert min(made) >= 0 and max(made) < 49 and len(set(made)) > 30


@pytest.mark.parametrize("encoded", [False, True])
def test_first_ids_are_the_start_of_all_ids(spark, encoded):
    texts = ["", None, " ", "a", " a b", "a  b\t\n c ", "\n\x0b a\x0cb\r\rc d e f g ", "x\u00a0y \u2003 z " * 9]
    df = spark.createDataFrame([(t, n) for t in texts for n in (None, -1, 0, 1, 2, 3, 5, 40)], "t string, n int")
    encoder = scoring.text_encoder(lambda: lambda t: [len(w) + 10 for w in t.split()])
    conf = C.Tokens(encoder=encoder) if encoded else C.Tokens()
    n = F.col("n")
    for bos in (False, True):
        ids = tk.tokenize(F.col("t"), conf, bos)
        counted = tk.counted_ids(F.col("t"), n, conf, bos)
        rows = df.select(
            F.struct(tk.first_n(ids, n), F.size(ids), tk.first_n(ids, n)).alias("expected"),
            F.struct(tk.first_ids(F.col("t"), n, 40, conf, bos), counted["size"], counted["ids"]).alias("got"),
        ).collect()
        assert len(rows) == 64 and all(tuple(r.got) == tuple(r.expected) for r in rows)
    for most in (0, 1, 2, 3):
        rows = df.select(tk.first_words(F.col("t"), most).alias("got"), tk.first_n(tk.words(F.col("t")), most).alias("all"))
        assert all(r.got == r["all"] for r in rows.collect())


def test_word_encoder_gives_the_ids_of_words(spark):
    texts = ["", None, " ", "a", " a b", "a  b\t\n c a", "\n\x0b a\x0cb\r\rc \x1c \x85 d", "x\u00a0y \u2003 \U0001f600 é " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for bos, size in ((False, 32000), (True, 50)):
        made = tk.tokenize(F.col("t"), C.Tokens(size, encoder=tk.word_encoder(size)), bos)
        rows = df.select(tk.tokenize(F.col("t"), C.Tokens(size), bos).alias("expected"), made.alias("got")).collect()
        assert len(rows) == len(texts) and all(r.got == r.expected for r in rows)


def test_word_list_encoder_gives_the_first_ids_of_each_text(spark):
    texts = ["", None, " ", "a", " a b", "a  b\t\n c a", "\n\x0b a\x0cb\r\rc \x1c \x85 d", "x y   \U0001f600 é " * 9]
    lists = [texts, [], None, [None], ["a b c " * 30], *[[t, str(i)] for i, t in enumerate(texts * 150)]]
    df = spark.createDataFrame([(v,) for v in lists], "t array<string>").coalesce(1)
    conf = C.Tokens(50)
    for most in (1, 3, 500):
        # Many lists are more than the encoder splits at once; no row at all is a batch, too.
        for rows in (df, df.limit(0), df.filter("size(t) = 0")):
            made = rows.select(
                F.transform("t", lambda t: tk.first_n(tk.tokenize(t, conf, False), most)).alias("expected"),
                tk.in_batches(conf).list_encoder(F.col("t"), most).alias("got"),
            )
            assert all(r.got == r.expected for r in made.collect())
    with pytest.raises(ValueError):
        tk.in_batches(tk.in_batches(conf))
