"""Text functions against Python's re and str."""

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import text as tx
from foliant.operators import articles
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")


def squeeze(t):
    return re.sub(r"([^a-zA-Z0-9])\1{4,}", lambda m: m.group(1) * 4, t)


def collapse(t):
    return re.sub(r"([a-zA-Z0-9]{3,}?)\1+", lambda m: m.group(1), t)


def test_cleaning_matches_python_on_all_documents(docs):
    made = docs.select(
        "text",
        tx.squeeze_symbols(F.col("text")).alias("squeezed"),
        tx.collapse_repeats(F.col("text")).alias("collapsed"),
        tx.clean_then_cap(F.col("text"), 700).alias("cleaned"),
    ).collect()
    assert len(made) == 1000
    for r in made:
        assert r.squeezed == squeeze(r.text)
        assert r.collapsed == collapse(r.text)
        assert r.cleaned == collapse(squeeze(r.text))[:700]


@pytest.mark.parametrize(
    "before, after",
    [("----", "----"), ("-----", "----"), ("a" + " " * 9 + "b", "a    b"), ("", "")],
)
def test_symbol_runs(evaluate, before, after):
    assert evaluate(tx.squeeze_symbols(F.col("t")), t=(before, "string")) == after


def test_symbol_runs_of_every_kind_of_character(evaluate):
    """All ASCII characters, then letters, digits, blanks and signs beyond ASCII, one outside the BMP."""
    chars = [chr(c) for c in range(1, 0x300)] + list("\u0661\u0430\u2003\u2028\uff21\U0001f600\U00010400")
    text = "x".join(c * n for c in chars for n in (4, 5, 9))
    assert evaluate(tx.squeeze_symbols(F.col("t")), t=(text, "string")) == squeeze(text)


def test_squeezing_costs_little_more_than_splitting(spark):
    """Both look at every character once; with a negated class in the group squeezing took far longer."""
    words = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.substring(F.md5((F.col("id") + i).cast("string")), 1, 6))
    texts = spark.range(0, 4000, 1, 2).select(F.array_join(words, " ").alias("t")).cache()
    texts.count()

    def seconds(column):
        began = time.perf_counter()
        texts.agg(F.sum(F.length(column))).collect()
        return time.perf_counter() - began

    text = F.col("t")
    split = min(seconds(F.concat_ws("", F.split(text, "[ \t]"))) for _ in range(3))
    squeezed = min(seconds(tx.squeeze_symbols(text)) for _ in range(3))
    texts.unpersist()
    assert squeezed < 2.5 * split


@pytest.mark.parametrize(
    "before, after", [("abcabcabc", "abc"), ("aaaaaa", "aaa"), ("xyxyxy", "xyxyxy")]
)
def test_repeat_units(evaluate, before, after):
    assert evaluate(tx.collapse_repeats(F.col("t")), t=(before, "string")) == after


def test_long_repeats_do_not_overflow(evaluate):
    assert evaluate(tx.collapse_repeats(F.repeat(F.col("t"), F.lit(200_000))), t=("abc", "string")) == "abc"


def test_strip_and_normalize_match_python(spark, docs):
    odd = [(-1, "\x1c\x85  Ab, c! \n\t"), (-2, ""), (-3, "\x0b\x0c"), (-4, "x\x1fy\xa07")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    made = rows.select(
        "text",
        tx.strip(F.col("text")).alias("stripped"),
        tx.normalize_text(F.col("text"), ignore_number=True).alias("plain"),
    ).collect()
    table = str.maketrans("", "", string.punctuation + string.digits)
    for r in made:
        assert r.stripped == r.text.strip()
        assert r.plain == " ".join(r.text.lower().translate(table).split())


def test_normalize_options(evaluate):
    kept = tx.normalize_text(F.col("t"), False, False, False, False)
    assert evaluate(kept, t=("A,  b1", "string")) == "A,  b1"


@pytest.mark.parametrize("length", [9, 10, 11, 12])
def test_middle_truncation_of_characters(evaluate, length):
    text = "abcdefghijklmnop"[:length]
    expected = text if length <= 11 else text[: 11 // 2] + text[-11 // 2 :]
    assert evaluate(tx.middle_truncate_chars(F.col("t"), 11), t=(text, "string")) == expected


def test_caps():
    assert tx.char_cap("128k") == 131072
    assert tx.char_cap(None) is None
    with pytest.raises(ValueError):
        tx.char_cap("2k")
    with pytest.raises(ValueError):
        tx.char_cap(None, required=True)


def python_articles(lines):
    return re.split(C.ARTICLE_HEADING, "".join(lines))[2::2]


PIECES = ["", " \n", " = A = \n", " = Bb = \n", " = = sub = = \n", " text \n", "tail\n", " x = y \n"]


def test_article_fixture(spark):
    lines = ["", " = A = \n", "", " para one \n", " = B = \n", " b text \n", " = C = \n", " last \n"]
    rows = [("s", i, t) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "source string, line_no bigint, text string")
    got = articles.split_lines(df, min_chars=None).orderBy("article").collect()
    assert [r.text for r in got] == ["b text", "last \n"] == python_articles(lines)


@pytest.mark.parametrize("block_bits, fan_bits", [(14, 10), (2, 1), (0, 1)])
def test_articles_match_python_on_random_sources(spark, monkeypatch, block_bits, fan_bits):
    """Blocks of four lines or one put block borders into every source, groups of two all levels."""
    monkeypatch.setattr(articles, "BLOCK_BITS", block_bits)
    monkeypatch.setattr(articles, "FAN_BITS", fan_bits)
    rng = random.Random(7)
    rows, expected = [], {}
    for s in range(300):
        lines = [rng.choice(PIECES) for _ in range(rng.randint(1, 25))]
        rows += [(f"s{s}", i, t) for i, t in enumerate(lines)]
        made = python_articles(lines)
        if made:
            expected[f"s{s}"] = made
    df = spark.createDataFrame(rows, "source string, line_no bigint, text string")
    got = {}
    for r in articles.split_lines(df, min_chars=None).orderBy("source", "article").collect():
        got.setdefault(r.source, []).append(r.text)
    # An article without any line has no row.
    assert got.keys() <= expected.keys()
    for s, made in expected.items():
        assert [t for t in got.get(s, []) if t] == [t for t in made if t]


def test_whole_text_form_matches(spark):
    text = " \n = A = \n one \n = B = \n two \n"
    df = spark.createDataFrame([("s", text)], "source string, text string")
    got = articles.split_whole_text(df).orderBy("article").collect()
    assert [r.text for r in got] == python_articles([text])
