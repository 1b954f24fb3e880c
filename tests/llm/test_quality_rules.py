import random
import re
from collections import Counter

from pyspark.sql import functions as F

from foliant.llm import quality_rules as op
from tests.conftest import MEDIUM


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count, covered = Counter(grams), set()
    for j, g in enumerate(grams):
        if count[g] > 1:
            covered |= {j, j + 1, j + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(documents):
    rng = random.Random(6)
    texts = [None, "", " \n", "a", "a b", "a b c a b c", "x x x x", "x\nx\n\n x\ny\r\ny\r\n", "😀é | <#>", "w " * 60_000]
    texts += [" ".join(rng.choices(["a", "b", "c\n", "dd", "#"], k=rng.randint(0, 60))) for _ in range(100)]
    rows = op.statistics(documents(list(enumerate(texts)), extra=["row", "h", "i"])).collect()
    for r in rows:
        assert tuple(r[c] for c in op.COUNTS) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def labelled(rng, n, noise=0.0):
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = [rng.choice("abcdefghijklm") * rng.randint(2, 9) + str(rng.randrange(10_000)) for _ in range(rng.randint(60, 200))]
        if bad:
            words = [w[2:].upper() + "!!" for w in words] if k % 2 else [w[3:] + "***" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad == (rng.random() < noise)), 0))
    return rows, labels


def test_learns_the_planted_rules(spark, documents):
    rng = random.Random(9)
    rows, labels = labelled(rng, 600, noise=0.01)
    judged, rules = op.judge(documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert {str(r[0]).split()[0] for r in rules} >= {"symbols_per_word"} and len(rules) >= 2
    assert sum(kept[k] == (k % 5 != 0) for k in kept) >= 0.99 * len(kept)
    text = str(op.verdict(rules))
    assert "CASE WHEN" in text.upper()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    even = F.col("doc_id") % 2 == 0
    judged, rules = op.judge(docs, labels.filter(even))
    held = judged.join(labels.filter(~even), "doc_id").filter("NOT base_failed").collect()
    assert rules and sum(r["kept"] == (r["quality"] == 1) for r in held) >= 0.97 * len(held)
    assert all(r["kept"] for r in held if r["quality"] == 1)


def test_cases(spark, documents):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(1, good), (1, "short"), (2, None), (3, good), (None, good), (4, "a b c " * 40)]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = documents(rows, extra=["kept", "rule", "quality", "text_id"])
    judged, rules = op.judge(df, none)
    assert rules == [] and sorted((r["doc_id"] or 0, r["kept"]) for r in judged.collect()) == [
        (0, True), (1, False), (1, True), (2, False), (3, True), (4, False),
    ]
    left = op.reject(df, none)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, good), (1, good), (3, good)]
    odd = spark.createDataFrame([(1, None, 0), (None, 0, 0), (99, 0, 1), (3, 1, 0), (3, 0, 0)], none.schema)
    assert op.judge(df, odd)[0].count() == 6
    assert op.judge(df.limit(0), odd)[0].count() == 0


def test_no_python_in_the_plan(spark, documents):
    judged, _ = op.judge(documents([(1, "a")]), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
