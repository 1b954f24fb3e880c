import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import periodic_runs as op


def brute(parts):
    n, found = len(parts), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if parts[i] != parts[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and parts[j] == parts[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(texts):
    ids, offsets = op.numbered(texts)
    got = op.runs(ids, offsets) if len(ids) else np.empty((0, 4), int)
    return [[tuple(r[1:]) for r in got.tolist() if r[0] == k] for k in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), min_size=1, max_size=4))
def test_as_brute_force_on_few_words(texts):
    assert runs_of(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_as_brute_force_on_nested_repeats(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        parts = []
        while len(parts) < 200:
            unit = [str(rng.randrange(4)).encode() for _ in range(rng.randint(1, 7))]
            parts += (unit * rng.randint(1, 9))[: rng.randint(1, 40)]
        texts.append(parts)
    assert runs_of(texts) == [brute(t) for t in texts]


def test_grammar_derives_the_text():
    rng = random.Random(5)
    texts = [[str(rng.randrange(3)).encode() for _ in range(rng.randrange(120))] for _ in range(30)]
    ids, offsets = op.numbered(texts)
    grammar = op.Grammar(ids, offsets)
    assert len(grammar.low)
    for r, (low, high) in enumerate(zip(grammar.low, grammar.high, strict=True)):
        at = np.sort(grammar.places[grammar.first[r] : grammar.first[r + 1]])
        assert len(at) >= op.LEAST_PAIRS and (np.diff(at) >= high - low).all()
        for p in at:
            assert (ids[p : p + high - low] == ids[low:high]).all()
    # What remains covers every text, and no pair of it is frequent.
    assert set(offsets[:-1][np.diff(offsets) > 0]) <= set(grammar.left.tolist())


def test_nested_and_long_periods():
    unit = [str(k).encode() for k in range(997)]
    assert runs_of([unit * 50, [b"x"] * 50_000]) == [[(0, 997 * 50, 997)], [(0, 50_000, 1)]]
    inner = [b"a"] * 7 + [b"b"]
    expected = sorted([(0, 40, 8)] + [(8 * k, 7, 1) for k in range(5)])
    assert runs_of([inner * 5]) == [expected]


def test_planted_tails():
    parts = [str(k).encode() for k in range(90)]
    for doc_id in range(200):
        h = zlib.crc32(str(doc_id).encode())
        got = op.planted(parts, doc_id)
        if h % 10:
            assert got == parts
            continue
        g = h // 10
        a = g % 90
        p = 1 + (90 - a) // (3 + g % 8)
        assert got == [parts[i] if i < a else parts[a + (i - a) % p] for i in range(90)]
    assert op.planted(parts, None) == parts and op.planted([], 7) == []


def test_cases(spark, documents):
    hot = "go " * 7 + "on"
    long_text = "one two three " * 60_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, hot), (4, hot), (None, hot), (5, "a b " * 4 + "c"), (6, long_text)]
    df = documents(rows, extra=["runs", "start", "collapsed"])
    got = sorted(op.find_runs(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    facts = [(r["doc_id"], r["n_words"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in got]
    none = (0, None, None, None, None)
    assert facts == [
        (1, 0, *none), (2, 0, *none), (3, 0, *none), (4, 8, 1, 0, 7, 1, 7000), (4, 8, 1, 0, 7, 1, 7000),
        (5, 9, 1, 0, 8, 2, 4000), (6, 180_000, 1, 0, 180_000, 3, 60_000_000), (None, 8, 1, 0, 7, 1, 7000),
    ]
    assert [r["collapsed"] for r in got[3:]] == ["go on"] * 2 + ["a b c", "one two three", "go on"]
    assert op.find_runs(df.limit(0)).collect() == []
    listed = op.find_runs(df.limit(4)).select("doc_id", op.listing().alias("l")).collect()
    assert {r["doc_id"]: r["l"] for r in listed} == {1: "", 2: "", 3: "", 4: "0,7,1\n"}


def test_same_result_in_any_batches(spark, documents, monkeypatch):
    rows = [(k, "a b c " * (k % 9) + f"word{k} " * (k % 12)) for k in range(120)]
    df = documents(rows)
    one = sorted(map(str, op.find_runs(df.coalesce(1), changed=True).collect()))
    assert one == sorted(map(str, op.find_runs(df.repartition(7), changed=True).collect()))
