import random

import numpy as np
import pytest

from foliant.llm import substring_dedup as op


def brute(rows):
    """Removed words of each row by looking every window up."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - 49):
            if i is not None:
                key = tuple(w[s : s + 50])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - 49):
            if i is not None and least[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed, words=300, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passages = [rng.choices(vocabulary, k=k) for k in (49, 50, 51, 60, 75, 200)]
    rows = []
    for i in rng.sample(range(1000), docs):
        out = []
        for _ in range(rng.randint(0, 4)):
            out += rng.choices(vocabulary, k=rng.randint(0, 60))
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
                out += p if rng.random() < 0.6 else p[a:b]
        rows.append((i, " ".join(out)))
    rows += [(2000 + k, rows[k][1]) for k in range(5)]
    rows += [(3000, "a " * 180), (3001, "a " * 100), (3002, "a b " * 70), (3003, "b a " * 90), (3004, None), (3005, "")]
    return rows


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in op.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("shard", [256, 1])
def test_against_all_windows(documents, monkeypatch, shard):
    monkeypatch.setattr(op, "SHARD", shard)
    rows = corpus(shard)
    assert got(documents(rows, extra=["start", "n", "first"])) == brute(rows)


def test_repeated_ids_and_nulls(documents):
    rng = random.Random(1)
    p, q = (" ".join(f"{c}{rng.randrange(500)}" for _ in range(70)) for c in "pq")
    rows = [(5, p), (5, p), (5, q + " x"), (7, p + " " + q), (None, p), (3, "y " + q), (None, None)]
    assert got(documents(rows)) == brute(rows)
    assert op.remove_repeats(documents(rows).limit(0)).count() == 0


def test_one_passage_in_many_surroundings(documents):
    rng = random.Random(2)
    p = " ".join(f"p{k}" for k in range(55))
    rows = [(k, " ".join(f"v{rng.randrange(9999)}" for _ in range(60)) + f" {p} " + " ".join(f"v{rng.randrange(9999)}" for _ in range(60))) for k in range(400)]
    assert got(documents(rows)) == brute(rows)


def test_automaton_statistics():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(0, 40))] for _ in range(4)]
        held = op.Automaton()
        for t in texts[:3]:
            held.add(t)
        parts = {tuple(t[i : i + 5]) for t in texts[:3] for i in range(len(t) - 4)}
        want = [i for i in range(len(texts[3]) - 4) if tuple(texts[3][i : i + 5]) in parts]
        assert held.matches(texts[3], 5) == want


def test_every_window_has_one_stretch():
    rng = np.random.default_rng(1)
    for n in (50, 51, 120, 5000):
        h = rng.integers(0, 40, n, dtype=np.uint64)
        start, size, _ = op.stretches(h)
        assert start[0] == 0 and (start[1:] == start[:-1] + size[:-1]).all()
        assert start[-1] + size[-1] == n - 49 and size.max() <= op.STRETCH
