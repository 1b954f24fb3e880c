import random

import pytest

from foliant.llm import near_dedup as op
from foliant.llm.components import components


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(size, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, size, percent):
    """Component of each id by comparing all rows."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def corpus(seed, families=12):
    """Families of texts with edits, chains of small steps, copies and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            new = list(rng.choice([base, texts[-1]]))
            for _ in range(rng.randint(0, max(1, len(new) // 14))):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            texts.append(new)
    texts += [["only"], ["Only"], ["two", "words"], [], ["é", "x"]]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    blanks = [" ", "\n", "\t ", "  "]
    return [(i, "".join(w.upper() + rng.choice(blanks) if rng.random() < 0.1 else w + " " for w in t)) for i, t in zip(ids, texts, strict=True)]


def result(docs, **options):
    return {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in op.groups(docs, **options).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(documents, size):
    rows = corpus(size)
    got = result(documents(rows, extra=["bands", "a", "key"]), size=size, percent=80)
    want = brute(rows, size, 80)
    assert {i: c for i, (c, _, _) in got.items()} == want
    assert all(k == (i == c) for i, (c, k, _) in got.items())
    assert all(got[i][2] == len(shingles(t, size)) for i, t in rows)


def test_links_that_miss_the_first_of_their_bucket(documents):
    # b and c are alike, and share bands with a, to which neither is similar enough.
    a = [f"x{k}" for k in range(100)]
    rows = []
    for n in range(6):
        b = a[:70] + [f"{n}y{k}" for k in range(30)]
        rows += [(10 + 2 * n, " ".join(b)), (11 + 2 * n, " ".join(b[:-1] + ["z"]))]
    rows.append((1, " ".join(a)))
    assert {i: c for i, (c, _, _) in result(documents(rows), size=2, percent=80).items()} == brute(rows, 2, 80)


def test_nulls_repeats_and_empty(documents):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(5, text), (5, text), (3, text), (None, text), (7, None), (8, ""), (9, " \n"), (4, "other words here"), (4, text)]
    df = documents(rows)
    got = op.groups(df, size=2).collect()
    assert len(got) == len(rows)
    seen = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got)
    assert seen == [
        (0, None, True), (3, 3, True), (4, 3, False), (4, 3, False), (5, 3, False), (5, 3, False), (7, 7, True),
        (8, 8, True), (9, 9, True),
    ]
    assert op.groups(df.limit(0)).count() == 0
    one = op.keep_one(df, size=2)
    assert one.columns == df.columns
    # Id 4 stands for two texts: it names neither, and both stay.
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 3, 4, 4, 7, 8, 9]


def test_texts_under_one_id_all_stay(documents):
    apart = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(5, apart[0]), (5, apart[1]), (5, apart[1]), (9, apart[2]), (9, apart[2]), (2, apart[0])]
    got = op.keep_one(documents(rows, extra=["_kept", "row", "id", "body"]), size=2).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted({(i, t) for i, t in rows})


def test_one_group_of_a_third(documents):
    base = [f"u{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: k % 60], f"new{k}", *base[k % 60 + 1 :]])) for k in range(300)]
    rows += [(1000 + k, f"alone{k} in its own words {k * k}") for k in range(600)]
    got = result(documents(rows), size=2)
    assert all(got[k][0] == 0 for k in range(300))
    assert all(got[1000 + k][1] for k in range(600))


def test_long_text(documents):
    rows = [(2, "a b c " * 100_000), (1, "a b c " * 90_000), (3, " ".join(map(str, range(200_000))))]
    assert {i: c for i, (c, _, _) in result(documents(rows), size=2).items()} == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = random.Random(3)
    links = [(a, a + 1) for a in range(0, 60)] + [(100 + a, 100) for a in range(1, 40)] + [(7, 7), (300, 200), (300, 200)]
    links += [(k, k + 500) for k in range(500, 520)]
    rng.shuffle(links)
    rows = spark.createDataFrame([*links, (None, 1)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(rows).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 300: 200}
    want |= {k: k for k in range(500, 520)} | {k + 500: k for k in range(500, 520)}
    assert got == want
    assert components(rows.limit(0)).count() == 0
