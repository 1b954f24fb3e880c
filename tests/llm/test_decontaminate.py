import random

import numpy as np

from foliant.llm import decontaminate as op


def brute(item, text):
    """Fewest edits of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_exact_edits():
    rng = random.Random(8)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 15))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        edits, end = op.edits_within(np.array(item), np.array(text, int))
        assert edits == brute(item, text)
        back, size = op.edits_within(np.array(item)[::-1], np.array(text[:end], int)[::-1], anchored=True)
        assert back == edits and brute(item, text[end - size : end]) == edits


def edited(rng, words, vocabulary, edits):
    out = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = rng.choice(vocabulary)
        elif kind == 1:
            out.insert(at, rng.choice(vocabulary))
        elif len(out) > 1:
            del out[at]
    return out


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")


def found(docs, items):
    return {(r["doc_id"], r["item_id"]): r["n_edits"] for r in op.find(docs, items).collect()}


def test_recall_against_all_windows(spark, documents):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, rng.choices(vocabulary, k=rng.randint(12, 60))) for k in range(40)]
    rows, truth = [], {}
    for i in range(400):
        text = rng.choices(vocabulary, k=rng.randint(0, 200))
        if i % 2:
            k, item = rng.choice(items)
            at = rng.randint(0, len(text))
            text[at:at] = edited(rng, item, vocabulary, rng.randint(0, len(item) // 5))
            edits = brute(item, text)
            if edits <= len(item) // 5:
                truth[i, k] = edits
        rows.append((i, text))
    got = found(documents([(i, " ".join(t)) for i, t in rows]), items_of(spark, [(k, " ".join(t)) for k, t in items]))
    assert set(got) <= set(truth)
    assert all(got[x] == truth[x] for x in got)
    assert len(got) >= 0.95 * len(truth), (len(got), len(truth))
    exact = {x for x in truth if truth[x] == 0}
    assert exact <= set(got)


def fully_edited(rng, words, vocabulary, kind):
    """A fifth of the words edited: replaced, inserted and deleted in turn, or any of them."""
    count, out = len(words) // 5, list(words)
    if kind == "mixed":
        return edited(rng, words, vocabulary, count)
    if kind == "replaced":
        for at in rng.sample(range(len(out)), count):
            out[at] = rng.choice(vocabulary)
        return out
    for k in range(count):
        at = rng.randrange(len(out))
        out[at : at + k % 2] = [] if k % 2 else [rng.choice(vocabulary)]
    return out


def test_recall_by_item_length(spark, documents):
    rng = random.Random(34)
    vocabulary = [f"w{k}" for k in range(3000)]
    lengths, kinds, each = (1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 14, 15, 16, 18, 20, 24, 25, 30, 40, 60), ("replaced", "shifted", "mixed"), 100
    items, rows, truth = [], [], {}
    for n in lengths:
        for _ in range(each):
            items.append((len(items), rng.choices(vocabulary, k=n)))
            for kind in kinds:
                text = rng.choices(vocabulary, k=40)
                at = rng.randint(0, len(text))
                text[at:at] = fully_edited(rng, items[-1][1], vocabulary, kind)
                truth[len(rows), items[-1][0]] = (n, kind, brute(items[-1][1], text))
                rows.append((len(rows), text))
    got = found(documents([(i, " ".join(t)) for i, t in rows]), items_of(spark, [(k, " ".join(t)) for k, t in items]))
    assert all(got[x] == truth[x][2] for x in truth if x in got)
    share = {(n, kind): 0.0 for n in lengths for kind in kinds}
    for x, (n, kind, _) in truth.items():
        share[n, kind] += (x in got) / each
    assert min(share.values()) >= 0.9, share
    assert min(v for (n, _), v in share.items() if n < 5) > 0.999


def test_cases(spark, documents, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [
        (1, f"before {passage} after"), (2, passage.upper().replace(" ", ", ")), (3, None), (4, ""), (5, "tiny"),
        (6, " ".join(f"p{k}" for k in range(4, 20))), (7, "x " * 50_000 + passage), (1, "again"), (None, passage), (8, "p1 p2 p3"),
    ]
    items = items_of(spark, [(10, passage), (10, passage), (11, "tiny"), (12, None), (13, ""), (None, "x"), (14, "... !")])
    want = {(1, 10): 0, (2, 10): 0, (5, 11): 0, (6, 10): 4, (7, 10): 0}
    df = documents(rows, extra=["item_id", "n_edits"])
    assert found(df, items) == want
    monkeypatch.setattr(op, "BLOCK_BYTES", 40)
    assert found(df, items) == want
    assert found(df, items.limit(0)) == {} and found(df.limit(0), items) == {}
    kept = op.clean(df, items)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 8]
