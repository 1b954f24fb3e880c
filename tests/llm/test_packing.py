import random
from collections import Counter, defaultdict
from functools import lru_cache

from foliant.llm import packing as op


def check(rows, sizes, largest):
    bins = defaultdict(list)
    for r in rows:
        bins[r["pack_group"], r["bin"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["position"])
        at = 0
        for r in held:
            assert r["position"] == at
            at += r["length"]
        capacity = {r["capacity"] for r in held}
        assert capacity == {min(s for s in sizes if s >= at)}
    return bins


def test_everything_is_packed_once(documents):
    rng = random.Random(2)
    rows = [(k, "w " * int(rng.paretovariate(0.6) * 5)) for k in range(400)]
    rows = [(k, t[:200_000]) for k, t in rows] + [(900, None), (901, ""), (902, " \n"), (None, "a b"), (1, rows[1][1])]
    df = documents(rows, extra=["length", "bin", "piece"])
    for sizes, group in ((op.SIZES, op.GROUP_TOKENS), ((16, 64, 256), 2000)):
        got = op.pack(df, sizes=sizes, group_tokens=group).collect()
        check(got, sizes, max(sizes))
        want = Counter()
        for i, t in rows:
            want[i] += len((t or "").split()) + 1
        have = Counter()
        for r in got:
            have[r["doc_id"]] += r["length"]
            assert r["first"] == r["piece"] * max(sizes)
        assert have == want
    assert op.pack(df.limit(0)).count() == 0


def test_bins_shrink_and_fill():
    assert [c for _, _, c in op.best_fit([3], (4, 8, 16))] == [4]
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 700) for _ in range(5000)), reverse=True)
    packed = op.best_fit(lengths, (512, 1024, 2048))
    capacity = {b: c for b, _, c in packed}
    assert sum(lengths) / sum(capacity.values()) > 0.99


def best_total(lengths, sizes):
    """Least sum of capacities over all ways to pack, by search."""

    @lru_cache(None)
    def solve(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = 10**9
        for mask in range(1 << len(rest)):
            used = first + sum(x for k, x in enumerate(rest) if mask >> k & 1)
            if used <= max(sizes):
                other = tuple(x for k, x in enumerate(rest) if not mask >> k & 1)
                best = min(best, min(s for s in sizes if s >= used) + solve(other))
        return best

    return solve(tuple(lengths))


def test_close_to_the_optimum():
    rng = random.Random(4)
    ours = least = 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 8))), reverse=True)
        packed = op.best_fit(lengths, (8, 12, 16))
        ours += sum({b: c for b, _, c in packed}.values())
        least += best_total(lengths, (8, 12, 16))
    assert least <= ours <= 1.12 * least


def test_same_rows_however_dealt(spark, documents):
    df = documents([(k, "w " * (k % 37)) for k in range(300)])
    a = op.pack(df.repartition(7), group_tokens=500).collect()
    b = op.pack(df.coalesce(1), group_tokens=500).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
