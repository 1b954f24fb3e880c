import zlib
from collections import Counter, defaultdict

from foliant.llm import sharding as op


def placed(df, **options):
    return op.shard_rows(df, **options).collect()


def check_law(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_even_with_few_cut_links(documents):
    rows = [(k, f"own text {k}") for k in range(600)] + [(1000 + k, f"copy {k % 60}") for k in range(300)]
    got = placed(documents(rows, extra=["shard", "slot", "link"]))
    check_law(got, op.SHARDS)
    text = dict(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    where = defaultdict(Counter)
    for r in got:
        body = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
        where[body][r["shard"]] += 1
    cut = sum(sum(c.values()) - max(c.values()) for c in where.values())
    assert cut <= 0.1 * 300


def test_a_third_of_all_rows_is_one_text(documents):
    got = placed(documents([(k, "same" if k % 3 == 0 else f"t{k}") for k in range(1200)]))
    check_law(got, op.SHARDS)
    shards = Counter(r["shard"] for r in got if r["doc_id"] % 3 == 0)
    # 400 copies need 8 shards of 50; propagation brings them into few.
    assert len(shards) <= 16


def test_cases(documents):
    rows = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "b"), (None, None), (4, "é" * 100_000)]
    df = documents(rows)
    got = placed(df, shards=3)
    check_law(got, 3)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, len((t or "").encode()) + 8) for i, t in rows)
    assert {r["text_crc32"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert placed(df.limit(0)) == []
    check_law(placed(df.limit(1)), op.SHARDS)


def test_same_result_however_dealt(documents):
    df = documents([(k, f"copy {k % 40}") for k in range(300)])
    assert sorted(map(tuple, placed(df.repartition(5)))) == sorted(map(tuple, placed(df.coalesce(1))))


def test_cut_links(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 1), (None, 1)], "link bigint, shard int")
    assert tuple(op.cut_links(rows).first()) == (4, 1)


def test_no_python_in_the_plan(documents):
    assert "Python" not in op.shard_rows(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
