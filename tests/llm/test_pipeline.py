import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import brute as counts
from tests.llm.test_secret_scan import brute as secrets

from foliant.llm import packing, quality_rules
from foliant.llm.decontaminate import plain_words


def test_stage_by_stage(spark):
    """Every stage on what its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, items = docs.columns, spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    rows = {r["doc_id"]: r for r in docs.collect()}
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged, _ = quality_rules.judge(docs, labels)
    kept = set()
    for r in judged.collect():
        n, *_, repeated = counts(rows[r["doc_id"]]["text"])
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        if not r["base_failed"] and r["rule"] is None:
            kept.add(r["doc_id"])

    def step(name, docs):
        out = by_name[name](spark, docs, SMALL)
        assert out.columns == columns
        return out, {r["doc_id"]: r for r in out.collect()}

    docs, rows = step("quality_rules", docs)
    assert set(rows) == kept

    groups = components([(i, r["text"]) for i, r in rows.items()], 5, 80)
    docs, rows = step("near_dedup", docs)
    assert set(rows) == set(groups.values())

    def holds(text):
        own = b" ".join(plain_words(text.encode()))
        return any(b" ".join(plain_words(i["text"].encode())) in own for i in items)

    clean = {i for i, r in rows.items() if not holds(r["text"])}
    docs, rows = step("decontamination", docs)
    assert set(rows) == clean

    before = rows
    docs, rows = step("secret_scan", docs)
    assert set(rows) == set(before)
    for i, r in rows.items():
        text, out, at = before[i]["text"], [], 0
        for start, _, end in secrets(text):
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])

    packed = by_name["packing"](spark, docs, SMALL).collect()
    check(packed, packing.SIZES, max(packing.SIZES))
    assert {r["doc_id"] for r in packed} == set(rows)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
