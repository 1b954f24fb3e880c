"""Stages of the pipeline carry columns of any name."""

from foliant.llm import decontaminate, quality_rules, secret_scan

NAMES = ["_gone", "_hit", "_secret_text", "_secret_spans", "_SECRET_BASE", "row", "of", "own", "id", "body", "item_id"]


def test_any_names_pass(spark, documents):
    text = "one two three four five six seven eight nine ten " * 8 + "token = abcdef123456"
    df = documents([(1, text), (2, None), (None, text)], extra=NAMES)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "passage that no document holds at all")], "item_id bigint, text string")
    masked = secret_scan.mask_secrets(df)
    assert masked.columns == df.columns
    assert {r["_secret_text"] for r in masked.collect()} == {"x"}
    assert any("[SECRET]" in (r["text"] or "") for r in masked.collect())
    assert decontaminate.clean(df, items).columns == df.columns and decontaminate.clean(df, items).count() == 3
    left = quality_rules.reject(df, labels)
    assert left.columns == df.columns and left.count() <= 3
    assert secret_scan.scan(df).columns == [*df.columns, "secrets"]
