import base64
import hashlib

from foliant.llm import warc_archive as op

PAGES = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a/", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (3, None, "<p>same</p>"),
    (2, "http://c/\r\nX: y", "é"), (4, "http://d/", None), (6, "http://e/", ""), (7, "u", "WARC/1.1\r\n\r\nx"),
    (7, "u", "WARC/1.1\r\n\r\nx"), (None, "n", "<p>same</p>"), (None, "n", "alone"),
]


def archive(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "'y' AS payload", "1 AS latest")
    op.write(df, str(tmp_path / "a"), **options)
    return str(tmp_path / "a")


def test_facts(spark, tmp_path):
    where = archive(spark, tmp_path, ROWS)
    got = op.read(spark, where).collect()
    assert len(got) == len(ROWS) and all(r["verified"] for r in got)
    assert spark.read.parquet(f"{where}/payloads").count() == 5
    seen = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert seen == [
        (0, "response", None), (0, "revisit", 5), (1, "revisit", 5), (2, "response", None), (3, "revisit", 5),
        (4, "revisit", 6), (5, "response", None), (6, "response", None), (7, "response", None), (7, "response", None),
    ]
    for r in got:
        body = next((h or "" for i, _, h in ROWS if i == r["page_id"] and i is not None), None)
        if body is not None:
            assert r["payload_bytes"] == len(body.encode())
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()


def test_exact_records(spark, tmp_path):
    where = archive(spark, tmp_path, ROWS)
    for r in op.restore(spark, where).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n"
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        if fields["WARC-Type"] == "response":
            digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert fields["WARC-Payload-Digest"] == digest
        else:
            assert payload == b"" and "WARC-Refers-To" in fields


def test_least_size(spark, tmp_path):
    got = op.read(spark, archive(spark, tmp_path, [(1, "", "a"), (2, "", "a"), (3, "", "abc"), (4, "", "abc")], min_bytes=2))
    assert sorted((r["page_id"], r["refers_to"]) for r in got.collect()) == [(1, None), (2, None), (3, 4), (4, None)]


def test_empty(spark, tmp_path):
    assert op.read(spark, archive(spark, tmp_path, [])).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    import pytest

    where = archive(spark, tmp_path, [(1, "", "a")])
    spark.read.parquet(f"{where}/payloads").selectExpr("digest", "cast('b' AS binary) AS payload").write.parquet(f"{where}2/payloads")
    spark.read.parquet(f"{where}/heads").write.parquet(f"{where}2/heads")
    with pytest.raises(Exception, match="payload lost its digest"):
        op.read(spark, f"{where}2").collect()
