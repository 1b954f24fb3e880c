"""A content-addressed WARC archive: payloads once, record headers apart.

Payloads are stored once under their SHA-256; each record's exact header block
(WARC fields and HTTP head) is stored beside the digest of its payload. Equal
payloads are one ``response`` record, that of the largest page id, and
``revisit`` records without a payload of their own. The original records come
back through joins: bytes of a response are header and payload, a revisit is
its header alone, and facts of the full payload (length, SHA-1 recomputed from
the stored bytes) are joined to all of them. A stored payload that no longer
has its digest is an error.

A payload that a third of all records have is stored and read once; what is
joined on its digest are narrow stored tables, which the adaptive join splits.

Defined cases: a null html is an empty payload; a null url is an empty target;
rows that repeat a page id and payload are each written; null page ids never
are the largest, and a payload that has no other is all responses; extra
columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.sizing import settle, shared_dir

# Fixed values of the file format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
#: Date of all records of one archive run, so that a repeated task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
MIN_BYTES = 0


def base32(hex40: Column) -> Column:
    """Upper-case base 32 of a 160-bit digest in hexadecimal: 5 digits make 4."""
    out = []
    for group in range(8):
        value = F.conv(F.substring(hex40, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digit = F.shiftright(value, shift).bitwiseAND(F.lit(31))
            out.append(F.substring(F.lit(BASE32), digit + 1, F.lit(1)))
    return F.concat(*out)


def records(
    pages: DataFrame,
    row_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = MIN_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Header rows, and payload rows (digest, payload) with each payload once.

    Payloads below ``min_bytes`` are responses wherever they occur.
    """
    rows = pages.select(
        F.col(row_id).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    digest = F.sha2("payload", 256).alias("digest")
    narrow = settle(
        rows.select(
            "page_id",
            "url",
            digest,
            base32(F.sha1("payload")).alias("sha1"),
            F.octet_length("payload").cast("bigint").alias("size"),
        )
    )
    latest = settle(narrow.groupBy("digest").agg(F.max("page_id").alias("latest")))
    known = narrow.join(latest, "digest")
    own = F.col("page_id").eqNullSafe(F.col("latest")) | (F.col("size") < min_bytes) | F.col("latest").isNull()
    heads = known.select(
        "page_id",
        "digest",
        F.when(own, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        F.when(~own, F.col("latest")).alias("refers_to"),
        "url",
        "sha1",
        "size",
    )
    # Plain keys for null ids too, so that one exchange serves the join and the distinct rows.
    key = F.coalesce("page_id", F.lit(-(2**63))).alias("holder")
    first = latest.select("digest", F.col("latest").alias("page_id")).select("digest", key)
    payloads = rows.select(digest, key, "payload").join(first, ["digest", "holder"], "left_semi")
    payloads = payloads.dropDuplicates(["digest", "holder"]).select("digest", "payload")
    return heads.withColumn("head", _head()), payloads


def _head() -> Column:
    """Exact bytes before the payload, as text."""
    revisit = F.col("record_type") == "revisit"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(LINE + LINE),
    )
    length = F.octet_length(http).cast("bigint") + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(LINE, *fields), F.lit(LINE + LINE), http)


def write(pages: DataFrame, folder: str, **names) -> None:
    """Write ``heads`` and ``payloads`` below ``folder``."""
    heads, payloads = records(pages, **names)
    heads.select("page_id", "digest", F.col("head").cast("binary").alias("head")).write.parquet(f"{folder}/heads")
    payloads.write.parquet(f"{folder}/payloads")


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    broken = F.raise_error(F.concat(F.lit("payload lost its digest: "), F.col("digest")))
    return stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(broken.cast("binary")))


def field(head: Column, name: str) -> Column:
    """A WARC field of a header block, null where it is missing."""
    value = F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def _record_id(value: Column) -> Column:
    number = F.regexp_extract(value, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(number != "", number.cast("bigint"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Record facts from the archive: parsed headers and recomputed payload facts."""
    warc = F.element_at(F.split(F.col("head").cast("string"), LINE + LINE), 1)
    heads = spark.read.parquet(f"{folder}/heads").select("digest", warc.alias("warc"))
    facts = _verified(spark, folder).select(
        "digest",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
    )
    joined = heads.join(facts, "digest")
    w = F.col("warc")
    return joined.select(
        _record_id(field(w, "WARC-Record-ID")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field(w, "WARC-Type").alias("record_type"),
        _record_id(field(w, "WARC-Refers-To")).alias("refers_to"),
        field(w, "WARC-Target-URI").alias("url"),
        (field(w, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))).alias("verified"),
    )


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record): the original bytes of every record."""
    heads = spark.read.parquet(f"{folder}/heads")
    kind = field(F.element_at(F.split(F.col("head").cast("string"), LINE + LINE), 1), "WARC-Type")
    end = F.lit(LINE + LINE).cast("binary")
    own = heads.filter(kind == "response").join(_verified(spark, folder), "digest")
    own = own.select("page_id", F.concat("head", "payload", end).alias("record"))
    again = heads.filter(kind == "revisit").select("page_id", F.concat("head", end).alias("record"))
    return own.unionByName(again)


def archive_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an archive below the shared one; goes with the application."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
