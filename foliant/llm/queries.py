"""The training-data operators over their whole tables, as digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import (
    decontaminate,
    hard_negatives,
    html_extract,
    near_dedup,
    packing,
    periodic_runs,
    quality_rules,
    secret_scan,
    sharding,
    source_mixing,
    substring_dedup,
    surrogates,
    warc_archive,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, folder, "pages"))


def op2_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to a content-addressed archive and read back."""
    where = warc_archive.archive_folder(spark, f"warc-{uuid.uuid4().hex}")
    warc_archive.write(table(spark, folder, "pages"), where)
    found = warc_archive.read(spark, where)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs)


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_dedup.groups(table(spark, folder, "documents").select("doc_id", "text"), size=2, percent=80)


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs)
    spans = F.col("secrets")
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.digest_text(secret_scan.base_only(spans)), 256).alias("base_sha256"),
        secret_scan.digest_text(spans).alias("spans"),
    )


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without passages of smaller ids."""
    left = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with at most a fifth of its words edited."""
    return decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 512 to 8,192 words."""
    return packing.pack(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and the learned verdict for every document."""
    judged, _ = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "rule", "kept")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, equal texts together."""
    placed = sharding.shard_rows(table(spark, folder, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document, and its source's target."""
    mixed = source_mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", source_mixing.taken_words().alias("taken")
    )


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document's words, a tenth of them with planted tails."""
    found = periodic_runs.find_runs(table(spark, folder, "documents"), changed=True)
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(periodic_runs.listing(), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a seventh of the labels shifted."""
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.whole_vectors(table(spark, folder, "embeddings"), label=own)
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_warc_archive": op2_warc_archive,
    "op3_surrogates": op3_surrogates,
    "op4_near_dedup": op4_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_source_mixing": op11_source_mixing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
