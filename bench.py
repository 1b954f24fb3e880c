"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores,
BENCH_QUERIES an optional comma-separated choice (``all`` for every query).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from check import session
from foliant import workloads
from foliant.functions import tokens as tk

HEADLINE = (
    "normalize_text",
    "clean_then_cap",
    "article_split",
    "token_ids",
    "vocab_encode",
    "lm_samples",
    "mixed_shape_samples",
    "capped_per_source",
    "chunk_lm",
    "chunk_qa",
    "chunk_shifted",
    "chunk_copy_back",
    "news_plan_v1",
    "mixture_feed",
    "training_feed",
    "chunk_reservoir",
    "softmax_rows",
    "kl_masked",
    "bigram_perplexity",
    "ppl_report",
    "pad_batches",
    "context_state",
    "emitted_chunks",
    "stream_chunk_emit",
    "vector_mix",
)


def run(df: DataFrame) -> None:
    """Compute every row and column without storing them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(workloads.QUERIES) if chosen == "all" else chosen.split(",")
    spark = session(cpus)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    size = docs.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size(tk.words(F.col("text")))).alias("tokens")
    ).first()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(workloads.QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)

    rates = {
        name: {
            "rows_per_sec": round(size["rows"] / seconds[name]),
            "tokens_per_sec": round(size["tokens"] / seconds[name]),
        }
        for name in ("token_ids", "chunk_lm", "bigram_perplexity", "ppl_report")
        if name in seconds
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
                "documents": size["rows"],
                "tokens": size["tokens"],
                "rates": rates,
            }
        )
    )


if __name__ == "__main__":
    main()
