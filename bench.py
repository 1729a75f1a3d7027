"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corpusloom.registry.queries import QUERIES
from corpusloom.scratch import drop_tables

HEADLINE = [
    "top_words",
    "corpus_stats_metrics",
    "stopword_removed",
    "subsample_tokens",
    "normalize_text",
    "clean_markup",
    "wiki_tokens_filtered",
    "docs_with_pair_tokens",
    "docs_with_pair_substring",
    "bigram_vocab_crossline",
    "phrase_scores",
    "phrase_joined_lines",
    "phrase_two_pass",
    "nearest_k",
    "analogy_offset",
    "analogy_unit_mean",
    "doc_embedding_mean",
    "spearman_positional",
    "pca_points",
    "w2v_fit_vectors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["word_count_min"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every column of every row is computed
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total wall-clock of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
    }
    print(json.dumps(result))
    drop_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
