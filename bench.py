"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from minekit.plans import all_queries  # noqa: E402

HEADLINES = [
    "relative_price_top",
    "window_ratio_table",
    "order_surprisal",
    "describe_columns",
    "null_profile",
    "price_box",
    "customer_summary",
    "order_calendar",
    "document_words",
    "fuzzy_names",
    "participant_flags",
    "repaired_participants",
    "nearest_three",
    "pearson",
    "location_dbscan",
    "silhouette_squared",
    "embedding_kmeans",
    "knn_uniform",
    "quality_scores",
    "tree_models",
    "daily_features",
    "event_moving_stats",
    "event_profile",
    "streamed_profile",
    "spearman",
    "k_sweep_scores",
    "event_motifs",
    "reconciled_places",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("minekit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    known, seconds = all_queries(), {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.time()
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
