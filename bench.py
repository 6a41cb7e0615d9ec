"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder and BENCH_CPUS the local cores. Each query is built and run in
full twice, results discarded by the noop sink; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ratelab.queries import QUERIES
from ratelab.session import local_session

HEADLINE = [
    "baseline_gap", "framing_gap_domains", "domain_score_types", "zscore_groups", "reference_gap_sem",
    "feature_divergence", "quality_words", "quality_rows", "distance_vs_score", "spearman_by_group", "most_biased_domain",
    "ols_line", "confidence_band", "group_medians", "running_mean", "rating_last_in_range", "normalize_tokens",
    "word_error_rate", "transcript_scores", "wer_table_wide", "vocab_semi_join", "clean_timestamps",
    "worklist_pending", "latest_valid_result", "first_occurrence", "batch_score_rerun", "manifest_unique",
    "dtw_pairs", "loo_pairs", "word_distances", "layer_sweep", "resample_clips", "top_n_per_group", "dense_grid",
]
RUNS = 2


def run(spark, folder: str, name: str) -> float:
    at = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - at


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ratelab-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {n: round(min(run(spark, folder, n) for _ in range(RUNS)), 3) for n in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
