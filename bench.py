"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the number of
local cores (default 8), BENCH_QUERIES an optional list of name prefixes separated by commas.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigrain.plans.catalog import QUERIES  # noqa: E402
from lexigrain.session import local_session  # noqa: E402

HEADLINE = [
    "d08_top_tokens_per_label",
    "b07_merge_rare_labels",
    "b11_category_codes",
    "c05_tokens",
    "c06_clean_tokens",
    "c08_tidy_words",
    "c12_sentence_count",
    "c17_word_frequency_maps",
    "c18_sentiment",
    "d04_token_count_summary",
    "d05_correlation",
    "d07_token_counts_per_label",
    "d11_class_weights",
    "d14_vocabulary",
    "d15_top_features_tf",
    "e01_filter_tokens",
    "e03_term_frequency",
    "e04_tfidf_collection",
    "e05_fit_train_apply_test",
    "e06_feature_vectors",
    "e07_normalised_tfidf",
    "e11_principal_components",
    "f01_positional_split",
    "f03_seeded_shuffle",
    "f04_bootstrap",
    "f06_stratified_folds",
    "t06_best_split",
    "t08_train_tree",
    "t12_forest_prediction",
    "t16_naive_bayes",
    "t18_predictive_terms",
    "t20_weighted_cross_entropy",
    "t22_batched_scoring",
    "v07_class_scores",
    "v12_classification_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    names = [n for n in QUERIES if n.startswith(tuple(wanted))] if wanted else HEADLINE
    spark = local_session(cpus, partitions=cpus)
    # compile and load what every text query uses before the first measurement
    QUERIES["c06_clean_tokens"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    line = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
