"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duewatch.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "study_population", "study_population_by_year", "missingness", "top_companies", "dim_company",
    "duplicate_ids", "undersample_negatives", "train_with_narratives", "score_label_join",
    "ranking_metrics", "pr_curve", "threshold_sweep", "final_test_summary", "model_comparison",
    "decile_lift", "triage_rank", "triage_queue", "triage_queue_head", "add_decile", "calibration_curve", "hosmer_lemeshow",
    "category_levels", "tfidf_terms", "logreg_coefficients", "score_population", "gbt_importance",
    "year_ablation",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")

    from catalog.queries import QUERIES

    only = sys.argv[1:] or HEADLINE
    QUERIES["decile_lift"](spark, SF_DIR).collect()  # JVM and codegen warm-up
    seconds = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
