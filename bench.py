"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from strataframe.plans.registry import QUERIES, load_all
from strataframe.session import local_session

HEADLINE = [
    "flagship_risk_intervals", "s4_upsert", "j5_asof_backward", "j8_interval_fallback", "j9_band_join", "j10_label_windows",
    "j12_geo_neighbors", "a4_leave_one_out_priors", "a5_nearest_rank", "a6_event_density", "w2_local_ratio", "w3_trailing_slope",
    "w9_merge_intervals", "w10_episodes_variable_hold", "r1_bm25", "r3_tfidf_vectors", "r5_cosine_topk", "r6_rank_fusion",
    "c1_rank_offsets_pressure", "c4_heuristic_risk", "m1_build_features", "m2_training_rows", "m15_roc_auc", "m18_best_threshold",
    "m30_score_intervals", "m32_explain_logistic", "t6_suppression", "t7_consolidation", "t4_stream_history",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
