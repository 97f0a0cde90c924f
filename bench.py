"""Time the headline queries: one JSON line on stdout."""

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rules_full_baseline", "rules_full_aggressive", "rule_hit_counts", "rules_top20", "detect_and_rank",
    "flow_features", "flow_iat_stats", "flow_summary", "packet_chunks",
    "fusion_confidence", "weight_sweep", "vote_risk",
    "roc_auc", "average_precision", "top1_hit_ceil", "best_f1_threshold", "ablation_table", "eval_by_file",
    "summary_by_file", "score_quantiles", "topn_reasons", "manifest_rollup",
    "align_schema", "label_index_first_seen", "balanced_sample", "stratified_split",
    "annotation_apply", "match_rows_by_key", "knn_vote",
]


def main():
    from flowspark.plans import load_queries
    from flowspark.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
        queries, _ = load_queries()
        times = {}
        for name in names:
            runs = []
            for _ in range(2):        # the first run warms up
                start = time.time()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.time() - start)
            times[name] = round(min(runs), 3)
            print(name, times[name], file=sys.stderr, flush=True)
        spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
