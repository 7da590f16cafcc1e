"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Every query is forced with the no-op sink (full computation, nothing
preprocessing chain (L1), the fold statistics and fold preprocessing
(E2-E5, E11), the metric / blend passes (A11-A14, A12), exact quantiles and
ranks, and CV of one model (L2 with M1).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p11_engineered",        # L1 chain: quantile cut, imputation, ordinal codes
    "a2_quantiles",          # exact distributed quantiles
    "w1_rank_all",           # exact global ranks, no global window
    "k1_folds_exact",        # exact k-fold assignment
    "e2_target_encoding",    # out-of-fold target encoding
    "e11_fold_preprocess",   # full fold preprocessing, all 5 folds (E0 expanded output)
    "a11_fold_metrics",      # fold metrics, single + ensemble
    "a13_a14_cv_summary",    # CV summary
    "a12_blend_weight",      # weight search
    "m1_l2_tree_cv",         # L2: 5-fold CV of the tree model
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from foldwise.plans.registry import load_all
    from foldwise.session import get_session

    spark = get_session(f"local[{cpus}]", int(cpus) * 2)
    q, _ = load_all()
    names = sys.argv[1:] or HEADLINE
    # untimed warm-up: JVM start, parquet reader and codegen paths (session cost, not query cost)
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    spark.range(100000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id").collect()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
