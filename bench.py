"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query is drained into the no-op sink, so all columns and rows are computed.
One untimed run of the first query warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gatewise.plans.queries import QUERIES
from gatewise.session import local_session

HEADLINES = (
    "clean_shipped", "clean_documented", "checks_raw", "checks_clean", "profile",
    "audit_value_space", "audit_events_per_user", "audit_label_by_ip", "feat_all", "user_baselines",
    "tiers", "sample_events", "rule_score", "threshold_curve", "fpr_budget", "roc_auc", "replay",
    "ip_prior", "contract", "model_logistic",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session(cores, shuffle_partitions=cores)
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    drain(QUERIES[wanted[0]](spark, sf_dir))
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        drain(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
