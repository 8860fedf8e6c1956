"""Headline queries on the driver tables; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
Every query is planned and run to the last row (``noop`` sink) once and then
``BENCH_RUNS`` times more; the best time counts, so a cold JVM does not.  No
plan or fitted model is kept from run to run.  Learners are fitted once each and
reported beside the total.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_queries, model_queries, registry  # noqa: E402
from loanloom.session import local_session  # noqa: E402

HEADLINE = (
    "loan_table",
    "historical_net_loss_by_vintage",
    "historical_net_loss_by_disposition",
    "performance_counts",
    "acquisition_statistics",
    "purpose_by_vintage",
    "origination_summary",
    "panel_carry_forward",
    "panel_modification_costs",
    "first_credit_event",
    "combined_table",
    "default_rate_by_state",
    "label_category_counts",
    "density_curves",
    "roc_auc",
    "stratified_split",
)
LEARNERS = ("boosted_classifier", "neural_net")


def forget() -> None:
    """Drops the plans and models that the registered queries share."""
    for module in (registry, model_queries):
        for kept in vars(module).values():
            if hasattr(kept, "cache_clear"):
                kept.cache_clear()


def run(query, spark, sf_dir: str) -> float:
    forget()
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    times = {}
    for name in HEADLINE:
        times[name] = round(min(run(registered[name], spark, sf_dir) for _ in range(runs + 1)), 3)
    learners = {name: round(run(registered[name], spark, sf_dir), 3) for name in LEARNERS}
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "learners": learners,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
