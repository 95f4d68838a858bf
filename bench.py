"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores, BENCH_RUNS
the timed runs per query (the median counts), BENCH_QUERIES a comma list.
Every query runs to its last row; rows are produced and dropped, not collected.
"""

import json
import os
import statistics
import sys
import time

from clauselake.plans.catalog import QUERIES
from clauselake.session import local_session

HEADLINE = ("clean_documents", "pii_redact_documents", "pii_report", "doc_metadata", "sections_hier", "risk_type_matrix",
            "risks", "clauses", "terms", "cross_references", "extract_info", "section_summaries", "metric_rows",
            "training_risk", "measure_histogram")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, "bench", memory=os.environ.get("BENCH_MEMORY", "12g"), shuffle=int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in names:
        seconds = []
        for _ in range(runs):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.time() - start)
        times[name] = round(statistics.median(seconds), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
