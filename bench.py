"""Seconds per headline query, warm, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tablesmith.plans import load_all
from tablesmith.plans.registry import QUERIES
from tablesmith.session import local_session

HEADLINE = [
    "region_sales", "join_multi", "customer_summary", "category_summary", "crosstab_sum", "running_total", "rank_in_month",
    "spend_percentile", "moving_avg_all", "dedup_first", "profile_columns", "describe_numeric", "duplicate_rows",
    "recon_row_diff", "csv_documents", "recon_keyed_diff", "csv_roundtrip", "table_copy", "text_checksums", "line_diff", "keyword_topk",
    "template_flags", "cycle_detection", "code_access", "order_workflow",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    load_all()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    line = {
        "metric": "median seconds per query, summed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
