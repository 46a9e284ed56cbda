"""Benchmark the headline operators on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric": "total_sec", "value": N, "unit": "sec",
"queries": {name: sec, ...}, "sf": ...}. Each query is fully executed (noop
sink for DataFrames), after an untimed warm-up pass over the sf0.001 tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans.registry import all_queries  # noqa: E402
from ledgerline.session import get_spark  # noqa: E402

HEADLINE = [
    "BQ9",       # KPI root cause over all dimensions (flagship)
    "BQ1",       # top region with share of total
    "BQ3",       # largest month-over-month decline
    "BQ5",       # trend projection
    "AGG13",     # insight summary
    "DQ1",       # column profile
    "DQ13",      # full cleaning: dedup, impute, clip
    "AGG1",      # numeric summary with exact quantiles
    "AGG2",      # categorical summary top-10
    "AGG3",      # correlation matrix after median fill
    "AGG6",      # histogram, automatic bins
    "AGG9",      # chart group-by
    "AGG10",     # two-key pivot
    "JN2",       # dimension lookups
    "SET1",      # regex search across tables, whole texts
    "ML16",      # KS drift
    "FC4",       # Fourier-trend forecast per series
    "FC6",       # best-of-three forecast per series
    "AN1",       # isolation forest
    "ST1",       # rate-limit window
]


def _run(q, spark, sf):
    t0 = time.perf_counter()
    df = q.fn(spark, sf)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus * 2)
    queries = all_queries()
    wanted = [a for a in sys.argv[1:]] or HEADLINE
    # Warm-up on the tiny sf0.001 tables (other files, so nothing is cached):
    # JIT, generated-code compilation and Python workers, as on a running cluster.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf):
        for name in wanted:
            _run(queries[name], spark, warm)
    times = {}
    for name in wanted:
        times[name] = round(_run(queries[name], spark, sf), 3)
    m = re.search(r"sf([0-9.]+)", sf)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(m.group(1)) if m else sf}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
