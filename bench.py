"""Time the headline queries and print one JSON line.

Each query runs to the end with its rows discarded (the noop sink), once to warm the JVM and then
`BENCH_RUNS` times; the middle time counts. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose the
data, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tillroll_checks.queries import QUERIES
from tillroll.session import local_session

HEADLINE = (
    "minor_units",
    "type_amazon",
    "type_billing",
    "fact_amazon",
    "mtd_superseded",
    "fact_after_supersession",
    "sku_classify",
    "sku_promote",
    "accrual_rows",
    "accrual_daily",
    "monitor_files",
    "recon_adyen",
    "recon_adyen_levels",
    "recon_amazon",
    "vendor_reference_lists",
    "settlement_recon",
    "delay_percentiles",
    "subs_trend",
    "active_subs",
    "subs_due",
    "affiliate_share",
    "sox_acquired",
    "sox_failures",
)


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(cores=cores)
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores,
        "runs": runs,
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
