"""Benchmark of the headline queries.

Runs each query over the mapped tables of ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is fully executed through the ``noop`` sink (the whole plan runs,
nothing is collected to the driver); the figure per query is the median of
``$BENCH_RUNS`` warm runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillspark.registry import QUERIES, present  # noqa: E402
from tillspark.session import local_session  # noqa: E402
from tillspark.sources.mapping import Retail  # noqa: E402

HEADLINE = [
    "period_kpis", "pnl_statement", "kpis_all_presets", "timeseries_day", "top_products", "sale_list",
    "inventory_by_category", "stock_ledger", "cash_breakdown", "cash_ledger", "supplier_ledger",
    "fifo_allocation", "fifo_links", "repayments_applied", "asof_cost", "intake_sales", "invoice_lines",
    "reconcile", "dashboard_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tillspark-bench")
    times: dict[str, float] = {}
    for name in names:
        def run():
            t0 = time.perf_counter()  # scans write their blocks while the query is built: that is part of it
            df = present(QUERIES[name](Retail(spark, sf_dir)))
            df.write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up: JIT, file listing, codegen caches
        times[name] = round(statistics.median(run() for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
