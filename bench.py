"""Time headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import local_session

HEADLINE = (
    "trades_to_candles_daily",
    "inspect_trades",
    "hourly_profile",
    "detect_A",
    "detect_B",
    "detect_C",
    "visit_facts",
    "measure_outcome",
    "weighted_metrics",
    "rolling_vap",
    "native_score",
    "raw_map",
    "crossings",
    "zone_flow_windows",
    "reprice_states",
    "score_history",
    "midrank_expanding",
    "block_bootstrap",
    "stream_candles_from_trades",
)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    queries = catalog.queries()
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
