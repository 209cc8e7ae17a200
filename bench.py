"""Benchmark: headline queries, each from a cold start, at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Stages shared between queries are forgotten before each query, so a time
includes everything from the input tables to the result."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("s04_dedupe_detections", "v01_confusion_counts", "v05_per_fire_csi", "v18_per_fire_ap", "v12_band_confusion",
            "v27_split_summary", "s09_select_messages", "s11_weather_scan", "e01_link_graph", "e02_connected_components",
            "l11_burn_cells", "v07_ring_baseline")
BUDGET = 300.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from perimeter.plans import library
    from perimeter.storage import forget_stages
    runs, times, begin = library.runnable(), {}, time.time()
    spark.read.parquet(f"{folder}/events.parquet").selectExpr("sum(value)").collect()
    for name in HEADLINE:
        if time.time() - begin > BUDGET:
            print(f"skipped {name}: over budget", file=sys.stderr)
            continue
        forget_stages()
        start = time.time()
        runs[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
