"""Wall time of the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) has the tables, BENCH_CPUS the threads. Each query runs
once to warm up and once for the figure; its result goes to a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from loomgraph import workload

HEADLINE = [
    "cyclic_local_supplier", "label_scan_count", "node_scan_filter", "one_hop_count", "two_hop_count", "chain_2hop", "chain_star_join", "path_union_bag", "optional_match",
    "exists_semi", "not_exists_anti", "value_argmax", "group_agg_all", "order_nulls_topk", "repeat_bounded", "trail_paths", "shortest_len", "triangle_count", "nearest_topk",
    "nearest_per_anchor", "shortest_pinned",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run = workload.QUERIES[name]
        for _ in range(2):
            began = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
