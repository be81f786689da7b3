"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line: of one
cold and some warm runs each, the best warm one, the cold one, and percentiles by rank."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

#: Graph questions of the kinds that the baseline measures, and the widest operators.
HEADLINE = [
    "flagship_small_leg_owner",
    "funnel_accounts",
    "ring_3cycle",
    "int_top_channels",
    "int_same_owner_pairs",
    "int_fan_in",
    "int_structuring_party",
    "khop_reach_2",
    "ext_reach",
    "entity_lookup_exact",
    "count_anchored",
    "neighbors_collected",
    "degree_hint",
    "local_clustering",
    "l1_l2_levels",
    "connected_components",
    "memory_commit",
    "memory_asof",
    "lww_upsert",
    "vector_topk_cosine",
    "tfidf_rank",
]

#: Measured runs of each query after its cold one.
WARM = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from weftgraph import catalog

    catalog.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took, cold, all_warm = {}, {}, []
    for name in HEADLINE:
        runs = []
        for _ in range(1 + WARM):  # the first run compiles, the others have compiled code
            t = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        cold[name], took[name] = round(runs[0], 3), round(min(runs[1:]), 3)
        all_warm += runs[1:]
    all_warm.sort()
    rank = lambda p: round(all_warm[max(0, -(-int(p * len(all_warm)) // 100) - 1)], 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, best warm run, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "percentiles": {f"p{p}": rank(p) for p in (50, 95, 99)}, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
