"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm medians, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

#: The published shapes, over the table nearest in size to the million rows they were measured on.
PROGRAMS = {
    "segment_summary": 'load "lineitem.parquet" | filter l_quantity > 10 | group_by l_returnflag | agg n = count(), m = mean(l_extendedprice), top = max(l_discount)',
    "top_scores": 'load "lineitem.parquet" | sort l_extendedprice desc, l_orderkey | limit 100 | select l_orderkey, l_extendedprice',
    "projection_smoke": 'load "lineitem.parquet" | select l_orderkey, l_quantity | limit 10000',
    "distinct_segments": 'load "lineitem.parquet" | distinct l_returnflag | select l_returnflag',
    "mutate": 'load "lineitem.parquet" | mutate net = l_extendedprice * (1 - l_discount), q = round(l_quantity / 3, 2), high = l_quantity > 25 | filter net > 20000 | agg n = count(), s = sum(net), q = sum(q)',
    "join_dimension": 'let s = load "supplier.parquet" load "lineitem.parquet" | join s on (l_suppkey, s_suppkey) | group_by s_nationkey | agg n = count(), q = sum(l_quantity)',
    "union_partitions": 'let a = load "lineitem.parquet" | filter l_linenumber <= 3 load "lineitem.parquet" | filter l_linenumber > 3 | union a | group_by l_returnflag | agg n = count()',
    "window_running": 'load "lineitem.parquet" | mutate r = sum(l_quantity) over (partition_by l_suppkey order_by l_shipdate, l_orderkey frame running) | agg top = max(r)',
    "dynamic_window_offsets": 'load "lineitem.parquet" | mutate p = lag(l_quantity, l_linenumber - 1, 0) over (partition_by l_orderkey order_by l_linenumber) | agg s = sum(p)',
    "pivot_longer": 'load "lineitem.parquet" | select l_orderkey, l_quantity, l_discount, l_tax | pivot_longer l_quantity, l_discount, l_tax names_to k values_to v | group_by k | agg s = sum(v)',
    "complete": 'load "orders.parquet" | group_by o_orderpriority, o_custkey | agg n = count() | complete o_orderpriority, o_custkey fill n = 0 | agg rows = count(), n = sum(n)',
    "temporal_buckets": 'load "events.parquet" | mutate d = date_floor(ts, "month") | group_by d, event_type | agg n = count(), v = mean(value)',
}


def main() -> None:
    from pyspark.sql import SparkSession

    from pipeweave.session import frame

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name, program in PROGRAMS.items():
        times = []
        for _ in range(RUNS + 1):
            t = time.perf_counter()
            frame(spark, program, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "warm_median_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
