"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from gridlight.registry import logs, metrics, traces

HEADLINE = {
    "promql_instant_selector": metrics, "promql_sum_rate": metrics, "promql_increase": metrics, "promql_agg_topk": metrics,
    "promql_group_left": metrics, "promql_histogram_quantile": metrics, "promql_quantile_over_time": metrics, "promql_subquery": metrics,
    "logql_stream_limit": logs, "logql_filter_contains": logs, "logql_count_over_time": logs, "logql_rate": logs, "logql_sum_over_time": logs,
    "logs_label_names": logs, "logs_volume": logs, "logs_patterns": logs,
    "traceql_filter_attributes": traces, "traceql_child": traces, "traceql_descendant": traces, "traceql_search": traces,
    "traceql_rate": traces, "traceql_quantile_over_time": traces, "traceql_trace_by_id": traces, "traceql_service_graph": traces,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the JVM is up
    took = {}
    for name, module in HEADLINE.items():
        best = None
        for _ in range(2):
            began = time.perf_counter()
            module.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries, sum of best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
