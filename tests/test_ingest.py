"""OTLP mappings: what a document is read as, and how often it is read."""

import json

from pyspark.sql import functions as F

from gridlight.functions import histograms as H
from gridlight.sources import otlp


def _docs(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")


def _attr(k, v):
    return {"key": k, "value": {"stringValue": v}}


def test_documents_are_read_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    empty = _docs(spark, {})
    assert plan(otlp.otlp_metrics(empty)).count("LogicalRDD") == 1
    assert "MapInArrow" not in plan(otlp.otlp_histograms(empty))
    # two patterns for each of the three attribute lists
    assert plan(otlp.otlp_logs(empty).select("labels", "meta")).count("regexp_replace") <= 6


def test_metric_kinds(spark):
    point = {"timeUnixNano": "5000000", "attributes": [_attr("a.b", "1"), _attr("a_b", "2"), _attr("job", "x")]}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [{**point, "asDouble": 1.5}]}},
        {"name": "s", "sum": {"isMonotonic": True, "aggregationTemporality": 2, "dataPoints": [{**point, "asInt": "3"}]}},
        {"name": "d", "sum": {"isMonotonic": True, "aggregationTemporality": 1, "dataPoints": [{**point, "asInt": "3"}]}},
        {"name": "h", "histogram": {"dataPoints": [{**point, "count": "3", "sum": 2.0, "bucketCounts": ["1", "2"], "explicitBounds": [1]}, {**point, "count": "4"}]}},
        {"name": "q", "summary": {"dataPoints": [{**point, "count": "3", "sum": 2.0, "quantileValues": [{"quantile": 0.5, "value": 7}]}]}},
    ]
    doc = {"resourceMetrics": [{"resource": {"attributes": [_attr("service.name", "web")]}, "scopeMetrics": [{"metrics": metrics}]}]}
    rows = otlp.otlp_metrics(_docs(spark, doc)).collect()
    got = sorted(((r.metric, r.labels.get("le", "") + r.labels.get("quantile", ""), r.value) for r in rows), key=str)
    assert got == sorted([
        ("g", "", 1.5), ("s_total", "", 3.0), ("h_bucket", "1", 1.0), ("h_bucket", "+Inf", 3.0), ("h_sum", "", 2.0), ("h_count", "", 3.0),
        ("h_sum", "", None), ("h_count", "", 4.0), ("q", "0.5", 7.0), ("q_sum", "", 2.0), ("q_count", "", 3.0)], key=str)
    assert all(r.labels["job"] == "web" and r.labels["a_b"] == "1" and r.ts == 5 for r in rows)


def test_exponential_points(spark):
    cases = [(8, 0, [1, 0, 3], -1, [3]), (9, 0, [1, 3, 5], -3, [3, 4]), (11, -7, [1, 2, 0, 4, 5, 6, 7, 8, 9], 3, []), (-4, 2, [1], 0, [2]), (-5, 0, [1], 0, [])]
    points = [{"timeUnixNano": "1000000", "count": "9", "scale": s, "zeroCount": "2", "positive": {"offset": po, "bucketCounts": [str(n) for n in pos]},
               "negative": {"offset": no, "bucketCounts": [str(n) for n in neg]}} for s, po, pos, no, neg in cases]
    doc = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "e", "exponentialHistogram": {"dataPoints": points}}]}]}]}
    got = [H.Histogram.of(r.hist) for r in otlp.otlp_histograms(_docs(spark, doc)).select(F.col("hist")).collect()]
    assert got == [H.from_exponential(s, 2.0, 0.0, 9.0, 0.0, po, pos, no, neg) for s, po, pos, no, neg in cases if s >= H.MIN_SCHEMA]
