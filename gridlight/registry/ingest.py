"""Ingest mappings over documents made from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import catalog as C
from ..sources import otlp, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _docs(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """An export document per event, built with format_string from a JSON shape."""
    e = views.spread(views.table(spark, sf_dir, "events"))
    micros = views.micros(e["ts"])
    return e.select(F.format_string(shape, "event_type", "user_id", "event_id", micros).alias("value"))


_RES = '{"attributes":[{"key":"service.name","value":{"stringValue":"%1$s"}},{"key":"host.id","value":{"intValue":"%2$d"}}]}'
LOGS = '{"resourceLogs":[{"resource":' + _RES + ',"scopeLogs":[{"scope":{"name":"sc"},"logRecords":[{"timeUnixNano":"%4$d000","severityNumber":9,"body":{"stringValue":"event %3$d"},"attributes":[{"key":"n","value":{"intValue":"%3$d"}}]}]}]}]}'
METRICS = '{"resourceMetrics":[{"resource":' + _RES + ',"scopeMetrics":[{"metrics":[{"name":"seen","sum":{"isMonotonic":true,"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"%4$d000","asInt":"%3$d"}]}},{"name":"lag","histogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"%4$d000","count":"6","sum":2.5,"bucketCounts":["1","2","3"],"explicitBounds":[0.5,1]}]}}]}]}]}'
TRACES = '{"resourceSpans":[{"resource":' + _RES + ',"scopeSpans":[{"scope":{"name":"lib","version":"2"},"spans":[{"traceId":"t%3$d","spanId":"s","name":"op-%1$s","kind":2,"startTimeUnixNano":"%4$d000","endTimeUnixNano":"%4$d900","attributes":[{"key":"n","value":{"intValue":"%3$d"}}],"status":{"code":2},"events":[{"timeUnixNano":"%4$d100","name":"ev"}]}]}]}]}'
ZIPKIN = '[{"traceId":"%3$d","id":"z","kind":"CLIENT","name":"get","timestamp":%4$d,"duration":%2$d,"localEndpoint":{"serviceName":"%1$s"},"tags":{"error":"true"}}]'
PUSH = '{"streams":[{"stream":{"app":"%1$s","host.id":"%2$d"},"values":[["%4$d000","event %3$d",{"n":"%3$d"}]]}]}'
_E = "(SELECT event_type, user_id, event_id, epoch_us(ts) AS us FROM events)"


def _add(name: str, shape: str, f, sql: str) -> None:
    QUERIES[f"ingest_{name}"] = lambda spark, sf_dir: f(_docs(spark, sf_dir, shape))
    ORACLES[f"ingest_{name}"] = sql


_pick = lambda c, *names: [L.get(F.col(c), n).alias(n) for n in names]
_add("otlp_logs", LOGS, lambda d: otlp.otlp_logs(d).select("ts", "line", *_pick("labels", "service_name", "host_id"), *_pick("meta", "scope_name", "n")),
     f"SELECT us * 1000 AS ts, 'event ' || event_id AS line, event_type AS service_name, CAST(user_id AS VARCHAR) AS host_id, 'sc' AS scope_name, CAST(event_id AS VARCHAR) AS n FROM {_E}")
_add("otlp_metrics", METRICS, lambda d: otlp.otlp_metrics(d).select("metric", "ts", *_pick("labels", "job", "le"), "value"),
     f"SELECT m AS metric, us // 1000 AS ts, event_type AS job, le, CAST(CASE m WHEN 'seen_total' THEN event_id ELSE v END AS DOUBLE) AS value FROM {_E}, (VALUES ('seen_total', '', 0), ('lag_bucket', '0.5', 1), ('lag_bucket', '1', 3), ('lag_bucket', '+Inf', 6), ('lag_sum', '', 2.5), ('lag_count', '', 6)) t(m, le, v)")
_add("otlp_spans", TRACES, lambda d: otlp.otlp_spans(d).select("trace_id", "span_id", "parent_id", "name", "service", "ts_ns", "duration_ns", "status", "kind", "scope_name"),
     f"SELECT 't' || event_id AS trace_id, 's' AS span_id, '' AS parent_id, 'op-' || event_type AS name, event_type AS service, us * 1000 AS ts_ns, 900 AS duration_ns, 2 AS status, 2 AS kind, 'lib' AS scope_name FROM {_E}")
_add("otlp_attrs", TRACES, lambda d: otlp.otlp_attrs(d).groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("val").alias("vals"), F.sum("val_num").cast("long").alias("total")),
     "SELECT scope, key, count(*) AS n, count(DISTINCT val) AS vals, CAST(sum(TRY_CAST(val AS DOUBLE)) AS BIGINT) AS total FROM (SELECT 'span' AS scope, 'n' AS key, event_id::VARCHAR AS val FROM events UNION ALL SELECT 'resource', 'service.name', event_type FROM events UNION ALL SELECT 'resource', 'host.id', user_id::VARCHAR FROM events UNION ALL SELECT 'event', 'event:name', 'ev' FROM events UNION ALL SELECT 'event', 'event:timeSinceStart', '100' FROM events) GROUP BY ALL")
_add("zipkin_spans", ZIPKIN, lambda d: otlp.zipkin_spans(d).select("trace_id", "span_id", "service", "ts_ns", "duration_ns", "status", "kind"),
     f"SELECT lpad(CAST(event_id AS VARCHAR), 32, '0') AS trace_id, 'z' AS span_id, event_type AS service, us * 1000 AS ts_ns, user_id * 1000 AS duration_ns, 2 AS status, 3 AS kind FROM {_E}")
_add("push_logs", PUSH, lambda d: otlp.push_logs(d).select("ts", "line", *_pick("labels", "service_name", "host_id"), *_pick("meta", "n")),
     f"SELECT us * 1000 AS ts, 'event ' || event_id AS line, event_type AS service_name, CAST(user_id AS VARCHAR) AS host_id, CAST(event_id AS VARCHAR) AS n FROM {_E}")

EXPONENTIAL = (
    '{"resourceMetrics":[{"resource":' + _RES + ',"scopeMetrics":[{"metrics":[{"name":"took","exponentialHistogram":{"aggregationTemporality":2,"dataPoints":['
    '{"timeUnixNano":"%4$d000","count":"9","sum":%3$d.5,"scale":9,"zeroCount":"2","positive":{"offset":0,"bucketCounts":["1","3"]},"negative":{"offset":-1,"bucketCounts":["3"]}},'
    '{"timeUnixNano":"%4$d000","count":"1","scale":-5,"positive":{"offset":0,"bucketCounts":["1"]}}]}}]}]}]}'
)
_add("otlp_histograms", EXPONENTIAL, lambda d: otlp.otlp_histograms(d).select(
    "metric", "ts", *_pick("labels", "job"), "hist.schema", "hist.count", "hist.sum", "hist.zero_count",
    F.to_json("hist.pos").alias("pos"), F.to_json("hist.neg").alias("neg")),
    f"""SELECT 'took' AS metric, us // 1000 AS ts, event_type AS job, 8 AS schema, 9.0::DOUBLE AS count, event_id + 0.5::DOUBLE AS sum, 2.0::DOUBLE AS zero_count, '[{{"i":1,"n":4.0}}]' AS pos, '[{{"i":0,"n":3.0}}]' AS neg FROM {_E}""")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric per event type; each of its events restates type, help and unit."""
    e = views.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("metric"), F.when(F.col("event_id") % 2 == 0, "counter").otherwise("gauge").alias("type"),
                    F.concat(F.lit("help "), F.col("event_id").cast("string")).alias("help"), F.lit("s").alias("unit"), F.col("event_id").alias("updated_ns"))
    return C.latest_metadata(rows)


def _unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views.gauge(spark, sf_dir)
    fresh = otlp.new_series(seen, seen.where("labels['event_type'] < 'm'"))
    return fresh.select("metric", *_pick("labels", "event_type", "user_id"))


QUERIES["ingest_metadata"] = _metadata
ORACLES["ingest_metadata"] = "SELECT event_type AS metric, CASE WHEN max(event_id) % 2 = 0 THEN 'counter' ELSE 'gauge' END AS type, 'help ' || max(event_id) AS help, 's' AS unit FROM events GROUP BY event_type"
QUERIES["ingest_new_series"] = _unregistered
ORACLES["ingest_new_series"] = "SELECT DISTINCT 'event_value' AS metric, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type >= 'm'"
