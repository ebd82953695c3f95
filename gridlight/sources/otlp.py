"""Ingest mappings: OTLP/JSON, log push and Zipkin documents to rows.

Documents are parsed with fixed schemas (no inference pass), exploded and projected;
all of it is Columns.  Wire codecs (protobuf, snappy) are out of scope: Spark's readers
decompress files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histograms as H
from ..functions import labels as L
from ..functions import numeric as N

_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
_ATTR = f"array<struct<key: string, value: {_VALUE}>>"
_SCOPE = f"struct<name: string, version: string, attributes: {_ATTR}>"
_RESOURCE = f"struct<attributes: {_ATTR}>"
LOGS = (
    f"resourceLogs array<struct<resource: {_RESOURCE}, scopeLogs: array<struct<scope: {_SCOPE}, logRecords: array<struct<"
    f"timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, body: {_VALUE}, attributes: {_ATTR}, traceId: string, spanId: string>>>>>>"
)
_POINT = f"struct<attributes: {_ATTR}, timeUnixNano: string, asDouble: double, asInt: string>"
_HIST = f"struct<attributes: {_ATTR}, timeUnixNano: string, count: string, sum: double, bucketCounts: array<string>, explicitBounds: array<double>>"
_SUMMARY = f"struct<attributes: {_ATTR}, timeUnixNano: string, count: string, sum: double, quantileValues: array<struct<quantile: double, value: double>>>"
_SIDE = "struct<offset: int, bucketCounts: array<string>>"
_EXPONENTIAL = (
    f"struct<attributes: {_ATTR}, timeUnixNano: string, count: string, sum: double, scale: int, zeroCount: string, zeroThreshold: double, "
    f"positive: {_SIDE}, negative: {_SIDE}>"
)
METRICS = (
    f"resourceMetrics array<struct<resource: {_RESOURCE}, scopeMetrics: array<struct<scope: {_SCOPE}, metrics: array<struct<"
    f"name: string, unit: string, description: string, gauge: struct<dataPoints: array<{_POINT}>>, "
    f"sum: struct<dataPoints: array<{_POINT}>, aggregationTemporality: int, isMonotonic: boolean>, "
    f"histogram: struct<dataPoints: array<{_HIST}>, aggregationTemporality: int>, "
    f"exponentialHistogram: struct<dataPoints: array<{_EXPONENTIAL}>, aggregationTemporality: int>, summary: struct<dataPoints: array<{_SUMMARY}>>>>>>>>"
)
_EVENT = f"struct<timeUnixNano: string, name: string, attributes: {_ATTR}>"
_LINK = f"struct<traceId: string, spanId: string, attributes: {_ATTR}>"
TRACES = (
    f"resourceSpans array<struct<resource: {_RESOURCE}, scopeSpans: array<struct<scope: {_SCOPE}, spans: array<struct<"
    f"traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, "
    f"attributes: {_ATTR}, status: struct<code: int, message: string>, events: array<{_EVENT}>, links: array<{_LINK}>>>>>>>"
)
ZIPKIN = (
    "array<struct<traceId: string, id: string, parentId: string, kind: string, name: string, timestamp: bigint, duration: bigint, shared: boolean, "
    "localEndpoint: struct<serviceName: string>, tags: map<string,string>>>"
)
PUSH = "streams array<struct<stream: map<string,string>, values: array<array<string>>>>"

#: Labels that name a log's service, most important first.
SERVICE_LABELS = ("service_name", "service", "app", "application", "name", "job", "container")


def _text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))


def canonical(name: Column) -> Column:
    """A label name: everything but letters, digits and _ becomes _; no digit first."""
    return F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), "^([0-9])", "_$1")


def _map(attrs: Column, clean: bool = True) -> Column:
    """Attribute list as a map; of clashing names the first stays."""
    pairs = F.transform(F.coalesce(attrs, F.array()), lambda a: F.named_struct(F.lit("k"), canonical(a["key"]) if clean else a["key"], F.lit("v"), _text(a["value"])))
    pairs = F.filter(pairs, lambda p: p["v"].isNotNull())
    firsts = lambda ps, ks: F.filter(ps, lambda p, i: F.array_position(ks, p["k"]) == i + 1)
    return F.map_from_entries(N.let(pairs, lambda ps: N.let(F.transform(ps, lambda p: p["k"]), lambda ks: firsts(ps, ks))))


def _under(base: str, more: str) -> Column:
    """Map ``base`` with the entries of ``more`` whose names it lacks.  Both are columns: an
    expression within a lambda would be computed once an entry."""
    return F.map_concat(base, F.map_filter(more, lambda k, v: ~F.map_contains_key(F.col(base), k)))


def _documents(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with a JSON document per row in column ``value``."""
    return df.select(F.from_json("value", schema).alias("d")).select("d.*")


def otlp_logs(df: DataFrame) -> DataFrame:
    """labels (resource), meta (scope and record), key, ts, line, severity."""
    r = _documents(df, LOGS).select(F.explode("resourceLogs").alias("r")).select(_map(F.col("r.resource.attributes")).alias("labels"), "r.scopeLogs")
    service = F.coalesce(F.element_at("labels", F.lit("service_name")), F.lit("unknown_service"))
    s = r.select(L.put(F.col("labels"), "service_name", service).alias("labels"), F.explode("scopeLogs").alias("s"))
    x = s.select("labels", "s.scope", _map(F.col("s.scope.attributes")).alias("extra"), F.explode("s.logRecords").alias("l"))
    scope = F.map_filter(
        F.create_map(F.lit("scope_name"), F.col("scope.name"), F.lit("scope_version"), F.col("scope.version"), F.lit("trace_id"), F.col("l.traceId"), F.lit("span_id"), F.col("l.spanId"), F.lit("severity_text"), F.col("l.severityText")),
        lambda k, v: F.coalesce(v, F.lit("")) != "",
    )
    ts = F.coalesce(F.nullif(F.col("l.timeUnixNano").cast("long"), F.lit(0)), F.col("l.observedTimeUnixNano").cast("long"))
    rest = ["labels", ts.alias("ts"), _text(F.col("l.body")).alias("line"), F.coalesce("l.severityNumber", F.lit(0)).cast("byte").alias("severity")]
    x = x.select(*rest, scope.alias("scope"), _map(F.col("l.attributes")).alias("record"), "extra")
    x = x.select("labels", "ts", "line", "severity", _under("scope", "record").alias("both"), "extra")
    out = x.select("labels", _under("both", "extra").alias("meta"), "ts", "line", "severity")
    return out.withColumn("key", L.series_key(F.col("labels")))


def _metrics(df: DataFrame) -> tuple[DataFrame, Column]:
    """base (a point's labels off its resource) and m (a metric) of each document, the metric's name."""
    r = _documents(df, METRICS).select(F.explode("resourceMetrics").alias("r"))
    r = r.select(_map(F.col("r.resource.attributes")).alias("res"), "r.scopeMetrics")
    res = F.map_filter("res", lambda k, v: k.isin("service_name", "service_instance_id"))
    base = F.transform_keys(res, lambda k, v: F.when(k == "service_name", "job").otherwise("instance"))
    s = r.select(base.alias("base"), F.explode("scopeMetrics").alias("s"))
    return s.select("base", F.explode("s.metrics").alias("m")), canonical(F.col("m.name"))


_CUMULATIVE = "coalesce(m.{0}.aggregationTemporality, 2) = 2"


def otlp_histograms(df: DataFrame) -> DataFrame:
    """metric, labels, key, ts (ms), hist, stale of cumulative exponential points.  Scales
    beyond the finest schema are merged, those below the coarsest rejected."""
    m, name = _metrics(df)
    rows = m.where("m.exponentialHistogram IS NOT NULL").where(_CUMULATIVE.format("exponentialHistogram"))
    rows = rows.select("base", name.alias("metric"), F.explode("m.exponentialHistogram.dataPoints").alias("p"))
    rows = rows.where(F.coalesce("p.scale", F.lit(0)) >= H.MIN_SCHEMA)
    points = rows.select("metric", "base", _map(F.col("p.attributes")).alias("own"), N.whole_div(F.col("p.timeUnixNano").cast("long"), 10**6).alias("ts"), H.of_exponential(F.col("p")).alias("hist"))
    out = points.select("metric", _under("base", "own").alias("labels"), "ts", "hist")
    return out.withColumn("key", L.series_key(F.col("labels"))).withColumn("stale", F.lit(False))


def otlp_metrics(df: DataFrame) -> DataFrame:
    """metric, labels, key, ts (ms), value, stale; delta temporality (1) is rejected.
    Histograms and summaries fan out to ``_bucket``/``_sum``/``_count`` and quantile series.
    Documents are read once: each metric becomes a list of points, a point one of samples."""
    m, name = _metrics(df)
    none = F.lit(None).cast("string")
    # a sample: suffix of the metric's name, a label of its own with its text, value
    sample = lambda suffix, v, label=none, text=none: F.struct(
        suffix.alias("suffix"), label.alias("label"), text.alias("text"), v.cast("double").alias("value"))
    plain = F.lit("")
    monotonic = F.when(F.col("m.sum.isMonotonic") & ~F.col("metric").endswith("_total"), "_total").otherwise("")
    number = lambda suffix: lambda p: F.array(sample(suffix, F.coalesce(p["asDouble"], p["asInt"].cast("double"))))
    totals = lambda p: F.array(sample(F.lit("_sum"), p["sum"]), sample(F.lit("_count"), p["count"]))

    def buckets(p: Column) -> Column:
        bounds = F.concat(F.transform(p["explicitBounds"], lambda b: F.regexp_replace(b.cast("string"), r"\.0$", "")), F.array(F.lit("+Inf")))
        upto = lambda counts, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"), lambda a, c: a + c)
        series = lambda counts: F.transform(bounds, lambda le, i: sample(F.lit("_bucket"), upto(counts, i), F.lit("le"), le))
        return N.let(F.transform(p["bucketCounts"], lambda c: c.cast("long")), series)

    def quantiles(p: Column) -> Column:
        return F.transform(p["quantileValues"], lambda q: sample(plain, q["value"], F.lit("quantile"), q["quantile"].cast("string")))

    def points(kind: str, *samples: Callable[[Column], Column], where: str = "true") -> Column:
        of = lambda p: F.concat(*[F.coalesce(f(p), F.array()) for f in samples])
        found = F.transform(F.col(f"m.{kind}.dataPoints"), lambda p: F.struct(p["attributes"].alias("attributes"), p["timeUnixNano"].alias("at"), of(p).alias("samples")))
        return F.coalesce(F.when(F.expr(where), found), F.array())

    every = F.concat(
        points("gauge", number(plain)), points("sum", number(monotonic), where=_CUMULATIVE.format("sum")),
        points("histogram", buckets, totals, where=_CUMULATIVE.format("histogram")), points("summary", quantiles, totals),
    )
    rows = m.withColumn("metric", name).select("base", "metric", every.alias("every")).select("base", "metric", F.explode("every").alias("p"))
    rows = rows.select("base", "metric", _map(F.col("p.attributes")).alias("own"), N.whole_div(F.col("p.at").cast("long"), 10**6).alias("ts"), "p.samples")
    rows = rows.select("metric", _under("base", "own").alias("labels"), "ts", F.explode("samples").alias("x"))
    others = F.map_filter("labels", lambda k, v: k != F.col("x.label"))
    text = F.coalesce("x.text", F.lit(""))
    labels = F.when(F.col("x.label").isNull(), F.col("labels")).when(text == "", others).otherwise(F.map_concat(others, F.create_map(F.coalesce("x.label", F.lit("")), text)))
    out = rows.select(F.concat("metric", "x.suffix").alias("metric"), labels.alias("labels"), "ts", "x.value")
    return out.withColumn("key", L.series_key(F.col("labels"))).withColumn("stale", F.lit(False))


def _spans(df: DataFrame) -> DataFrame:
    r = _documents(df, TRACES).select(F.explode("resourceSpans").alias("r"))
    s = r.select("r.resource", F.explode("r.scopeSpans").alias("s"))
    return s.select("resource", "s.scope", F.explode("s.spans").alias("x"))


def otlp_spans(df: DataFrame) -> DataFrame:
    start = F.col("x.startTimeUnixNano").cast("long")
    service = F.element_at(_map(F.col("resource.attributes"), clean=False), F.lit("service.name"))
    return _spans(df).select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.coalesce("x.parentSpanId", F.lit("")).alias("parent_id"), F.col("x.name").alias("name"),
        F.coalesce(service, F.lit("unknown_service")).alias("service"), start.alias("ts_ns"), F.greatest(F.col("x.endTimeUnixNano").cast("long") - start, F.lit(0)).alias("duration_ns"),
        F.when(F.col("x.status.code") == 1, 1).when(F.col("x.status.code") == 2, 2).otherwise(0).alias("status"),
        F.coalesce("x.kind", F.lit(0)).alias("kind"), F.coalesce("x.status.message", F.lit("")).alias("status_message"),
        F.coalesce("scope.name", F.lit("")).alias("scope_name"), F.coalesce("scope.version", F.lit("")).alias("scope_version"),
    )


def otlp_attrs(df: DataFrame) -> DataFrame:
    """trace_id, span_id, scope, key, val, val_num of spans, resources, scopes, events and links."""
    x = _spans(df).select("resource", "scope", "x")
    one = lambda scope, attrs: F.transform(F.coalesce(attrs, F.array()), lambda a: F.struct(F.lit(scope).alias("scope"), a["key"].alias("key"), _text(a["value"]).alias("val")))
    pair = lambda scope, key, v: F.struct(F.lit(scope).alias("scope"), F.lit(key).alias("key"), v.alias("val"))
    events, links = F.coalesce("x.events", F.array()), F.coalesce("x.links", F.array())
    start = F.col("x.startTimeUnixNano").cast("long")
    every = F.concat(
        one("span", F.col("x.attributes")), one("resource", F.col("resource.attributes")), one("instrumentation", F.col("scope.attributes")),
        F.flatten(F.transform(events, lambda e: F.concat(one("event", e["attributes"]), F.array(pair("event", "event:name", e["name"]), pair("event", "event:timeSinceStart", (e["timeUnixNano"].cast("long") - start).cast("string")))))),
        F.flatten(F.transform(links, lambda e: F.concat(one("link", e["attributes"]), F.array(pair("link", "link:traceID", e["traceId"]), pair("link", "link:spanID", e["spanId"]))))),
    )
    rows = x.select(F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), every.alias("every"))
    rows = rows.select("trace_id", "span_id", F.explode("every").alias("a")).select("trace_id", "span_id", "a.*")
    return rows.where("val IS NOT NULL").distinct().withColumn("val_num", F.col("val").try_cast("double"))


def push_logs(df: DataFrame) -> DataFrame:
    """Log push documents: streams of [ts, line] or [ts, line, metadata] entries."""
    s = _documents(df, PUSH).select(F.explode("streams").alias("s"))
    x = s.select("s.stream", F.explode("s.values").alias("v"))
    labels = F.transform_keys("stream", lambda k, v: canonical(k))
    service = F.coalesce(*[F.element_at(labels, F.lit(n)) for n in SERVICE_LABELS], F.lit("unknown_service"))
    named = F.when(F.map_contains_key(labels, F.lit("service_name")), labels).otherwise(F.map_concat(labels, F.create_map(F.lit("service_name"), service)))
    meta = F.coalesce(F.from_json(F.get("v", F.lit(2)), "map<string,string>"), L.no_labels())
    out = x.select(named.alias("labels"), meta.alias("meta"), F.get("v", F.lit(0)).cast("long").alias("ts"), F.get("v", F.lit(1)).alias("line"))
    return out.withColumn("key", L.series_key(F.col("labels")))


def zipkin_spans(df: DataFrame) -> DataFrame:
    """Zipkin v2 spans; shared server spans hang below the client span of the same id."""
    x = df.select(F.explode(F.from_json("value", ZIPKIN)).alias("z")).select("z.*")
    kind = F.when(F.col("kind") == "SERVER", 2).when(F.col("kind") == "CLIENT", 3).when(F.col("kind") == "PRODUCER", 4).when(F.col("kind") == "CONSUMER", 5).otherwise(1)
    error = F.element_at("tags", F.lit("error"))
    return x.select(
        F.lpad("traceId", 32, "0").alias("trace_id"), F.col("id").alias("span_id"), F.coalesce("parentId", F.lit("")).alias("parent_id"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("localEndpoint.serviceName", F.lit("unknown_service")).alias("service"), (F.col("timestamp") * 1000).alias("ts_ns"), (F.coalesce("duration", F.lit(0)) * 1000).alias("duration_ns"),
        F.when(error.isNotNull() & (F.lower(error) != "false"), 2).otherwise(0).alias("status"), kind.alias("kind"), F.coalesce(error, F.lit("")).alias("status_message"), F.lit("").alias("scope_name"), F.lit("").alias("scope_version"),
    )


def new_series(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Series rows that are not registered yet, each once."""
    return seen.dropDuplicates(["metric", "key"]).join(known.select("metric", "key"), ["metric", "key"], "left_anti")


def write_by_day(df: DataFrame, path: str, ts: str, per_second: int, sort: list[str]) -> None:
    """Append rows partitioned by day and sorted for pruning by identity and time."""
    day = F.to_date(F.timestamp_seconds(N.whole_div(F.col(ts), per_second)))
    df.withColumn("day", day).repartition("day").sortWithinPartitions(*sort).write.mode("append").partitionBy("day").parquet(path)
