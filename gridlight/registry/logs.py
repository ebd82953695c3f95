"""LogQL and log-catalogue queries over the events and documents tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import catalog as C
from ..plans.logql import LogEngine
from ..sources import views
from .metrics import _r, _rounded

NS = 10**9
H = 3600 * NS
START, END, STEP = 1_704_153_600 * NS, 1_706_486_400 * NS, 6 * H
AT = 1_705_276_800 * NS
DAY0, DAY1 = 1_705_190_400 * NS, AT
#: All events: 2024 up to March.
FIRST, LAST = 1_704_067_200 * NS - 1, 1_709_251_200 * NS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_GRID = f"g AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS step)"
_S = (
    "s AS (SELECT event_type, user_id, CAST(floor(value * 100) AS BIGINT) AS cents, props, event_id, epoch_us(ts) * 1000 AS ts, "
    "'event_type=' || event_type || ' user=' || user_id || ' value=' || CAST(floor(value * 100) AS BIGINT) || ' ' || props AS line FROM events)"
)


def _w(span: int, offset: int = 0) -> str:
    return f"w AS (SELECT g.step, s.* FROM g JOIN s ON s.ts > g.step - {offset} - {span} AND s.ts <= g.step - {offset})"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLES[name] = sql


def metric(name: str, text: str, labels: tuple[str, ...], sql: str | None, source=views.log_events, instant: bool = False, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = LogEngine(spark, source(spark, sf_dir))
        out = engine.metric(text, AT) if instant else engine.metric(text, START, END, STEP)
        return out.select("step", *[L.get(F.col("labels"), n).alias(n) for n in labels], _rounded(F.col("value"), digits).alias("value"))

    _add(f"logql_{name}", run, sql)


def lines(name: str, text: str, labels: tuple[str, ...], sql: str | None, source=views.log_events, limit: int | None = None, window=(FIRST, LAST), meta=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        if meta is not None:
            rows = rows.withColumn("meta", meta())
        out = LogEngine(spark, rows).logs(text, *window, limit=limit)
        return out.select("ts", "line", *[L.get(F.col("labels"), n).alias(n) for n in labels])

    _add(f"logql_{name}", run, sql)


T = ("event_type",)
_IN = f"ts > {FIRST} AND ts <= {LAST}"
_DAY = f"ts > {DAY0} AND ts <= {DAY1}"
_BASE = f"WITH {_S} SELECT ts, line, event_type"

# line filters and labels
lines("stream", '{event_type=~"click|view"}', T, f"{_BASE} FROM s WHERE {_IN} AND event_type IN ('click', 'view')")
lines("stream_limit", '{event_type=~".+"}', T, f"{_BASE} FROM s WHERE {_IN} ORDER BY ts DESC, event_type, line LIMIT 25", limit=25)
lines("window", '{event_type="error"}', T, f"{_BASE} FROM s WHERE {_DAY} AND event_type = 'error'", window=(DAY0, DAY1))
lines("filter_contains", '{event_type=~".+"} |= "user=1" or "user=2" != "value=9"', T, f"{_BASE} FROM s WHERE {_IN} AND (contains(line, 'user=1') OR contains(line, 'user=2')) AND NOT contains(line, 'value=9')")
lines("filter_regex", '{event_type=~".+", event_type!="view"} |~ "user=\\\\d+5 " !~ "value=[12]"', T, f"{_BASE} FROM s WHERE {_IN} AND event_type <> 'view' AND regexp_matches(line, 'user=\\d+5 ') AND NOT regexp_matches(line, 'value=[12]')")
lines("filter_regex_raw", '{event_type=~".+", event_type!="view"} |~ `user=\\d+5 ` !~ `value=[12]`', T, f"{_BASE} FROM s WHERE {_IN} AND event_type <> 'view' AND regexp_matches(line, 'user=\\d+5 ') AND NOT regexp_matches(line, 'value=[12]')")
lines("logfmt", '{event_type=~".+"} | logfmt | user="17"', ("event_type", "event_type_extracted", "user", "value"), f"WITH {_S} SELECT ts, line, event_type, event_type AS event_type_extracted, CAST(user_id AS VARCHAR) AS user, CAST(cents AS VARCHAR) AS value FROM s WHERE {_IN} AND user_id = 17")
lines("logfmt_targeted", '{event_type=~".+"} | logfmt u="user", nope | u=~"1."', ("u", "nope"), f"WITH {_S} SELECT ts, line, CAST(user_id AS VARCHAR) AS u, '' AS nope FROM s WHERE {_IN} AND user_id BETWEEN 10 AND 19")
lines("label_filter_number", '{event_type=~".+"} | logfmt | value >= 5000 and user < 20 or value < 100', ("user", "value"), f"WITH {_S} SELECT ts, line, CAST(user_id AS VARCHAR) AS user, CAST(cents AS VARCHAR) AS value FROM s WHERE {_IN} AND ((cents >= 5000 AND user_id < 20) OR cents < 100)")
lines("label_filter_error", '{event_type="click"} | logfmt | event_type_extracted > 3', ("__error__",), f"WITH {_S} SELECT ts, line, 'LabelFilterErr' AS __error__ FROM s WHERE {_IN} AND event_type = 'click'")
lines("regexp", '{event_type="error"} | regexp `user=(?P<u>\\d+) value=(?P<v>\\d+)`', ("u", "v"), f"WITH {_S} SELECT ts, line, CAST(user_id AS VARCHAR) AS u, CAST(cents AS VARCHAR) AS v FROM s WHERE {_IN} AND event_type = 'error'")
lines("pattern", '{event_type="error"} | pattern `<_> user=<u> value=<v> <rest>`', ("u", "v", "rest"), f"WITH {_S} SELECT ts, line, CAST(user_id AS VARCHAR) AS u, CAST(cents AS VARCHAR) AS v, props AS rest FROM s WHERE {_IN} AND event_type = 'error'")
_J = (
    "s AS (SELECT event_type, user_id, CAST(floor(value * 100) AS BIGINT) AS cents, props, epoch_us(ts) * 1000 AS ts, "
    "'{\"user\":{\"id\":' || user_id || ',\"kind\":\"' || event_type || '\"},\"took\":\"' || CAST(floor(value * 100) AS BIGINT) || 'ms\",\"size\":\"' || user_id || 'KB\",\"props\":' || props || '}' AS line FROM events)"
)
lines("json", '{event_type="purchase"} | json | user_id=~"1.*"', ("user_id", "user_kind", "took", "props_k"), f"WITH {_J} SELECT ts, line, CAST(user_id AS VARCHAR) AS user_id, event_type AS user_kind, cents || 'ms' AS took, json_extract_string(props, '$.k') AS props_k FROM s WHERE {_IN} AND event_type = 'purchase' AND CAST(user_id AS VARCHAR) LIKE '1%'", source=views.log_json)
lines("json_targeted", '{event_type="purchase"} | json id="user.id", k="props.k" | id=~"1.*"', ("id", "k"), f"WITH {_J} SELECT ts, line, CAST(user_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS k FROM s WHERE {_IN} AND event_type = 'purchase' AND CAST(user_id AS VARCHAR) LIKE '1%'", source=views.log_json)
lines("json_error", '{event_type="click"} | json', ("__error__",), f"WITH {_S} SELECT ts, line, 'JSONParserErr' AS __error__ FROM s WHERE {_IN} AND event_type = 'click'")
lines("label_filter_duration", '{event_type="view"} | json | took > 5s', ("took",), f"WITH {_J} SELECT ts, line, cents || 'ms' AS took FROM s WHERE {_IN} AND event_type = 'view' AND cents > 5000", source=views.log_json)
lines("label_filter_bytes", '{event_type="view"} | json | size <= 20KB', ("size",), f"WITH {_J} SELECT ts, line, user_id || 'KB' AS size FROM s WHERE {_IN} AND event_type = 'view' AND user_id <= 20", source=views.log_json)
lines("line_format", '{event_type="error"} | logfmt | line_format "{{.user}}:{{.event_type | ToUpper}}"', ("user",), f"WITH {_S} SELECT ts, user_id || ':ERROR' AS line, CAST(user_id AS VARCHAR) AS user FROM s WHERE {_IN} AND event_type = 'error'")
lines("line_format_template", '{event_type="error"} | logfmt | line_format "{{if gt (int .value) 5000}}big{{else}}small{{end}} {{add 1 .user}}"', (), f"WITH {_S} SELECT ts, CASE WHEN cents > 5000 THEN 'big' ELSE 'small' END || ' ' || (user_id + 1) AS line FROM s WHERE {_IN} AND event_type = 'error'")
lines("label_format", '{event_type="error"} | logfmt | label_format who=user, what="{{.event_type}}-{{.value}}"', ("user", "who", "what"), f"WITH {_S} SELECT ts, line, '' AS user, CAST(user_id AS VARCHAR) AS who, 'error-' || cents AS what FROM s WHERE {_IN} AND event_type = 'error'")
lines("drop_keep", '{event_type="error"} | logfmt | drop value, user="7" | keep user, value, event_type', ("event_type", "user", "value", "event_type_extracted"), f"WITH {_S} SELECT ts, line, event_type, CASE WHEN user_id = 7 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user, '' AS value, '' AS event_type_extracted FROM s WHERE {_IN} AND event_type = 'error'")
_PACK = lambda s, d: views.log_events(s, d).withColumn("line", F.to_json(F.struct(F.lit("p").alias("pod"), F.col("line").alias("_entry"))))
lines("unpack", '{event_type="error"} | unpack', ("pod",), f"WITH {_S} SELECT ts, line, 'p' AS pod FROM s WHERE {_IN} AND event_type = 'error'", source=_PACK)
_COLOR = lambda s, d: views.log_events(s, d).withColumn("line", F.concat(F.lit("\u001b[31m"), "line", F.lit("\u001b[0m")))
lines("decolorize", '{event_type="error"} | decolorize', (), f"WITH {_S} SELECT ts, line FROM s WHERE {_IN} AND event_type = 'error'", source=_COLOR)
lines("metadata", '{event_type="error"} | trace="t"', ("trace", "event_type_extracted"), f"WITH {_S} SELECT ts, line, 't' AS trace, 'm' AS event_type_extracted FROM s WHERE {_IN} AND event_type = 'error'", meta=lambda: F.create_map(F.lit("trace"), F.lit("t"), F.lit("event_type"), F.lit("m")))
_IPS = lambda s, d: views.log_events(s, d).withColumn("line", F.concat(F.lit("from 10.0."), F.regexp_extract("line", r"user=(\d+)", 1), F.lit(".9 ok")))
lines("filter_ip", '{event_type="error"} |= ip("10.0.16.0/21")', (), f"WITH {_S} SELECT ts, 'from 10.0.' || user_id || '.9 ok' AS line FROM s WHERE {_IN} AND event_type = 'error' AND user_id BETWEEN 16 AND 23", source=_IPS)
lines("label_filter_ip", '{event_type="error"} | pattern `from <a> ok` | a=ip("10.0.3.1-10.0.5.255")', ("a",), f"WITH {_S} SELECT ts, 'from 10.0.' || user_id || '.9 ok' AS line, '10.0.' || user_id || '.9' AS a FROM s WHERE {_IN} AND event_type = 'error' AND user_id BETWEEN 3 AND 5", source=_IPS)

# range aggregations
_M = _with(_GRID, _S, _w(24 * H))
_U = '{event_type=~".+"} | logfmt | drop event_type_extracted, user, k | unwrap value'
metric("count_over_time", 'count_over_time({event_type=~".+"}[1d])', T, _M + "SELECT step, event_type, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL")
metric("rate", 'rate({event_type=~".+"} |= "user=1" [1d])', T, _M + f"SELECT step, event_type, {_r('count(*) / 86400', 9)} AS value FROM w WHERE contains(line, 'user=1') GROUP BY step, event_type", digits=9)
metric("bytes_over_time", 'bytes_over_time({event_type=~".+"}[1d])', T, _M + "SELECT step, event_type, CAST(sum(strlen(line)) AS DOUBLE) AS value FROM w GROUP BY step, event_type")
metric("bytes_rate", 'bytes_rate({event_type=~".+"}[1d])', T, _M + f"SELECT step, event_type, {_r('sum(strlen(line)) / 86400')} AS value FROM w GROUP BY step, event_type")
for _fn, _agg in {"sum": "sum(cents)", "avg": "avg(cents)", "min": "min(cents)", "max": "max(cents)", "stddev": "stddev_pop(cents)", "stdvar": "var_pop(cents)", "first": "arg_min(cents, ts)", "last": "arg_max(cents, ts)"}.items():
    metric(f"{_fn}_over_time", f"{_fn}_over_time({_U} [1d])", T, _M + f"SELECT step, event_type, {_r(_agg, 4)} AS value FROM w GROUP BY step, event_type", digits=4)
metric("unwrap_rate", f"rate({_U} [1d])", T, _M + f"SELECT step, event_type, {_r('sum(cents) / 86400')} AS value FROM w GROUP BY step, event_type")
metric("quantile_over_time", f"quantile_over_time(0.95, {_U} [1d])", T, _M + f"SELECT step, event_type, {_r('quantile_cont(cents, 0.95)', 4)} AS value FROM w GROUP BY step, event_type", digits=4)
metric("range_grouping", 'max_over_time({event_type=~".+"} | logfmt | unwrap value [1d]) by (event_type)', T, _M + "SELECT step, event_type, CAST(max(cents) AS DOUBLE) AS value FROM w GROUP BY step, event_type")
metric("unwrap_duration", 'sum by (event_type) (sum_over_time({event_type=~".+"} | json | unwrap duration(took) [1d]))', T, _M + f"SELECT step, event_type, {_r('sum(cents) / 1000', 3)} AS value FROM w GROUP BY step, event_type", source=views.log_json, digits=3)
metric("unwrap_bytes", 'sum by (event_type) (sum_over_time({event_type=~".+"} | json | unwrap bytes(size) [1d]))', T, _M + "SELECT step, event_type, CAST(sum(user_id) * 1000 AS DOUBLE) AS value FROM w GROUP BY step, event_type", source=views.log_json)
metric("offset", 'count_over_time({event_type=~".+"}[6h] offset 1d)', T, _with(_GRID, _S, _w(6 * H, 24 * H)) + "SELECT step, event_type, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL")
metric("absent_over_time", 'absent_over_time({event_type="signup"}[1h])', T, _with(_GRID, _S, _w(H)) + "SELECT step, 'signup' AS event_type, 1.0::DOUBLE AS value FROM g WHERE step NOT IN (SELECT step FROM w WHERE event_type = 'signup')")
metric("rate_counter", f"rate_counter({_U} [1d])", T, _with(
    _GRID, _S, _w(24 * H), "p AS (SELECT *, lag(cents) OVER (PARTITION BY step, event_type ORDER BY ts) AS pv FROM w)",
    # the range counts in seconds, sampled times in microseconds: the language's own mix of units
    "a AS (SELECT step, event_type, count(*) AS n, arg_min(cents, ts) AS fv, arg_max(cents, ts) - arg_min(cents, ts) + sum(CASE WHEN cents < pv THEN pv ELSE 0 END) AS res, (max(ts) - min(ts)) / 1000.0 AS si FROM p GROUP BY ALL)",
    "b AS (SELECT *, si / (n - 1) AS av, CASE WHEN res > 0 AND fv >= 0 THEN least(86400.0, si * (fv / res)) ELSE 86400.0 END AS ds FROM a WHERE n > 1)")
    + f"SELECT step, event_type, {_r('CAST(res AS DOUBLE) * ((si + CASE WHEN ds < av * 1.1 THEN ds ELSE av / 2 END + CASE WHEN 0 < av * 1.1 THEN 0 ELSE av / 2 END) / si) / 86400', 6)} AS value FROM b "
    "UNION ALL SELECT step, event_type, 0.0::DOUBLE FROM a WHERE n = 1")
metric("instant", 'sum(count_over_time({event_type=~".+"}[1d]))', (), f"WITH {_S} SELECT CAST({AT} AS BIGINT) AS step, CAST(count(*) AS DOUBLE) AS value FROM s WHERE {_DAY}", instant=True)

# vector aggregations, operators
_RU = 'count_over_time({event_type=~".+"} | logfmt | drop value, k, event_type_extracted [1d])'
_I = _M[:-1] + ", i AS (SELECT step, event_type, user_id, CAST(count(*) AS DOUBLE) AS v FROM w GROUP BY ALL) "
for _op, _agg in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    metric(f"agg_{_op}", f"{_op} by (event_type) ({_RU})", T, _I + f"SELECT step, event_type, {_r(_agg, 10)} AS value FROM i GROUP BY step, event_type", digits=10)
_KEY = "'{\"event_type\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}'"
for _op, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    metric(f"agg_{_op}", f"{_op} by (event_type) (2, {_RU})", ("event_type", "user"), _I + f"SELECT step, event_type, CAST(user_id AS VARCHAR) AS user, v AS value FROM i QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY v {_dir}, {_KEY}) <= 2")
_ONE = f"WITH {_S}, i AS (SELECT event_type, user_id, CAST(count(*) AS DOUBLE) AS v FROM s WHERE {_DAY} GROUP BY ALL) "
metric("agg_approx_topk", f"approx_topk(5, {_RU})", ("event_type", "user"), _ONE + f"SELECT CAST({AT} AS BIGINT) AS step, event_type, CAST(user_id AS VARCHAR) AS user, v AS value FROM i ORDER BY v DESC, {_KEY} LIMIT 5", instant=True)
for _op in ("sort", "sort_desc"):
    metric(f"agg_{_op}", f"{_op}(sum by (event_type) ({_RU}))", T, _ONE + f"SELECT CAST({AT} AS BIGINT) AS step, event_type, sum(v) AS value FROM i GROUP BY event_type", instant=True)
_C = 'count_over_time({event_type=~".+"}[1d])'
_CI = _M[:-1] + ", i AS (SELECT step, event_type, CAST(count(*) AS DOUBLE) AS v FROM w GROUP BY ALL) "
metric("binary_arithmetic", f"{_C} * 2 - {_C} / 4 + 2 ^ 3", T, _CI + f"SELECT step, event_type, {_r('v * 2 - v / 4 + 8')} AS value FROM i")
metric("binary_compare", f"{_C} > 70", T, _CI + "SELECT step, event_type, v AS value FROM i WHERE v > 70")
metric("binary_bool", f"{_C} > bool 70", T, _CI + "SELECT step, event_type, CAST(v > 70 AS INT)::DOUBLE AS value FROM i")
metric("binary_group_left", f"{_RU} / on (event_type) group_left () sum by (event_type) ({_RU})", ("event_type", "user"), _I[:-1] + f", t AS (SELECT step, event_type, sum(v) AS tv FROM i GROUP BY ALL) SELECT step, event_type, CAST(user_id AS VARCHAR) AS user, {_r('v / tv')} AS value FROM i JOIN t USING (step, event_type)")
metric("binary_and", f'{_C} and count_over_time({{event_type=~"click|view"}}[1d])', T, _CI + "SELECT step, event_type, v AS value FROM i WHERE event_type IN ('click', 'view')")
metric("binary_unless", f'{_C} unless count_over_time({{event_type=~"click|view"}}[1d])', T, _CI + "SELECT step, event_type, v AS value FROM i WHERE event_type NOT IN ('click', 'view')")
metric("binary_or", f'count_over_time({{event_type="click"}}[1d]) or {_C}', T, _CI + "SELECT step, event_type, v AS value FROM i")
metric("vector", "vector(7)", (), _with(_GRID) + "SELECT step, 7.0::DOUBLE AS value FROM g")
metric("label_replace", f'label_replace({_C}, "x", "$1!", "event_type", "(..).*")', ("event_type", "x"), _CI + "SELECT step, event_type, left(event_type, 2) || '!' AS x, v AS value FROM i")
metric("variants", 'variants(count_over_time({event_type=~".+"}[1d]), bytes_over_time({event_type=~".+"}[1d])) of ({event_type=~".+"}[1d])', ("event_type", "__variant__"), _M + "SELECT step, event_type, '0' AS __variant__, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY step, event_type UNION ALL SELECT step, event_type, '1', CAST(sum(strlen(line)) AS DOUBLE) FROM w GROUP BY step, event_type")


# catalogue
def _cat(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None, source=views.log_events) -> None:
    _add(f"logs_{name}", lambda spark, sf_dir: f(source(spark, sf_dir)), sql)


_DOCS = "d AS (SELECT lang, source, doc_id * 1000000000 AS ts, unnest(string_split(text, chr(10))) AS line FROM documents)"
_SHOWN = "'{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'"
_cat("label_names", C.label_names, "SELECT unnest(['lang', 'source']) AS name", views.log_docs)
_cat("label_values", lambda df: C.label_values(df, "source"), "SELECT DISTINCT source AS value FROM documents", views.log_docs)
_cat("series", lambda df: C.series(df).select("key"), f"SELECT DISTINCT {_SHOWN} AS key FROM documents", views.log_docs)
_cat("active_streams", lambda df: C.active_streams(df, DAY0, DAY1).select("key"), f"WITH {_S} SELECT DISTINCT '{{\"event_type\":\"' || event_type || '\"}}' AS key FROM s WHERE {_DAY}")
_cat("stats", C.stats, f"WITH {_DOCS} SELECT count(DISTINCT lang || source) AS streams, count(DISTINCT (lang, source, ts // 86400000000000)) AS chunks, count(*) AS entries, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM d", views.log_docs)
_cat("rollup", lambda df: C.rollup(df, H), f"WITH {_S} SELECT '{{\"event_type\":\"' || event_type || '\"}}' AS key, ts // {H} * {H} AS bucket, count(*) AS count, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM s GROUP BY ALL")
_cat("volume", lambda df: C.volume(df, ["lang"]), f"WITH {_DOCS} SELECT '{{\"lang\":\"' || lang || '\"}}' AS name, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM d GROUP BY lang", views.log_docs)
_cat("volume_series", C.volume, f"WITH {_DOCS} SELECT {_SHOWN} AS name, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM d GROUP BY lang, source ORDER BY 2 DESC, 1 LIMIT 100", views.log_docs)
_cat("volume_labels", lambda df: C.volume(df, mode="labels"), f"WITH {_DOCS} SELECT unnest(['lang', 'source']) AS name, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM d", views.log_docs)
_cat("patterns", lambda df: C.patterns(df, DAY1 - DAY0).select("pattern", "total", F.size("buckets").alias("buckets")),
     f"WITH {_S} SELECT 'event_type=' || event_type || ' user=<_> value=<_> {{\"k\": <_>}}' AS pattern, count(*) AS total, CAST(count(DISTINCT ts // 86400000000000) AS INT) AS buckets FROM s GROUP BY event_type")
_cat("detected_labels", C.detected_labels, "SELECT 'lang' AS label, count(DISTINCT lang) AS cardinality FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents", views.log_docs)
_cat("detected_fields", C.detected_fields,
     "WITH e AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS cents FROM events) SELECT 'user_id' AS field, 'json' AS parser, 'int' AS type, count(DISTINCT user_id) AS cardinality FROM e "
     "UNION ALL SELECT 'user_kind', 'json', 'string', count(DISTINCT event_type) FROM e UNION ALL SELECT 'took', 'json', 'duration', count(DISTINCT cents) FROM e "
     "UNION ALL SELECT 'size', 'json', 'bytes', count(DISTINCT user_id) FROM e UNION ALL SELECT 'props_k', 'json', 'int', count(DISTINCT props) FROM e", views.log_json)


# tables that are kept beside the lines
def _kept(spark: SparkSession, sf_dir: str) -> LogEngine:
    rows = views.log_events(spark, sf_dir)
    return LogEngine(spark, rows, C.series_table(rows), C.rollup_ends(rows, H), H)


def _rolled(name: str, text: str, sql: str, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _kept(spark, sf_dir).metric(text, START, END, STEP)
        return out.select("step", L.get(F.col("labels"), "event_type").alias("event_type"), _rounded(F.col("value"), digits).alias("value"))

    _add(f"logql_rollup_{name}", run, sql)


_rolled("count", 'count_over_time({event_type=~"click|view"}[1d])', _M + "SELECT step, event_type, CAST(count(*) AS DOUBLE) AS value FROM w WHERE event_type IN ('click', 'view') GROUP BY ALL")
_rolled("rate", 'rate({event_type=~".+"}[6h])', _with(_GRID, _S, _w(6 * H)) + f"SELECT step, event_type, {_r('count(*) / 21600', 9)} AS value FROM w GROUP BY step, event_type", 9)
_rolled("bytes", 'bytes_over_time({event_type=~".+"}[1d] offset 6h)', _with(_GRID, _S, _w(24 * H, 6 * H)) + "SELECT step, event_type, CAST(sum(strlen(line)) AS DOUBLE) AS value FROM w GROUP BY step, event_type")
_add("logql_series_table", lambda s, d: _kept(s, d).logs('{event_type=~"click|view"} |= "user=1"', FIRST, LAST, limit=None).select("ts", "line"),
     f"WITH {_S} SELECT ts, line FROM s WHERE {_IN} AND event_type IN ('click', 'view') AND contains(line, 'user=1')")
_AFTER = (1_705_233_600 * NS, '{"event_type":"error"}', "")
for _way, _sign, _order in (("backward", "<", "DESC"), ("forward", ">", "ASC")):
    _add(f"logql_page_{_way}", lambda s, d, way=_way: LogEngine(s, views.log_events(s, d)).page('{event_type=~".+"}', FIRST, LAST, 30, _AFTER, way).select("ts", "line"),
         f"WITH {_S} SELECT ts, line FROM s WHERE {_IN} AND ts {_sign} {_AFTER[0]} ORDER BY ts {_order}, event_type, line LIMIT 30")
_cat("series_table", lambda df: C.series_table(df).select("key", "first", "last"), f"WITH {_S} SELECT '{{\"event_type\":\"' || event_type || '\"}}' AS key, min(ts) AS first, max(ts) AS last FROM s GROUP BY event_type")
_cat("selectivity", lambda df: C.selectivity(C.series_table(df), [("event_type", "=~", "c.*|v.*|p.*")], 2), "SELECT 3::BIGINT AS matched, true AS over")
