"""TraceQL queries over order spans and conversation spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import catalog as C
from ..plans import traceql as TQ
from ..sources import views
from .metrics import _r, _rounded

NS = 10**9
DAY = 86_400 * NS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPANS = """
sp AS (
  SELECT 't' || o_orderkey AS trace_id, 'root' AS span_id, '' AS parent_id, 'order-' || o_orderstatus AS name, o_orderpriority AS service,
         epoch_us(o_orderdate) * 1000 AS ts, CAST(floor(o_totalprice) AS BIGINT) * 1000000 AS dur,
         CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS status, 2 AS kind, NULL::BIGINT AS qty, NULL AS flag, o_orderpriority AS prio FROM orders
  UNION ALL
  SELECT 't' || l_orderkey, 'c-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || date_diff('day', DATE '1970-01-01', l_shipdate::DATE), 'root',
         'item-' || l_linenumber, l_returnflag, epoch_us(l_shipdate) * 1000, CAST(l_quantity * 1000000 AS BIGINT),
         CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END, 3, CAST(l_quantity AS BIGINT), l_returnflag, NULL FROM lineitem
)"""
_CHAT = """
sp AS (
  SELECT DISTINCT ON (conv_id, turn) 'v' || conv_id AS trace_id, 's' || turn AS span_id, CASE WHEN turn = 0 THEN '' ELSE 's' || (turn - 1) END AS parent_id,
         role AS name, role AS service, conv_id * 1000000000 + turn AS ts, CAST(length(text) AS BIGINT) AS dur, turn, conv_id FROM conversations
)"""


def _engine(spark: SparkSession, sf_dir: str) -> TQ.TraceEngine:
    return TQ.TraceEngine(spark, views.spans(spark, sf_dir), views.attrs(spark, sf_dir), views.SPAN_COLUMNS)


def _chat(spark: SparkSession, sf_dir: str) -> TQ.TraceEngine:
    none = spark.createDataFrame([], "trace_id string, span_id string, scope string, key string, val string, val_num double")
    return TQ.TraceEngine(spark, views.chat_spans(spark, sf_dir), none)


def _linked(spark: SparkSession, sf_dir: str) -> TQ.TraceEngine:
    return TQ.TraceEngine(spark, views.chat_spans(spark, sf_dir), views.chat_attrs(spark, sf_dir))


def _add(name: str, f, sql: str | None) -> None:
    QUERIES[f"traceql_{name}"] = f
    if sql is not None:
        ORACLES[f"traceql_{name}"] = sql


def spansets(name: str, text: str, where: str | None, engine=_engine, view: str = _SPANS) -> None:
    """Matched spans; ``where`` is the condition on sp, or a whole SELECT."""
    sql = None if where is None else f"WITH {view} " + (where if where.startswith(("SELECT", ",")) else f"SELECT DISTINCT trace_id, span_id FROM sp WHERE {where}")
    sql = sql.replace(f"{view} ,", f"{view},") if sql else None
    from ..plans.traceql_parser import parse

    _add(name, lambda spark, sf_dir: engine(spark, sf_dir).groups(parse(text)).select("trace_id", "span_id"), sql)


def trace_metrics(name: str, text: str, labels: tuple[str, ...], sql: str | None, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _engine(spark, sf_dir).metrics(text, 694_224_000 * NS, 946_684_800 * NS, 180 * DAY)
        return out.select("step", *[L.get(F.col("labels"), n).alias(n) for n in labels], _rounded(F.col("value"), digits).alias("value"))

    _add(name, run, sql)


# filters
spansets("filter_intrinsics", '{ name =~ "item-[12]" && duration > 40ms && status = error && kind = client }', "regexp_full_match(name, 'item-[12]') AND dur > 40000000 AND status = 2 AND kind = 3")
spansets("filter_attributes", '{ span.qty >= 48 && .flag = "R" }', "qty >= 48 AND flag = 'R'")
spansets("filter_resource", '{ resource.priority = "1-URGENT" }', "prio = '1-URGENT'")
spansets("filter_negation", '{ name = "item-1" && span.flag != "R" }', "name = 'item-1' AND flag <> 'R'")
spansets("filter_absent", '{ span.qty = nil && duration > 400s }', "qty IS NULL AND dur > 400000000000")
spansets("filter_exists", '{ span.qty != nil && span.qty < 3 }', "qty < 3")
spansets("filter_not_equal_absent", '{ .flag != "R" && duration > 400s }', "flag IS NULL AND dur > 400000000000")
spansets("filter_arithmetic", '{ span.qty * 2 + 1 > 98 && -span.qty < -10 ^ 1 }', "qty * 2 + 1 > 98")
spansets("filter_fields", '{ duration > span.qty * 1000000 || span.qty % 10 = 7 }', "dur > qty * 1000000 OR qty % 10 = 7")
spansets("filter_static", '{ 1 + 1 = 2 && status = unset }', "status = 0")
spansets("filter_boolean", '{ !(status = ok) && (kind = server || name = "item-7") }', "status <> 1 AND (kind = 2 OR name = 'item-7')")
spansets("filter_instrumentation", '{ instrumentation:name = "tpch" && name = "item-7" }', "name = 'item-7'")
spansets("filter_ids", '{ trace:id = "t1" || span:parentID = "" && span:id = "root" && duration > 450s }', "trace_id = 't1' OR (span_id = 'root' AND dur > 450000000000)")
spansets("trace_fields", '{ rootName = "order-F" && rootServiceName =~ "[12].*" && traceDuration > 0s && name = "item-1" }',
         "SELECT DISTINCT s.trace_id, s.span_id FROM sp s JOIN (SELECT trace_id, arg_min(name, (parent_id <> '', ts, span_id)) AS rn, arg_min(service, (parent_id <> '', ts, span_id)) AS rs, max(ts + dur) - min(ts) AS td FROM sp GROUP BY 1) c USING (trace_id) WHERE rn = 'order-F' AND regexp_full_match(rs, '[12].*') AND td > 0 AND name = 'item-1'")
spansets("child_count", "{ childCount > 6 }", "SELECT DISTINCT trace_id, span_id FROM sp WHERE span_id = 'root' AND trace_id IN (SELECT trace_id FROM sp WHERE parent_id = 'root' GROUP BY 1 HAVING count(DISTINCT span_id) > 6)")
spansets("nested_set", "{ nestedSetParent > 2 && nestedSetLeft < 6 }", "turn IN (3, 4) AND turn + 1 < 6", _chat, _CHAT)

# spanset operators
_A, _B = "a AS (SELECT DISTINCT * FROM sp WHERE name = 'order-F')", "b AS (SELECT DISTINCT * FROM sp WHERE qty > 45)"
spansets("and", '{ name = "order-F" } && { span.qty > 45 }', f", {_A}, {_B}, t AS (SELECT DISTINCT a.trace_id FROM a JOIN b USING (trace_id)) SELECT DISTINCT trace_id, span_id FROM (FROM a UNION ALL FROM b) SEMI JOIN t USING (trace_id)")
spansets("or", '{ name = "order-F" } || { span.qty > 45 }', "name = 'order-F' OR qty > 45")
spansets("child", '{ name = "order-F" } > { span.qty > 45 }', f", {_A}, {_B} SELECT DISTINCT trace_id, span_id FROM b SEMI JOIN a ON a.trace_id = b.trace_id AND b.parent_id = a.span_id")
spansets("parent", '{ span.qty > 45 } < { name = "order-F" }', f", {_A}, {_B} SELECT DISTINCT trace_id, span_id FROM a SEMI JOIN b ON a.trace_id = b.trace_id AND b.parent_id = a.span_id")
spansets("sibling", '{ name = "item-1" } ~ { name = "item-2" }', ", a AS (SELECT DISTINCT * FROM sp WHERE name = 'item-1'), b AS (SELECT DISTINCT * FROM sp WHERE name = 'item-2') SELECT DISTINCT trace_id, span_id FROM b SEMI JOIN a ON a.trace_id = b.trace_id AND a.parent_id = b.parent_id AND a.span_id <> b.span_id")
spansets("not_child", '{ name = "order-F" } !> { span.qty > 48 }', f", {_A}, b AS (SELECT DISTINCT * FROM sp WHERE qty > 48) SELECT DISTINCT trace_id, span_id FROM b ANTI JOIN a ON a.trace_id = b.trace_id AND b.parent_id = a.span_id")
spansets("union_child", '{ name = "order-F" } &> { span.qty > 48 }', f", {_A}, b AS (SELECT DISTINCT * FROM sp WHERE qty > 48) SELECT DISTINCT trace_id, span_id FROM (SELECT * FROM b SEMI JOIN a ON a.trace_id = b.trace_id AND b.parent_id = a.span_id UNION ALL SELECT * FROM a SEMI JOIN b ON a.trace_id = b.trace_id AND b.parent_id = a.span_id)")
_DEEP = ", a AS (SELECT * FROM sp WHERE dur > 400), b AS (SELECT * FROM sp WHERE turn >= 2) SELECT DISTINCT "
_UP = "x.trace_id = y.trace_id AND x.turn < y.turn"
spansets("descendant", "{ duration > 400ns } >> { nestedSetLeft >= 3 }", _DEEP + f"trace_id, span_id FROM b y SEMI JOIN a x ON {_UP}", _chat, _CHAT)
spansets("ancestor", "{ nestedSetLeft >= 3 } << { duration > 400ns }", _DEEP + f"trace_id, span_id FROM a x SEMI JOIN b y ON {_UP}", _chat, _CHAT)
spansets("not_descendant", "{ duration > 400ns } !>> { nestedSetLeft >= 3 }", _DEEP + f"trace_id, span_id FROM b y ANTI JOIN a x ON {_UP}", _chat, _CHAT)
spansets("union_ancestor", "{ nestedSetLeft >= 3 } &<< { duration > 400ns }", _DEEP + f"trace_id, span_id FROM (SELECT * FROM a x SEMI JOIN b y ON {_UP} UNION ALL SELECT * FROM b y SEMI JOIN a x ON {_UP})", _chat, _CHAT)

_X, _Y = "a AS (SELECT DISTINCT * FROM sp WHERE name = 'item-1')", "b AS (SELECT DISTINCT * FROM sp WHERE name = 'item-2')"
_SIB = "a.trace_id = b.trace_id AND a.parent_id = b.parent_id AND a.span_id <> b.span_id"
spansets("not_sibling", '{ name = "item-1" } !~ { name = "item-2" }', f", {_X}, {_Y} SELECT DISTINCT trace_id, span_id FROM b ANTI JOIN a ON {_SIB}")
spansets("union_sibling", '{ name = "item-1" } &~ { name = "item-2" }', f", {_X}, {_Y} SELECT DISTINCT trace_id, span_id FROM (SELECT * FROM b SEMI JOIN a ON {_SIB} UNION ALL SELECT * FROM a SEMI JOIN b ON {_SIB})")
spansets("not_parent", '{ span.qty > 45 } !< { name = "order-F" }', f", {_A}, {_B} SELECT DISTINCT trace_id, span_id FROM a ANTI JOIN b ON a.trace_id = b.trace_id AND b.parent_id = a.span_id")
spansets("union_parent", '{ span.qty > 45 } &< { name = "order-F" }', f", {_A}, {_B} SELECT DISTINCT trace_id, span_id FROM (SELECT * FROM a SEMI JOIN b ON a.trace_id = b.trace_id AND b.parent_id = a.span_id UNION ALL SELECT * FROM b SEMI JOIN a ON a.trace_id = b.trace_id AND b.parent_id = a.span_id)")
spansets("not_ancestor", "{ nestedSetLeft >= 3 } !<< { duration > 400ns }", _DEEP + f"trace_id, span_id FROM a x ANTI JOIN b y ON {_UP}", _chat, _CHAT)
spansets("union_descendant", "{ duration > 400ns } &>> { nestedSetLeft >= 3 }", _DEEP + f"trace_id, span_id FROM (SELECT * FROM a x SEMI JOIN b y ON {_UP} UNION ALL SELECT * FROM b y SEMI JOIN a x ON {_UP})", _chat, _CHAT)

# events and links: any value may satisfy, a negation holds when none equals
spansets("event_name", '{ event:name = "late" }', "turn > 2", _linked, _CHAT)
spansets("event_name_not", '{ event:name != "late" }', "turn <= 2", _linked, _CHAT)
spansets("event_regex", '{ event:name =~ "la.." && event.size > 300 }', "turn > 2 AND dur > 300", _linked, _CHAT)
spansets("event_time", "{ event:timeSinceStart >= 4ns }", "turn >= 4", _linked, _CHAT)
spansets("event_attribute", "{ event.size < 200 || event.size = 400 }", "dur < 200 OR dur = 400", _linked, _CHAT)
spansets("link_trace", '{ link:traceID =~ "v1.*" && link.kind = "user" }', "CAST(conv_id - 1 AS VARCHAR) LIKE '1%' AND name = 'user'", _linked, _CHAT)
spansets("link_exists", "{ link:traceID != nil && event.none = nil && duration > 900ns }", "dur > 900", _linked, _CHAT)

# pipeline
_ID = "(SELECT DISTINCT trace_id, span_id, name, qty, dur, service FROM sp)"
spansets("aggregate_count", '{ span.qty > 30 } | count() > 3', f"SELECT DISTINCT trace_id, span_id FROM {_ID} WHERE qty > 30 AND trace_id IN (SELECT trace_id FROM {_ID} WHERE qty > 30 GROUP BY 1 HAVING count(*) > 3)")
for _op in ("avg", "sum", "min", "max"):
    spansets(f"aggregate_{_op}", "{ kind = client } | %s(span.qty) > %d" % (_op, {"avg": 40, "sum": 250, "min": 35, "max": 49}[_op]),
             f"SELECT DISTINCT trace_id, span_id FROM {_ID} WHERE qty IS NOT NULL AND trace_id IN (SELECT trace_id FROM {_ID} WHERE qty IS NOT NULL GROUP BY 1 HAVING {_op}(qty) > { {'avg': 40, 'sum': 250, 'min': 35, 'max': 49}[_op]})")
spansets("by", "{ kind = client } | by(span.flag) | count() > 4", f"SELECT DISTINCT trace_id, span_id FROM {_ID} WHERE qty IS NOT NULL AND (trace_id, service) IN (SELECT (trace_id, service) FROM {_ID} WHERE qty IS NOT NULL GROUP BY trace_id, service HAVING count(*) > 4)")
spansets("coalesce", "{ kind = client } | by(span.flag) | coalesce() | count() > 6", f"SELECT DISTINCT trace_id, span_id FROM {_ID} WHERE qty IS NOT NULL AND trace_id IN (SELECT trace_id FROM {_ID} WHERE qty IS NOT NULL GROUP BY trace_id HAVING count(*) > 6)")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _engine(spark, sf_dir).search("{ span.qty > 45 } | select(span.qty, name)")
    return out.select("trace_id", "span_id", "last", "matched", "root_name", "root_service", "trace_start", "trace_duration", F.col("`span.qty`").alias("qty"))


_add("search", _search, f"""WITH {_SPANS}, m AS (SELECT DISTINCT trace_id, span_id, ts, qty FROM sp WHERE qty > 45),
top AS (SELECT trace_id, max(ts) AS last, count(DISTINCT span_id) AS matched FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
c AS (SELECT trace_id, arg_min(name, (parent_id <> '', ts, span_id)) AS root_name, arg_min(service, (parent_id <> '', ts, span_id)) AS root_service,
      min(ts) AS trace_start, max(ts + dur) - min(ts) AS trace_duration FROM sp SEMI JOIN top USING (trace_id) GROUP BY 1)
SELECT trace_id, span_id, last, matched, root_name, root_service, trace_start, trace_duration, CAST(qty AS VARCHAR) AS qty
FROM m JOIN top USING (trace_id) JOIN c USING (trace_id) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) <= 3""")
_add("trace_by_id", lambda s, d: _engine(s, d).trace("t1").select("trace_id", "span_id", "name"), f"WITH {_SPANS} SELECT DISTINCT trace_id, span_id, name FROM sp WHERE trace_id = 't1'")

# metrics
_STEP = 180 * DAY
_IN = f"x AS (SELECT DISTINCT ON (trace_id, span_id) *, ts // {_STEP} * {_STEP} AS step FROM sp WHERE ts >= {694_224_000 * NS // _STEP * _STEP} AND ts < {-(-946_684_800 * NS // _STEP) * _STEP})"
_X = f"WITH {_SPANS}, {_IN} "
_V = "resource.service.name"
trace_metrics("rate", "{ kind = client } | rate()", (), _X + f"SELECT step, {_r(f'count(*) / {_STEP / 1e9}', 9)} AS value FROM x WHERE kind = 3 GROUP BY step", digits=9)
trace_metrics("count_over_time", "{ status = error } | count_over_time() by (name)", ("name",), _X + "SELECT step, name, CAST(count(*) AS DOUBLE) AS value FROM x WHERE status = 2 GROUP BY step, name")
for _fn, _agg in {"sum": "sum(dur)", "min": "min(dur)", "max": "max(dur)", "avg": "avg(dur)"}.items():
    trace_metrics(f"{_fn}_over_time", "{ kind = client } | %s_over_time(duration) by (span.flag)" % _fn, ("span.flag",), _X + f"SELECT step, flag AS \"span.flag\", {_r(f'{_agg} / 1e9')} AS value FROM x WHERE kind = 3 GROUP BY step, flag")
trace_metrics("quantile_over_time", "{ kind = client } | quantile_over_time(duration, 0.5, 0.9)", ("p",), _X + f"SELECT step, '0.5' AS p, {_r('quantile_cont(dur, 0.5) / 1e9')} AS value FROM x WHERE kind = 3 GROUP BY step UNION ALL SELECT step, '0.9', {_r('quantile_cont(dur, 0.9) / 1e9')} FROM x WHERE kind = 3 GROUP BY step")
trace_metrics("histogram_over_time", "{ kind = client } | histogram_over_time(duration)", (), _X + "SELECT step, CAST(count(*) AS DOUBLE) AS value FROM x WHERE kind = 3 GROUP BY step, length(bin(dur - 1))")
for _op, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    trace_metrics(_op, "{} | count_over_time() by (name) | %s(2)" % _op, ("name",), _X + f"SELECT step, name, CAST(n AS DOUBLE) AS value FROM (SELECT step, name, count(*) AS n FROM x GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY step ORDER BY n {_dir}, name) <= 2")
trace_metrics("threshold", "{} | count_over_time() by (name) > 300", ("name",), _X + "SELECT step, name, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY step, name HAVING count(*) > 300")


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _engine(spark, sf_dir).metrics('{ kind = client } | compare({ span.qty > 40 })', 694_224_000 * NS, 946_684_800 * NS, _STEP)
    return out.where("key IN ('name', 'span.flag')").select("step", "side", "key", "val", "value")


_PARTS = " UNION ALL ".join(
    f"SELECT step, side, '{k}' AS key, {c} AS val, CAST(count(*) AS DOUBLE) AS value FROM y GROUP BY step, side, {c} UNION ALL SELECT step, side || '_total', '{k}', '', count(*) FROM y GROUP BY step, side" for k, c in (("name", "name"), ("span.flag", "flag"))
)
_add("compare", _compare, _X + f", y AS (SELECT *, CASE WHEN qty > 40 THEN 'selection' ELSE 'baseline' END AS side FROM x WHERE kind = 3) {_PARTS}")
_add("exemplars", lambda s, d: _engine(s, d).exemplars("{ kind = client } | rate()", 694_224_000 * NS, 946_684_800 * NS, _STEP, 2), f"WITH {_SPANS}, x AS (SELECT DISTINCT trace_id, span_id, ts, ts // {_STEP} * {_STEP} AS step FROM sp WHERE kind = 3 AND ts >= {694_224_000 * NS} AND ts < {946_684_800 * NS}) SELECT step, trace_id, ts AS ts_ns FROM x QUALIFY row_number() OVER (PARTITION BY step ORDER BY ts, trace_id, span_id) <= 2")

_add("series_probe", lambda s, d: _engine(s, d).series_probe("{} | count_over_time() by (name)", 694_224_000 * NS, 946_684_800 * NS, _STEP, 3), _X + 'SELECT least(count(DISTINCT name), 4) AS series, count(DISTINCT name) > 3 AS "over" FROM x')


# service graph and tags
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TQ.service_graph(_calls(spark, sf_dir))
    return out.select("client", "server", "conn_type", "calls", "failed", *[F.round(f"p{q}", 9).alias(f"p{q}") for q in (50, 95, 99)])


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation spans as calls: even turns are clients, the next turn serves them."""
    return views.chat_spans(spark, sf_dir).withColumn("status", F.when(F.col("duration_ns") > 1000, 2).otherwise(0)).withColumn("service", F.concat("service", F.lit("-"), F.pmod(F.length("trace_id"), F.lit(2)).cast("string")))


_add("service_graph", _pairs, f"""WITH {_CHAT}, e AS (SELECT trace_id, span_id, parent_id, turn, dur, dur > 1000 AS bad, service || '-' || (length(trace_id) % 2) AS service FROM sp)
SELECT c.service AS client, s.service AS server, 'rpc' AS conn_type, count(*) AS calls, count(*) FILTER (c.bad OR s.bad) AS failed,
       round(quantile_cont(s.dur, 0.5) / 1e9, 9) AS p50, round(quantile_cont(s.dur, 0.95) / 1e9, 9) AS p95, round(quantile_cont(s.dur, 0.99) / 1e9, 9) AS p99
FROM e s JOIN e c ON s.trace_id = c.trace_id AND s.parent_id = c.span_id WHERE s.turn % 2 = 1 AND c.turn % 2 = 0 GROUP BY ALL""")
_add("edges", lambda s, d: TQ.edges(_calls(s, d)).groupBy("side", "conn_type").agg(F.count(F.lit(1)).alias("n")), f"WITH {_CHAT} SELECT CASE WHEN turn % 2 = 0 THEN 'client' ELSE 'server' END AS side, 'rpc' AS conn_type, count(*) AS n FROM sp GROUP BY ALL")
_add("tag_names", lambda s, d: C.tag_names(views.attrs(s, d)), "SELECT * FROM (VALUES ('span', 'qty'), ('span', 'flag'), ('resource', 'priority')) t(scope, key)")
_add("tag_values", lambda s, d: C.tag_values(views.attrs(s, d), "flag", "span"), "SELECT DISTINCT l_returnflag AS val FROM lineitem")
_add("metric_cardinality", lambda s, d: C.cardinality(views.gauge(s, d)), "WITH s AS (SELECT DISTINCT event_type, user_id FROM events), p AS (SELECT 'event_type=' || event_type AS name, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'user_id=' || user_id, count(*) FROM s GROUP BY 1) SELECT 'seriesCountByMetricName' AS kind, 'event_value' AS name, count(*) AS n FROM s UNION ALL SELECT 'labelValueCountByLabelName', 'user_id', count(DISTINCT user_id) FROM s UNION ALL SELECT 'labelValueCountByLabelName', 'event_type', count(DISTINCT event_type) FROM s UNION ALL (SELECT 'seriesCountByLabelValuePair', name, n FROM p ORDER BY n DESC, name LIMIT 10)")
