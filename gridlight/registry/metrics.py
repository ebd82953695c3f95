"""PromQL queries over the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numeric as N
from ..operators import catalog as C
from ..plans.promql import Engine
from ..sources import views

H = 3_600_000
#: 2024-01-02 .. 2024-01-29, every six hours; one point for instant queries.
START, END, STEP = 1_704_153_600_000, 1_706_486_400_000, 6 * H
AT = 1_705_276_800_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_GRID = f"g AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS step)"
_TYPED = "s AS (SELECT event_type, epoch_us(ts) // 1000 AS ts, value, event_id, user_id FROM events)"
_COUNTER = "s AS (SELECT event_type, epoch_us(ts) // 1000 AS ts, CAST(count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) AS value FROM events)"
_WRAPPED = _COUNTER.replace("CAST(count(*)", "CAST((count(*)").replace("event_id) AS DOUBLE)", "event_id)) % 500 AS DOUBLE)")


def _window(span: int, offset: int = 0, name: str = "w", by: str = "event_type") -> str:
    return f"{name} AS (SELECT g.step, s.* FROM g JOIN s ON s.ts > g.step - {offset} - {span} AND s.ts <= g.step - {offset})"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def promql(
    name: str, text: str, source: Callable[[SparkSession, str], DataFrame], labels: tuple[str, ...], sql: str | None,
    instant: bool = False, digits: int = 6, metric: bool = False, ranked: bool = False, shown: bool = False,
    hists: Callable[[SparkSession, str], DataFrame] | None = None,
) -> None:
    """Register ``text``: step, one column per label, value rounded, or ``shown`` as text with
    NaN and infinities; ``ranked`` adds each row's place in the result's order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, source(spark, sf_dir), hists=None if hists is None else hists(spark, sf_dir))
        out = engine.query(text, AT) if instant else engine.query(text, START, END, STEP)
        picked = [L.get(F.col("labels"), n).alias(n) for n in labels]
        if metric:
            picked.append(L.get(F.col("labels"), "__name__").alias("metric"))
        value = _rounded(F.col("value"), digits)
        if shown:
            value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), N.go_format(F.col("value"))).otherwise(value.cast("string"))
        if ranked:
            picked.append(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place"))
        return out.select("step", *picked, value.alias("value"))

    QUERIES[f"promql_{name}"] = run
    if sql is not None:
        ORACLES[f"promql_{name}"] = sql


def _rounded(v: Column, digits: int) -> Column:
    # NaN and infinities are null in the comparison; -0.0 is 0.0
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(F.round(v, digits) + 0.0)


def _r(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


T = ("event_type",)
_LAST = "SELECT step, event_type, arg_max(value, ts) AS v FROM w GROUP BY ALL"
_INSTANT = _with(_GRID, _TYPED, _window(6 * H), f"i AS ({_LAST})")

# selectors
promql("instant_selector", "typed_value", views.typed, T, _with(_GRID, _TYPED, _window(300_000)) + f"SELECT step, event_type, {_r('arg_max(value, ts)')} AS value FROM w GROUP BY ALL")
promql("matchers", 'event_value{event_type=~"cl.*|view", user_id!~"1.*", event_type!="view"}', views.gauge, ("event_type", "user_id"),
       _with(_GRID, _TYPED, _window(300_000)) + f"SELECT step, event_type, CAST(user_id AS VARCHAR) AS user_id, {_r('arg_max(value, ts)')} AS value FROM w WHERE regexp_full_match(event_type, 'cl.*|view') AND NOT regexp_full_match(CAST(user_id AS VARCHAR), '1.*') AND event_type <> 'view' GROUP BY ALL")
promql("name_matcher", '{__name__=~"typed.+", event_type="error"}', views.typed, T, _with(_GRID, _TYPED, _window(300_000)) + f"SELECT step, event_type, {_r('arg_max(value, ts)')} AS value FROM w WHERE event_type = 'error' GROUP BY ALL")
promql("range_matrix", 'typed_value{event_type="error"}[6h]', views.typed, T, f"WITH {_TYPED} SELECT ts AS step, event_type, {_r('value')} AS value FROM s WHERE event_type = 'error' AND ts > {AT - 6 * H} AND ts <= {AT}", instant=True)
promql("offset", "count_over_time(typed_value[1d] offset 12h)", views.typed, T, _with(_GRID, _TYPED, _window(24 * H, 12 * H)) + "SELECT step, event_type, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL")
promql("at_modifier", f"sum_over_time(typed_value[1d] @ {AT // 1000})", views.typed, T,
       _with(_GRID, _TYPED) + f"SELECT step, event_type, {_r('v', 3)} AS value FROM g, (SELECT event_type, sum(value) AS v FROM s WHERE ts > {AT - 24 * H} AND ts <= {AT} GROUP BY 1)", digits=3)
promql("duration_expression", "count_over_time(typed_value[1h * 3 + step()])", views.typed, T, _with(_GRID, _TYPED, _window(9 * H)) + "SELECT step, event_type, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL")
promql("subquery", "max_over_time(count_over_time(typed_value[2h])[12h:2h])", views.typed, T,
       _with(_GRID, _TYPED, f"t AS (SELECT unnest(range({START - 14 * H}, {END} + 1, {2 * H})) AS st)", f"inner_ AS (SELECT st, event_type, CAST(count(*) AS DOUBLE) AS v FROM t JOIN s ON s.ts > st - {2 * H} AND s.ts <= st GROUP BY ALL)")
       + f"SELECT step, event_type, max(v) AS value FROM g JOIN inner_ ON st > step - {12 * H} AND st <= step GROUP BY ALL")

# range functions with one aggregate per window
for _fn, _agg in {
    "sum_over_time": "fsum(value)", "avg_over_time": "favg(value)", "min_over_time": "min(value)", "max_over_time": "max(value)",
    "count_over_time": "count(*)", "last_over_time": "arg_max(value, ts)", "first_over_time": "arg_min(value, ts)", "present_over_time": "1",
    "stddev_over_time": "stddev_pop(value)", "stdvar_over_time": "var_pop(value)", "mad_over_time": "mad(value)",
    "ts_of_min_over_time": "max(ts) FILTER (value = mn) / 1000", "ts_of_max_over_time": "max(ts) FILTER (value = mx) / 1000",
    "ts_of_first_over_time": "min(ts) / 1000", "ts_of_last_over_time": "max(ts) / 1000",
}.items():
    _w, _digits = _window(24 * H), 9 if _fn in ("sum_over_time", "avg_over_time") else 3
    if "FILTER" in _agg:
        _w += ", w2 AS (SELECT *, min(value) OVER (PARTITION BY step, event_type) AS mn, max(value) OVER (PARTITION BY step, event_type) AS mx FROM w)"
    promql(_fn, f"{_fn}(typed_value[1d])", views.typed, T, _with(_GRID, _TYPED, _w) + f"SELECT step, event_type, {_r(_agg, _digits)} AS value FROM {'w2' if 'FILTER' in _agg else 'w'} GROUP BY step, event_type", digits=_digits)
promql("quantile_over_time", "quantile_over_time(0.9, typed_value[1d])", views.typed, T, _with(_GRID, _TYPED, _window(24 * H)) + f"SELECT step, event_type, {_r('quantile_cont(value, 0.9)')} AS value FROM w GROUP BY ALL")
promql("absent_over_time", 'absent_over_time(typed_value{event_type="signup"}[1h])', views.typed, T,
       _with(_GRID, _TYPED, _window(H)) + "SELECT step, 'signup' AS event_type, 1.0::DOUBLE AS value FROM g WHERE step NOT IN (SELECT step FROM w WHERE event_type = 'signup')")


def _rate(source: str, kind: str, span: int) -> str:
    counter = kind != "delta"
    zero = "CASE WHEN res > 0 AND fv >= 0 THEN si * (fv / res) ELSE ds1 END"
    return (
        _with(_GRID, source, "p AS (SELECT *, lag(ts) OVER x AS pt, lag(value) OVER x AS pv FROM s WINDOW x AS (PARTITION BY event_type ORDER BY ts))",
              f"w AS (SELECT g.step, p.* FROM g JOIN p ON ts > step - {span} AND ts <= step)",
              f"a AS (SELECT step, event_type, count(*) AS n, min(ts) AS ft, max(ts) AS lt, arg_min(value, ts) AS fv, arg_max(value, ts) - arg_min(value, ts)"
              + (f" + sum(CASE WHEN pt > step - {span} AND value < pv THEN pv ELSE 0 END)" if counter else "") + " AS res FROM w GROUP BY ALL HAVING count(*) >= 2)",
              f"b AS (SELECT *, (ft - (step - {span})) / 1000 AS ds0, (step - lt) / 1000 AS de0, (lt - ft) / 1000 AS si, ((lt - ft) / 1000) / (n - 1) AS av FROM a)",
              "c AS (SELECT *, CASE WHEN ds0 >= av * 1.1 THEN av / 2 ELSE ds0 END AS ds1, CASE WHEN de0 >= av * 1.1 THEN av / 2 ELSE de0 END AS de FROM b)",
              f"d AS (SELECT *, {f'least(ds1, {zero})' if counter else 'ds1'} AS ds FROM c)")
        + f"SELECT step, event_type, {_r('res * ((si + ds + de) / si' + (f' / {span / 1000}' if kind == 'rate' else '') + ')', 6)} AS value FROM d"
    )


_wrapped = lambda s, d: views.counter(s, d, 500)
promql("rate", "rate(events_wrapped_total[1d])", _wrapped, T, _rate(_WRAPPED, "rate", 24 * H))
promql("increase", "increase(events_wrapped_total[1d])", _wrapped, T, _rate(_WRAPPED, "increase", 24 * H))
promql("delta", "delta(typed_value[1d])", views.typed, T, _rate(_TYPED, "delta", 24 * H))
_PAIR = "pr AS (SELECT step, event_type, list(value ORDER BY ts) AS vs, list(ts ORDER BY ts) AS tt FROM w GROUP BY ALL HAVING count(*) >= 2)"
promql("irate", "irate(events_wrapped_total[1d])", _wrapped, T, _with(_GRID, _WRAPPED, _window(24 * H), _PAIR) + f"SELECT step, event_type, {_r('CASE WHEN vs[-1] < vs[-2] THEN vs[-1] ELSE vs[-1] - vs[-2] END / ((tt[-1] - tt[-2]) / 1000)')} AS value FROM pr")
promql("idelta", "idelta(typed_value[1d])", views.typed, T, _with(_GRID, _TYPED, _window(24 * H), _PAIR) + f"SELECT step, event_type, {_r('vs[-1] - vs[-2]')} AS value FROM pr")
_ADJ = "ad AS (SELECT step, event_type, value, lag(value) OVER (PARTITION BY step, event_type ORDER BY ts) AS pv FROM w)"
promql("resets", "resets(events_wrapped_total[1d])", _wrapped, T, _with(_GRID, _WRAPPED, _window(24 * H), _ADJ) + "SELECT step, event_type, CAST(count(*) FILTER (value < pv) AS DOUBLE) AS value FROM ad GROUP BY ALL")
promql("changes", "changes(typed_value[1d])", views.typed, T, _with(_GRID, _TYPED, _window(24 * H), _ADJ) + "SELECT step, event_type, CAST(count(*) FILTER (value <> pv) AS DOUBLE) AS value FROM ad GROUP BY ALL")
promql("deriv", "deriv(typed_value[1d])", views.typed, T, _with(_GRID, _TYPED, _window(24 * H)) + f"SELECT step, event_type, {_r('regr_slope(value, (ts - step) / 1000)')} AS value FROM w GROUP BY ALL HAVING count(*) >= 2")
promql("predict_linear", "predict_linear(typed_value[1d], 3600)", views.typed, T, _with(_GRID, _TYPED, _window(24 * H)) + f"SELECT step, event_type, {_r('regr_intercept(value, (ts - step) / 1000) + regr_slope(value, (ts - step) / 1000) * 3600', 4)} AS value FROM w GROUP BY ALL HAVING count(*) >= 2", digits=4)
promql("double_exponential_smoothing", "double_exponential_smoothing(typed_value[12h], 0.5, 0.1)", views.typed, T,
       "WITH RECURSIVE " + ", ".join([_GRID, _TYPED, _window(12 * H), "pr AS (SELECT step, event_type, list(value ORDER BY ts) AS vs FROM w GROUP BY ALL HAVING count(*) >= 2)",
       "h AS (SELECT step, event_type, vs, 2 AS i, vs[1] AS s, vs[2] - vs[1] AS b FROM pr UNION ALL SELECT step, event_type, vs, i + 1, 0.5 * vs[i] + 0.5 * (s + b), 0.1 * (0.5 * vs[i] + 0.5 * (s + b) - s) + 0.9 * b FROM h WHERE i <= len(vs))"])
       + f" SELECT step, event_type, {_r('s')} AS value FROM h WHERE i = len(vs) + 1")
# windows of six hours with the samples up to five minutes before (and, smoothed, after) them
_BEGIN, _NEAR = f"step - {6 * H}", 300_000
promql("anchored_increase", "increase(events_total[6h] anchored)", views.counter, T,
       _with(_GRID, _COUNTER, f"w AS (SELECT g.step, s.* FROM g JOIN s ON ts > {_BEGIN} - {_NEAR} AND ts <= step)")
       + f"SELECT step, event_type, {_r(f'arg_max(value, ts) - coalesce(arg_max(value, ts) FILTER (ts <= {_BEGIN}), arg_min(value, ts))')} AS value FROM w GROUP BY step, event_type HAVING max(ts) > {_BEGIN}")
promql("anchored_changes", "changes(typed_value[6h] anchored)", views.typed, T,
       _with(_GRID, _TYPED, f"w AS (SELECT g.step, s.* FROM g JOIN s ON ts > {_BEGIN} - {_NEAR} AND ts <= step)",
             f"m AS (SELECT step, event_type, max(ts) FILTER (ts <= {_BEGIN}) AS f FROM w GROUP BY ALL HAVING max(ts) > {_BEGIN})",
             "x AS (SELECT step, event_type, value, lag(value) OVER (PARTITION BY step, event_type ORDER BY ts) AS p FROM w JOIN m USING (step, event_type) WHERE f IS NULL OR ts >= f)")
       + "SELECT step, event_type, CAST(count(*) FILTER (value <> p) AS DOUBLE) AS value FROM x GROUP BY step, event_type")


def _edge(t: str, n: int) -> str:
    """Value at time ``t`` between the samples around it; ``n`` names the columns."""
    return (
        f"max(ts) FILTER (ts <= {t}) AS lt{n}, arg_max(value, ts) FILTER (ts <= {t}) AS lv{n}, "
        f"min(ts) FILTER (ts > {t}) AS rt{n}, arg_min(value, ts) FILTER (ts > {t}) AS rv{n}"
    )


def _at_edge(t: str, n: int) -> str:
    return (
        f"CASE WHEN lt{n} = {t} OR rt{n} IS NULL THEN lv{n} WHEN lt{n} IS NULL THEN rv{n} "
        f"ELSE lv{n} + (rv{n} - lv{n}) * (({t} - lt{n}) / (rt{n} - lt{n})) END"
    )


for _fn, _source, _rows, _per in (("smoothed_rate", views.counter, _COUNTER, 21600), ("smoothed_delta", views.typed, _TYPED, 1)):
    _text = "rate(events_total[6h] smoothed)" if _per > 1 else "delta(typed_value[6h] smoothed)"
    promql(_fn, _text, _source, T,
           _with(_GRID, _rows, f"w AS (SELECT g.step, s.* FROM g JOIN s ON ts > {_BEGIN} - {_NEAR} AND ts <= step + {_NEAR})",
                 f"a AS (SELECT step, event_type, {_edge(_BEGIN, 1)}, {_edge('step', 2)} FROM w GROUP BY ALL HAVING max(ts) > {_BEGIN} AND min(ts) <= step)")
           + f"SELECT step, event_type, {_r('((' + _at_edge('step', 2) + ') - (' + _at_edge(_BEGIN, 1) + f')) / {_per}', 9)} AS value FROM a", digits=9)

# aggregations over the last value of six hours per user
_L6 = "last_over_time(event_value[6h])"
_USERS = _with(_GRID, _TYPED, _window(6 * H), "i AS (SELECT step, event_type, user_id, arg_max(value, ts) AS v FROM w GROUP BY ALL)")
for _op, _agg in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "group": "1", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    promql(f"agg_{_op}", f"{_op} by (event_type) ({_L6})", views.gauge, T, _USERS + f"SELECT step, event_type, {_r(_agg, 8)} AS value FROM i GROUP BY step, event_type", digits=8)
promql("agg_without", f"sum without (user_id) ({_L6})", views.gauge, T, _USERS + f"SELECT step, event_type, {_r('sum(v)', 4)} AS value FROM i GROUP BY step, event_type", digits=4)
promql("agg_none", f"sum({_L6})", views.gauge, (), _USERS + f"SELECT step, {_r('sum(v)', 4)} AS value FROM i GROUP BY step", digits=4)
promql("agg_quantile", f"quantile by (event_type) (0.75, {_L6})", views.gauge, T, _USERS + f"SELECT step, event_type, {_r('quantile_cont(v, 0.75)')} AS value FROM i GROUP BY step, event_type")
_KEY = "'{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || user_id || '\"}'"
for _op, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    promql(f"agg_{_op}", f"{_op} by (event_type) (3, {_L6})", views.gauge, ("event_type", "user_id"),
           _USERS + f"SELECT step, event_type, CAST(user_id AS VARCHAR) AS user_id, {_r('v')} AS value FROM i QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY v {_dir}, {_KEY}) <= 3")
promql("agg_limitk", f"limitk by (event_type) (2, {_L6})", views.gauge, ("event_type", "user_id"),
       _USERS + f"SELECT step, event_type, CAST(user_id AS VARCHAR) AS user_id, {_r('v')} AS value FROM i QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY {_KEY}) <= 2")
promql("agg_limit_ratio", f"count(limit_ratio(0.5, {_L6})) + count(limit_ratio(-0.5, {_L6}))", views.gauge, (), _USERS + "SELECT step, CAST(count(*) AS DOUBLE) AS value FROM i GROUP BY step")
promql("agg_count_values", 'count_values by (event_type) ("n", count_over_time(event_value[6h]))', views.gauge, ("event_type", "n"),
       _with(_GRID, _TYPED, _window(6 * H), "i AS (SELECT step, event_type, user_id, count(*) AS n FROM w GROUP BY ALL)") + "SELECT step, event_type, CAST(n AS VARCHAR) AS n, CAST(count(*) AS DOUBLE) AS value FROM i GROUP BY step, event_type, n")

# operators
_L = "last_over_time(typed_value[6h])"
promql("arithmetic", f"({_L} * 2 + 1) % 7 - {_L} / 3 ^ 2", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('((v * 2 + 1) % 7) - v / 9', 5)} AS value FROM i", digits=5)
promql("atan2", f"{_L} atan2 (last_over_time(typed_value[6h] offset 6h))", views.typed, T,
       _with(_GRID, _TYPED, _window(6 * H), _window(6 * H, 6 * H, "w6"), f"i AS ({_LAST})", f"j AS ({_LAST.replace('FROM w', 'FROM w6')})") + f"SELECT step, event_type, {_r('atan2(i.v, j.v)')} AS value FROM i JOIN j USING (step, event_type)")
promql("compare_filter", f"{_L} > 50", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('v')} AS value FROM i WHERE v > 50")
promql("compare_bool", f"{_L} >= bool 50", views.typed, T, _INSTANT + "SELECT step, event_type, CAST(v >= 50 AS INT)::DOUBLE AS value FROM i")
promql("division_by_zero", f"{_L} / 0 > bool 1", views.typed, T, _INSTANT + "SELECT step, event_type, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM i")
_TWO = _USERS[:-1] + ", t AS (SELECT step, event_type, sum(v) AS tv FROM i GROUP BY ALL) "
promql("group_left", f"{_L6} / on (event_type) group_left () sum by (event_type) ({_L6})", views.gauge, ("event_type", "user_id"),
       _TWO + f"SELECT step, event_type, CAST(user_id AS VARCHAR) AS user_id, {_r('CASE WHEN tv <> 0 THEN v / tv END')} AS value FROM i JOIN t USING (step, event_type)")
promql("group_right", f"sum by (event_type) ({_L6}) - ignoring (user_id) group_right () {_L6}", views.gauge, ("event_type", "user_id"),
       _TWO + f"SELECT step, event_type, CAST(user_id AS VARCHAR) AS user_id, {_r('tv - v', 4)} AS value FROM i JOIN t USING (step, event_type)", digits=4)
_OFF = _with(_GRID, _TYPED, _window(H), _window(H, H, "w1"), f"i AS ({_LAST})", f"j AS ({_LAST.replace('FROM w', 'FROM w1')})")
_NOW, _BEFORE = "last_over_time(typed_value[1h])", "last_over_time(typed_value[1h] offset 1h)"
promql("one_to_one", f"{_NOW} - {_BEFORE}", views.typed, T, _OFF + f"SELECT step, event_type, {_r('i.v - j.v')} AS value FROM i JOIN j USING (step, event_type)")
promql("and", f"{_NOW} and {_BEFORE}", views.typed, T, _OFF + f"SELECT step, event_type, {_r('v')} AS value FROM i SEMI JOIN j USING (step, event_type)")
promql("unless", f"{_NOW} unless {_BEFORE}", views.typed, T, _OFF + f"SELECT step, event_type, {_r('v')} AS value FROM i ANTI JOIN j USING (step, event_type)")
promql("or", f"{_NOW} or {_BEFORE}", views.typed, T, _OFF + f"SELECT step, event_type, {_r('v')} AS value FROM (SELECT * FROM i UNION ALL SELECT * FROM j ANTI JOIN i USING (step, event_type))")
promql("fill", f"{_NOW} - fill(0) {_BEFORE}", views.typed, T, _OFF + f"SELECT step, event_type, {_r('coalesce(i.v, 0) - coalesce(j.v, 0)')} AS value FROM i FULL JOIN j USING (step, event_type)")
# values that only IEEE arithmetic has, compared as text
for _name, _text, _sql in (
    ("ieee_division", f"({_L} - 50) / 0", "CASE WHEN v > 50 THEN '+Inf' WHEN v < 50 THEN '-Inf' ELSE 'NaN' END"),
    ("ieee_zero_by_zero", f"({_L} * 0) / 0", "'NaN'"),
    ("ieee_modulo", f"{_L} % 0", "'NaN'"),
    ("ieee_sqrt", f"sqrt(50 - clamp_min({_L}, 50.001))", "CASE WHEN v > -1 THEN 'NaN' END"),
    ("ieee_ln", f"ln(clamp({_L}, 49, 50) - 50)", "CASE WHEN v < 50 THEN 'NaN' ELSE '-Inf' END"),
    ("ieee_power", f"10 ^ (400 * sgn({_L} - 50) ^ 2)", "CASE WHEN v <> 50 THEN '+Inf' ELSE '1.0' END"),
    ("ieee_infinities", f"({_L} * Inf) - Inf", "'NaN'"),
    ("ieee_compare", f"({_L} / 0) == bool Inf", "CASE WHEN v > 0 THEN '1.0' ELSE '0.0' END"),
):
    promql(_name, _text, views.typed, T, _INSTANT + f"SELECT step, event_type, {_sql} AS value FROM i", shown=True)
promql("unary_minus", f"-{_L}", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('-v')} AS value FROM i")

# elementwise and other functions
_POS = {"abs": "abs(v - 50)", "ceil": "ceil(v - 50)", "floor": "floor(v - 50)", "sqrt": "sqrt(greatest(v - 50, 0))", "exp": "exp((v - 50) / 100)", "sgn": "sign(v - 50)", "deg": "degrees(v - 50)", "rad": "radians(v - 50)",
        "sin": "sin(v - 50)", "cos": "cos(v - 50)", "tan": "tan((v - 50) / 100)", "atan": "atan(v - 50)", "sinh": "sinh((v - 50) / 100)", "cosh": "cosh((v - 50) / 100)", "tanh": "tanh(v - 50)", "asinh": "asinh(v - 50)"}
for _fn, _sql in _POS.items():
    _arg = f"({_L} - 50)" if _fn not in ("exp", "tan", "sinh", "cosh", "sqrt") else f"clamp_min({_L} - 50, 0)" if _fn == "sqrt" else f"(({_L} - 50) / 100)"
    promql(f"fn_{_fn}", f"{_fn}({_arg})", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r(_sql, 4)} AS value FROM i", digits=4)
for _fn, _sql in {"ln": "ln(v + 1)", "log2": "log2(v + 1)", "log10": "log10(v + 1)", "acosh": "acosh(v + 1)"}.items():
    promql(f"fn_{_fn}", f"{_fn}(abs({_L}) + 1)", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r(_sql.replace('v', 'abs(v)'))} AS value FROM i")
for _fn, _sql in {"asin": "asin(x)", "acos": "acos(x)", "atanh": "atanh(x)"}.items():
    promql(f"fn_{_fn}", f"{_fn}(({_L} % 90) / 100)", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r(_sql.replace('(x)', '((v % 90) / 100)'))} AS value FROM i")
promql("fn_clamp", f"clamp({_L}, 20, 60)", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('greatest(20, least(60, v))')} AS value FROM i")
promql("fn_clamp_min", f"clamp_min({_L}, 20)", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('greatest(20, v)')} AS value FROM i")
promql("fn_clamp_max", f"clamp_max({_L}, 20)", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('least(20, v)')} AS value FROM i")
promql("fn_round", f"round({_L}, 5)", views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('floor(v * 0.2 + 0.5) / 0.2')} AS value FROM i")
promql("fn_scalars", "vector(pi() + max_of(1, 2) - min_of(3, 4) + time() % 1000)", views.typed, (), _with(_GRID) + f"SELECT step, {_r('pi() + 2 - 3 + (step / 1000) % 1000')} AS value FROM g")
promql("fn_timestamp", "timestamp(typed_value)", views.typed, T, _with(_GRID, _TYPED, _window(300_000)) + f"SELECT step, event_type, {_r('max(ts) / 1000')} AS value FROM w GROUP BY step, event_type")
for _fn, _part in {"year": "year", "month": "month", "day_of_month": "day", "day_of_week": "dow", "day_of_year": "doy", "hour": "hour", "minute": "minute"}.items():
    promql(f"fn_{_fn}", f"{_fn}(vector(time() + 12345))", views.typed, (), _with(_GRID) + f"SELECT step, CAST(date_part('{_part}', make_timestamp((step + 12345000) * 1000)) AS DOUBLE) AS value FROM g")
promql("fn_days_in_month", "days_in_month()", views.typed, (), _with(_GRID) + "SELECT step, CAST(day(last_day(make_timestamp(step * 1000)::DATE)) AS DOUBLE) AS value FROM g")
promql("fn_scalar", f'{_L} - scalar(max(last_over_time(typed_value{{event_type="click"}}[6h])))', views.typed, T, _INSTANT + f"SELECT step, event_type, {_r('i.v - c.v')} AS value FROM i LEFT JOIN (SELECT step, v FROM i WHERE event_type = 'click') c USING (step)")
promql("fn_absent", 'absent(typed_value{event_type="click"})', views.typed, T, _with(_GRID, _TYPED, _window(300_000)) + "SELECT step, 'click' AS event_type, 1.0::DOUBLE AS value FROM g WHERE step NOT IN (SELECT step FROM w WHERE event_type = 'click')")
promql("fn_label_replace", f'label_replace({_L}, "short", "${{1}}-$2", "event_type", "(.).*(.)")', views.typed, ("event_type", "short"), _INSTANT + f"SELECT step, event_type, left(event_type, 1) || '-' || right(event_type, 1) AS short, {_r('v')} AS value FROM i")
promql("fn_label_join", f'label_join({_L6}, "both", "/", "event_type", "user_id", "none")', views.gauge, ("both",), _USERS + f"SELECT step, event_type || '/' || user_id || '/' AS both, {_r('v')} AS value FROM i")
for _fn in ("sort", "sort_desc"):
    promql(f"fn_{_fn}", f"{_fn}(last_over_time(typed_value[6h]))", views.typed, T, f"WITH {_TYPED} SELECT CAST({AT} AS BIGINT) AS step, event_type, row_number() OVER (ORDER BY arg_max(value, ts) {'DESC' if _fn.endswith('desc') else 'ASC'}, event_type)::INT AS place, {_r('arg_max(value, ts)')} AS value FROM s WHERE ts > {AT - 6 * H} AND ts <= {AT} GROUP BY event_type", instant=True, ranked=True)
for _fn, _dir in (("sort_by_label", ""), ("sort_by_label_desc", " DESC")):
    promql(f"fn_{_fn}", f'{_fn}(last_over_time(event_value[6h]), "user_id")', views.gauge, ("event_type", "user_id"),
           f"WITH {_TYPED} SELECT CAST({AT} AS BIGINT) AS step, event_type, CAST(user_id AS VARCHAR) AS user_id, row_number() OVER (ORDER BY user_id{_dir}, {_KEY})::INT AS place, {_r('arg_max(value, ts)')} AS value "
           f"FROM s WHERE ts > {AT - 6 * H} AND ts <= {AT} GROUP BY event_type, user_id", instant=True, ranked=True)

# classic histograms: the day's bucket sample, looked up by a range
_DAYS = (
    f"WITH {_GRID}, e AS (SELECT event_type, value, (epoch_us(ts) // 86400000000) * 86400000 AS day FROM events), "
    "c AS (SELECT event_type, day, b, CAST(count(*) FILTER (value <= b) AS DOUBLE) AS n FROM e, (SELECT unnest([1, 5, 10, 25, 50, 'inf'::DOUBLE]) AS b) GROUP BY ALL), "
    f"h AS (SELECT step, event_type, list(b ORDER BY b) AS bs, list(n ORDER BY b) AS ns FROM g JOIN c ON day > step - {24 * H} AND day <= step GROUP BY ALL), "
)
_Q = (
    "q AS (SELECT *, {q} * ns[6] AS r FROM h), k AS (SELECT *, CASE WHEN ns[1] >= r THEN 1 WHEN ns[2] >= r THEN 2 WHEN ns[3] >= r THEN 3 WHEN ns[4] >= r THEN 4 WHEN ns[5] >= r THEN 5 ELSE 6 END AS i FROM q), "
    "v AS (SELECT *, CASE WHEN ns[6] = 0 THEN NULL WHEN i = 6 THEN bs[5] WHEN i = 1 THEN r / ns[1] * bs[1] ELSE bs[i - 1] + (bs[i] - bs[i - 1]) * ((r - ns[i - 1]) / (ns[i] - ns[i - 1])) END AS x FROM k) "
)
_B = "last_over_time(event_size_bucket[1d])"
promql("histogram_quantile", f"histogram_quantile(0.4, {_B})", views.buckets, T, _DAYS + _Q.format(q=0.4) + f"SELECT step, event_type, {_r('x')} AS value FROM v")
promql("histogram_quantiles", f'histogram_quantiles({_B}, "q", 0.2, 0.4)', views.buckets, ("event_type", "q"),
       _DAYS + _Q.format(q=0.2) + f"SELECT step, event_type, '0.2' AS q, {_r('x')} AS value FROM v UNION ALL " + "(" + _DAYS + _Q.format(q=0.4) + f"SELECT step, event_type, '0.4' AS q, {_r('x')} AS value FROM v)")
promql("histogram_fraction", f"histogram_fraction(5, 30, {_B})", views.buckets, T, _DAYS[:-2] + f" SELECT step, event_type, {_r('CASE WHEN ns[6] > 0 THEN (ns[4] + (ns[5] - ns[4]) * 0.2 - ns[2]) / ns[6] END')} AS value FROM h")
_infos = lambda s, d: views.infos(s, d, AT)
promql("info", "info(user_activity)", _infos, ("instance", "segment"), f"SELECT CAST({AT} AS BIGINT) AS step, 'user-' || user_id AS instance, 's' || (user_id % 3) AS segment, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id", instant=True)
promql("info_join_sum", "sum by (segment) (user_activity * on (instance, job) group_left (segment) target_info)", _infos, ("segment",), f"SELECT CAST({AT} AS BIGINT) AS step, 's' || (user_id % 3) AS segment, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id % 3", instant=True)
promql("sum_rate", "sum by (event_type) (rate(events_total[1d]))", views.counter, T, _rate(_COUNTER, "rate", 24 * H))

# native histograms: cumulative per day, in powers of two above a zero bucket up to 1
_NATIVE = (
    f"{_GRID}, e AS (SELECT event_type, value, epoch_us(ts) // 86400000000 AS day, CASE WHEN value > 1 THEN CAST(ceil(log2(value)) AS INT) END AS i FROM events), "
    "days AS (SELECT unnest(range((SELECT min(day) FROM e), (SELECT max(day) FROM e) + 1)) AS d), "
    "b AS (SELECT event_type, (d + 1) * 86400000 AS ts, i, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s FROM days JOIN e ON day <= d GROUP BY ALL), "
    "h AS (SELECT event_type, ts, sum(n) AS c, sum(s) AS s, coalesce(sum(n) FILTER (i IS NULL), 0) AS z FROM b GROUP BY event_type, ts), "
)
_SEEN = "hs AS (SELECT step, h.* FROM g JOIN h ON ts > step - 300000 AND ts <= step), bs AS (SELECT step, b.* FROM g JOIN b ON ts > step - 300000 AND ts <= step)"
_N = "event_native"


def _native(name: str, text: str, sql: str, labels: tuple[str, ...] = T, digits: int = 6, seen: str = _SEEN) -> None:
    promql(f"native_{name}", text, views.typed, labels, f"WITH {_NATIVE}{seen} {sql}", digits=digits, hists=views.native)


def _one(value: str, source: str = "hs", digits: int = 6) -> str:
    return f"SELECT step, event_type, {_r(value, digits)} AS value FROM {source}"


def _rank_sql(buckets: str, q: float, by: str = "event_type, ") -> str:
    """Quantile of (step, i, n) buckets: linear in the zero bucket, exponential beyond."""
    return (
        f", cu AS (SELECT *, sum(n) OVER (PARTITION BY {by}step ORDER BY coalesce(i, -99)) AS upto, sum(n) OVER (PARTITION BY {by}step) AS total FROM {buckets}), "
        f"hit AS (SELECT * FROM cu WHERE upto >= {q} * total QUALIFY row_number() OVER (PARTITION BY {by}step ORDER BY upto) = 1) "
        f"SELECT step, {by}{_r(f'CASE WHEN i IS NULL THEN ({q} * total - (upto - n)) / n ELSE pow(2, i - 1 + ({q} * total - (upto - n)) / n) END')} AS value FROM hit"
    )


_VAR = "vs AS (SELECT step, event_type, sum(n * pow(CASE WHEN i IS NULL THEN 0 ELSE pow(2, i - 0.5) END - m, 2)) / sum(n) AS v FROM bs JOIN (SELECT step, event_type, s / c AS m FROM hs) USING (step, event_type) GROUP BY ALL)"
_native("count", f"histogram_count({_N})", _one("c"))
_native("sum", f"histogram_sum({_N})", _one("s"))
_native("avg", f"histogram_avg({_N})", _one("s / c"))
_native("stdvar", f"histogram_stdvar({_N})", _one("v", "vs", 4), digits=4, seen=f"{_SEEN}, {_VAR}")
_native("stddev", f"histogram_stddev({_N})", _one("sqrt(v)", "vs"), seen=f"{_SEEN}, {_VAR}")
_native("quantile", f"histogram_quantile(0.9, {_N})", _rank_sql("bs", 0.9))
_native("quantile_zero_bucket", f"histogram_quantile(0.005, {_N})", _rank_sql("bs", 0.005))
_native("quantiles", f'histogram_quantiles({_N}, "q", 0.25)', _rank_sql("bs", 0.25).replace("SELECT step, event_type, round", "SELECT step, event_type, '0.25' AS q, round"), ("event_type", "q"))
_native("fraction", f"histogram_fraction(2, 24, {_N})", f"SELECT step, event_type, {_r('sum(CASE WHEN i BETWEEN 2 AND 4 THEN n WHEN i = 5 THEN n * log2(24 / 16) ELSE 0 END) / sum(n)')} AS value FROM bs GROUP BY step, event_type")
_GROWN = (
    f"p AS (SELECT step, h.event_type, count(*) AS k, min(ts) AS ft, max(ts) AS lt, arg_min(c, ts) AS fc, arg_max(c, ts) - arg_min(c, ts) AS dc, arg_max(s, ts) - arg_min(s, ts) AS ds_ FROM g JOIN h ON ts > step - {72 * H} AND ts <= step GROUP BY ALL HAVING count(*) > 1), "
    f"q AS (SELECT *, (lt - ft) / 1000 AS si, (lt - ft) / 1000 / (k - 1) AS av, (ft - step + {72 * H}) / 1000 AS a0, (step - lt) / 1000 AS e0 FROM p), "
    "r AS (SELECT *, CASE WHEN a0 >= av * 1.1 THEN av / 2 ELSE a0 END AS a1, CASE WHEN e0 >= av * 1.1 THEN av / 2 ELSE e0 END AS e1 FROM q), "
    "f AS (SELECT *, (si + e1 + CASE WHEN dc > 0 THEN least(a1, si * fc / dc) ELSE a1 END) / si AS factor FROM r)"
)
_native("rate_count", f"histogram_count(rate({_N}[3d]))", _one(f"dc * factor / {72 * 3600}", "f", 9), digits=9, seen=_GROWN)
_native("increase_sum", f"histogram_sum(increase({_N}[3d]))", _one("ds_ * factor", "f", 4), digits=4, seen=_GROWN)
_native("delta_count", f"histogram_count(delta({_N}[3d]))", _one("dc * (si + a1 + e1) / si", "f"), seen=_GROWN)
_TOTAL = f"{_GROWN}, lo AS (SELECT step, event_type, ft, lt, factor FROM f), x AS (SELECT lo.step, b.i, sum(CASE WHEN b.ts = lt THEN b.n ELSE -b.n END * factor) AS n FROM lo JOIN b ON b.event_type = lo.event_type AND (b.ts = lt OR b.ts = ft) GROUP BY ALL HAVING sum(CASE WHEN b.ts = lt THEN b.n ELSE -b.n END) > 0)"
_native("quantile_of_rates", f"histogram_quantile(0.5, sum(increase({_N}[3d])))", _rank_sql("x", 0.5, ""), (), seen=_TOTAL)
_native("sum_over_time", f"histogram_count(sum_over_time({_N}[3d]))", f"SELECT step, event_type, {_r('sum(c)')} AS value FROM g JOIN h ON ts > step - {72 * H} AND ts <= step GROUP BY step, event_type", seen="z AS (SELECT 1)")
_native("avg_over_time", f"histogram_sum(avg_over_time({_N}[3d]))", f"SELECT step, event_type, {_r('sum(s) / count(*)', 4)} AS value FROM g JOIN h ON ts > step - {72 * H} AND ts <= step GROUP BY step, event_type", digits=4, seen="z AS (SELECT 1)")
_native("count_over_time", f"count_over_time({_N}[3d])", f"SELECT step, event_type, CAST(count(*) AS DOUBLE) AS value FROM g JOIN h ON ts > step - {72 * H} AND ts <= step GROUP BY step, event_type", seen="z AS (SELECT 1)")
_native("agg_sum", f"histogram_quantile(0.9, sum({_N}))", _rank_sql("(SELECT step, i, sum(n) AS n FROM bs GROUP BY ALL)", 0.9, ""), ())
_native("agg_avg", f"histogram_count(avg({_N}))", f"SELECT step, {_r('avg(c)')} AS value FROM hs GROUP BY step", ())
_native("agg_count", f"count({_N})", "SELECT step, CAST(count(*) AS DOUBLE) AS value FROM hs GROUP BY step", ())
_native("arithmetic", f"histogram_sum({_N} * 3 - {_N} / 2 + -{_N})", _one("s * 1.5", digits=4), digits=4)
_native("difference", f"histogram_count({_N} - {_N} offset 1d)", _one("hs.c - y.c", "hs JOIN (SELECT event_type, ts + 86400000 AS ts, c FROM h) y USING (event_type, ts)"))
_native("trim_upper", f"histogram_count({_N} </ 24)", f"SELECT step, event_type, {_r('sum(CASE WHEN i IS NULL OR i <= 4 THEN n WHEN i = 5 THEN n * log2(24 / 16) ELSE 0 END)')} AS value FROM bs GROUP BY step, event_type")
_native("trim_lower", f"histogram_count({_N} >/ 0.25)", f"SELECT step, event_type, {_r('sum(CASE WHEN i IS NULL THEN n * 0.75 ELSE n END)')} AS value FROM bs GROUP BY step, event_type")


def _by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.gauge(spark, sf_dir)
    out = Engine(spark, rows, series=C.series_table(rows)).query('sum by (event_type) (sum_over_time(event_value{event_type=~"c.*|v.*"}[1d]))', START, END, STEP)
    return out.select("step", L.get(F.col("labels"), "event_type").alias("event_type"), _rounded(F.col("value"), 6).alias("value"))


QUERIES["promql_series_table"] = _by_series
ORACLES["promql_series_table"] = _with(_GRID, _TYPED, _window(24 * H)) + f"SELECT step, event_type, {_r('fsum(value)')} AS value FROM w WHERE event_type IN ('click', 'view') GROUP BY step, event_type"


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "sort(quantile(1.5, event_value)) or histogram_quantile(-1, event_value) or limit_ratio(-2, event_value)"
    return Engine(spark, views.gauge(spark, sf_dir)).annotations(text, START, END, STEP)


QUERIES["promql_annotations"] = _annotated
ORACLES["promql_annotations"] = """SELECT 'warning' AS level, 'PromQL warning: ' || m AS message FROM (VALUES ('quantile value should be between 0 and 1, got 1.5'), ('quantile value should be between 0 and 1, got -1'),
('ratio value should be between -1 and 1, got -2, capping to -1'), ('sort is ineffective for range queries since results are always ordered by labels')) t(m)
UNION ALL SELECT DISTINCT 'warning', 'PromQL warning: bucket label "le" is missing or has a malformed value of "" for metric name "event_value"' FROM events"""
