"""PromQL compiled to DataFrames.

An expression becomes a ``Vector`` (rows step, labels, name, key, value) or a ``Scalar``
(a Column over ``step``, possibly with one-row-per-step tables beside it).  The step
loop is a column, so all steps of a range query are one plan.  Nothing is collected.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import histograms as H
from ..functions import labels as L
from ..functions import numeric as N
from ..operators import catalog as C
from ..operators import grid as G
from . import promql_parser as P
from .annotations import annotate

LOOKBACK_MS, SUBQUERY_STEP_MS, MAX_DEPTH = 300_000, 60_000, 64
_ids = count()

# fixed values: functions behind the experimental switch
EXPERIMENTAL = {
    "double_exponential_smoothing", "end", "first_over_time", "histogram_quantiles", "info", "mad_over_time", "max_of",
    "min_of", "range", "sort_by_label", "sort_by_label_desc", "start", "step", "ts_of_first_over_time",
    "ts_of_last_over_time", "ts_of_max_over_time", "ts_of_min_over_time",
}
KEEPS_NAME = {"last_over_time", "first_over_time"}
_DATES = {
    "minute": F.minute, "hour": F.hour, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "month": F.month,
    "year": F.year, "day_of_week": lambda t: F.dayofweek(t) - 1, "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
}
_RANGE_FUNCTIONS = {
    "rate", "increase", "delta", "irate", "idelta", "resets", "changes", "deriv", "avg_over_time", "sum_over_time",
    "min_over_time", "max_over_time", "count_over_time", "last_over_time", "first_over_time", "present_over_time",
    "stddev_over_time", "stdvar_over_time", "mad_over_time", "ts_of_min_over_time", "ts_of_max_over_time",
    "ts_of_first_over_time", "ts_of_last_over_time",
}


_HIST_RANGES = {
    "rate", "increase", "delta", "sum_over_time", "avg_over_time", "last_over_time", "count_over_time", "present_over_time",
}
_HIST_READS = {
    "histogram_count": H.histogram_count, "histogram_sum": H.histogram_sum, "histogram_avg": H.histogram_avg,
    "histogram_stddev": H.histogram_stddev, "histogram_stdvar": H.histogram_stdvar,
}


class PlanError(ValueError):
    pass


@dataclass
class Vector:
    df: DataFrame  # step, labels, name, key, value (and ts for bare selectors)
    selector: P.Selector | None = None
    order: list[Column] | None = None
    hist: DataFrame | None = None  # step, labels, name, key, hist: the native histograms


@dataclass
class Scalar:
    col: Column
    sides: list[DataFrame] = field(default_factory=list)  # (step, a column of its own)
    const: float | None = None


@dataclass
class Engine:
    """``samples``: metric, labels (map), key, ts (ms), value, stale.

    ``key`` is the canonical text of ``labels``; sources compute it once per series.
    ``seq``, where there is such a column, orders a series' samples of one time.
    ``hists``: the same with ``hist``, a native histogram, for ``value``.  A float sample of a
    series and time that has a histogram is ignored.
    """

    spark: SparkSession
    samples: DataFrame
    lookback_ms: int = LOOKBACK_MS
    experimental: bool = True
    hists: DataFrame | None = None
    #: metric, key, labels, first, last: where given, matchers pick series there.
    series: DataFrame | None = None

    def __post_init__(self):
        if self.hists is not None:
            self.samples = C.histogram_wins(self.samples, self.hists)

    def query(self, text: str, start: int, end: int | None = None, step: int = 60_000) -> DataFrame:
        """Rows step, labels (with ``__name__`` where kept), key, value; a scalar has no labels."""
        end = start if end is None else end
        tree = P.parse(text, {"start": start, "end": end, "step": step})
        grid = G.Grid(start, end, step)
        if isinstance(tree, P.Text):
            return grid.frame(self.spark).select("step", F.lit(tree.value).alias("value"))
        if isinstance(tree, P.Selector) and tree.range_ms is not None or isinstance(tree, P.Subquery):
            if start != end:
                raise PlanError("a range vector is no result of a range query")
            return self._matrix(tree, grid)
        found = self.compile(tree, grid, 0)
        if isinstance(found, Scalar):
            out = self._per_step(found, grid)
            return out.select("step", L.no_labels().alias("labels"), F.lit("{}").alias("key"), "value")
        named = F.when(F.col("name").isNull(), F.col("labels")).otherwise(L.put(F.col("labels"), "__name__", F.col("name")))
        out = found.df.select("step", named.alias("labels"), "value")
        if found.hist is not None:
            out = out.withColumn("hist", F.lit(None).cast(H.TYPE)).unionByName(
                found.hist.select("step", named.alias("labels"), F.lit(None).cast("double").alias("value"), "hist")
            )
        out = out.withColumn("key", L.series_key(F.col("labels")))
        if found.order and start == end:
            return out.orderBy(*found.order, "key")
        # dropping names may not merge series
        twin = F.count(F.lit(1)).over(Window.partitionBy("step", "key"))
        clash = F.raise_error(F.lit("vector cannot contain metrics with the same labelset"))
        return out.withColumn("value", F.when(twin > 1, clash).otherwise(F.col("value")))

    def annotations(self, text: str, start: int, end: int | None = None, step: int = 60_000) -> DataFrame:
        """Warnings beside the result of ``query``: level, message."""
        return annotate(self, text, start, end, step)

    # -- dispatch ---------------------------------------------------------------

    def compile(self, node, grid: G.Grid, depth: int):
        if depth > MAX_DEPTH:
            raise PlanError("the expression is nested too deeply")
        match node:
            case P.Number(value):
                return Scalar(N.const(value), const=value)
            case P.Text():
                raise PlanError("a string is no operand")
            case P.Selector():
                if node.range_ms is not None:
                    raise PlanError("a range vector needs a function")
                return self._instant(node, grid)
            case P.Subquery():
                raise PlanError("a subquery needs a function")
            case P.Negate(inner):
                found = self.compile(inner, grid, depth + 1)
                out = self._unary(found, lambda v: -v)
                if isinstance(found, Vector) and found.hist is not None:
                    out.hist = self._hist_binary(P.Binary("*", inner, P.Number(-1.0)), found, Scalar(N.const(-1), const=-1.0))
                return out
            case P.Aggregate():
                return self._aggregate(node, grid, depth + 1)
            case P.Binary():
                return self._binary(node, grid, depth + 1)
            case P.Call():
                return self._call(node, grid, depth + 1)
        raise PlanError(f"cannot compile {node!r}")

    # -- selectors ---------------------------------------------------------------

    def _select(self, node: P.Selector, df: DataFrame | None = None) -> DataFrame:
        df = self.samples if df is None else df
        if self.series is not None:
            known = self._matched(self.series, node).select("metric", "key")
            return df.join(known, ["metric", "key"], "left_semi")
        return self._matched(df, node)

    @staticmethod
    def _matched(df: DataFrame, node: P.Selector) -> DataFrame:
        if node.name is not None:
            df = df.where(F.col("metric") == node.name)
        for label, op, value in node.matchers:
            target = F.col("metric") if label == "__name__" else L.get(F.col("labels"), label)
            df = df.where(L.matches(target, op, value))
        return df

    def _times(self, node, grid: G.Grid) -> tuple[G.Grid, bool]:
        """The grid to evaluate on, and whether ``@`` pins it to one time."""
        if node.at is None:
            return grid, False
        at = {"start": grid.start, "end": grid.end}.get(node.at, node.at)
        return G.Grid(at, at, grid.step), True

    def _instant(self, node: P.Selector, grid: G.Grid) -> Vector:
        inner, pinned = self._times(node, grid)
        rows = G.window(self._select(node), "ts", inner, self.lookback_ms, node.offset_ms)
        time = _time(rows)
        newest = rows.groupBy("metric", "key", "step").agg(
            F.max_by("value", time).alias("value"), F.max_by("stale", time).alias("stale"), F.max("ts").alias("ts")
        ).where("NOT stale")
        out = newest.select("step", L.of_key(F.col("key")).alias("labels"), F.col("metric").alias("name"), "key", "value", "ts")
        if pinned:
            out = G.everywhere(out.drop("step"), grid)
        return Vector(out, node, hist=self._instant_hists(node, inner, grid if pinned else None))

    # -- native histograms -----------------------------------------------------------

    def _instant_hists(self, node: P.Selector, grid: G.Grid, everywhere: G.Grid | None) -> DataFrame | None:
        if self.hists is None:
            return None
        rows = G.window(self._select(node, self.hists), "ts", grid, self.lookback_ms, node.offset_ms)
        newest = rows.groupBy("metric", "key", "step").agg(F.max_by("hist", "ts").alias("hist"), F.max_by("stale", "ts").alias("stale")).where("NOT stale")
        out = newest.select("step", L.of_key(F.col("key")).alias("labels"), F.col("metric").alias("name"), "key", "hist")
        return out if everywhere is None else G.everywhere(out.drop("step"), everywhere)

    def _hists_over_time(self, fn: str, node, grid: G.Grid) -> DataFrame | None:
        """Windows of histogram samples folded to a histogram each (or, for counts, a value)."""
        if self.hists is None or not isinstance(node, P.Selector) or fn not in _HIST_RANGES:
            return None
        inner, pinned = self._times(node, grid)
        span, offset = node.range_ms, node.offset_ms
        rows = self._select(node, self.hists).where("NOT stale").withColumnRenamed("metric", "name")
        seen = G.window(rows, "ts", inner, span, offset).groupBy("name", "key", "step")
        if fn in ("count_over_time", "present_over_time"):
            value = F.count(F.lit(1)).cast("double") if fn[0] == "c" else F.max(F.lit(1.0))
            out = seen.agg(value.alias("value"))
        elif fn == "last_over_time":
            out = seen.agg(F.max_by("hist", "ts").alias("hist"))
        elif fn in ("sum_over_time", "avg_over_time"):
            out = H.sum_by(G.window(rows, "ts", inner, span, offset).select("name", "key", "step", "hist"), ["name", "key", "step"], mean=fn[0] == "a")
        else:
            windows = seen.agg(F.sort_array(F.collect_list(F.struct("ts", "hist"))).alias("a"))

            def fold(row: dict) -> dict | None:
                samples, end = [(x["ts"], H.Histogram.of(x["hist"])) for x in row["a"]], row["step"] - offset
                found = H.extrapolated(samples, end - span, end, fn != "delta", fn == "rate")
                return None if found is None else {"hist": found.row()}

            out = H.rowwise(windows, fold, f"hist {H.TYPE}", drop=("a",))
        out = out.withColumn("labels", L.of_key(F.col("key")))
        out = G.everywhere(out.drop("step"), grid) if pinned else out
        return out.withColumn("name", F.col("name") if fn in KEEPS_NAME else F.lit(None).cast("string"))

    def _read_hists(self, hist: DataFrame, value: Column) -> DataFrame:
        return hist.select("step", "labels", F.lit(None).cast("string").alias("name"), "key", value.alias("value"))

    def _hist_call(self, fn: str, args: list, grid: G.Grid, depth: int) -> Vector | None:
        """Functions that read histograms; None where there are none."""
        if self.hists is None:
            return None
        if fn in _HIST_READS:
            if len(args) != 1:
                raise PlanError(f"{fn} takes 1 argument(s)")
            x = self._vector(args[0], grid, depth)
            read = _HIST_READS[fn](F.col("hist"))
            if x.hist is None:
                return Vector(self._read_hists(x.df.withColumn("hist", F.lit(None).cast(H.TYPE)), read).where("false"))
            return Vector(self._read_hists(x.hist, read))
        x = self._vector(args[0] if fn == "histogram_quantiles" else args[-1], grid, depth)
        if x.hist is None:
            return None
        if fn == "histogram_quantiles":
            parts = []
            for q in (self._scalar(a, grid, depth) for a in args[2:]):
                labels = L.put(F.col("labels"), self._text(args[1]), F.lit(_number(q.const)))
                rows = self._read_hists(x.hist, H.histogram_quantile(F.col("hist"), q.const)).withColumn("labels", labels)
                parts.append(rows.withColumn("key", L.series_key(F.col("labels"))))
            found = reduce(DataFrame.unionByName, parts)
        else:
            numbers = [self._scalar(a, grid, depth) for a in args[:-1]]
            if any(n.const is None for n in numbers):
                raise PlanError(f"{fn} of native histograms takes numbers")
            f = H.histogram_quantile if fn == "histogram_quantile" else H.histogram_fraction
            found = self._read_hists(x.hist, f(F.col("hist"), *[n.const for n in numbers]))
        return Vector(self._classic(fn, args, grid, depth).df.select("step", "labels", "name", "key", "value").unionByName(found))

    def _hist_binary(self, node: P.Binary, left, right) -> DataFrame | None:
        """Histograms scaled, divided or trimmed by a number, added and subtracted one to one."""
        op, unnamed = node.op, F.lit(None).cast("string").alias("name")
        sides = [x.hist if isinstance(x, Vector) else None for x in (left, right)]
        if all(x is None for x in sides):
            return None
        if isinstance(left, Vector) and isinstance(right, Vector):
            if op not in ("+", "-") or None in sides or node.group:
                return None
            a, b = (self._signed(x, node) for x in sides)
            both = a.select("step", "sig", "labels", F.col("hist").alias("a")).join(b.select("step", "sig", F.col("hist").alias("b")), ["step", "sig"])
            labels = L.keep(F.col("labels"), node.labels) if node.on else L.remove(F.col("labels"), node.labels)
            sign = 1.0 if op == "+" else -1.0
            merge = lambda r: {"hist": H.Histogram.of(r["a"]).add(H.Histogram.of(r["b"]), sign).row()}
            out = H.rowwise(both.select("step", labels.alias("labels"), "a", "b"), merge, f"hist {H.TYPE}", drop=("a", "b"))
            return out.select("step", "labels", unnamed, L.series_key(F.col("labels")).alias("key"), "hist")
        vector, scalar = (left, right) if isinstance(left, Vector) else (right, left)
        if op not in ("*", "/", "</", ">/") or (vector is right and op != "*"):
            return None
        if op in ("*", "/"):
            by = scalar.col if op == "*" else N.div(N.const(1), scalar.col)
            rows, apply = self._with_sides(vector.hist, scalar).withColumn("by", by), H.Histogram.scale
        else:
            upper = op == "</"
            rows, apply = self._with_sides(vector.hist, scalar).withColumn("by", scalar.col), lambda h, by: h.trim(by, upper)
        rows = rows.select("step", "labels", unnamed, "key", "hist", "by")
        return H.rowwise(rows, lambda r: {"hist": apply(H.Histogram.of(r["hist"]), r["by"]).row()}, f"hist {H.TYPE}", drop=("by",))

    def _hist_aggregate(self, op: str, x: Vector, node: P.Aggregate) -> tuple[DataFrame | None, DataFrame | None]:
        """(histograms, values) that the histograms of a vector add to an aggregation."""
        if x.hist is None or op not in ("sum", "avg", "count", "group"):
            return None, None
        rows = self._grouped(x.hist, node)
        named = lambda df, c: df.select("step", L.of_key(F.col("g")).alias("labels"), F.col("g_name").alias("name"), F.col("g").alias("key"), c)
        if op in ("sum", "avg"):
            return named(H.sum_by(rows.select("step", "g", "g_name", "hist"), ["step", "g", "g_name"], mean=op == "avg"), "hist"), None
        return None, rows

    def _range(self, node, grid: G.Grid, depth: int):
        """(samples with labels/name/key/ts/value, range, offset, grid, pinned) of a range vector."""
        inner, pinned = self._times(node, grid)
        if isinstance(node, P.Selector):
            if node.range_ms is None:
                raise PlanError("this function needs a range vector")
            rows = self._select(node).where("NOT stale").withColumnRenamed("metric", "name")
            return rows, node.range_ms, node.offset_ms, inner, pinned
        if not isinstance(node, P.Subquery):
            raise PlanError("this function needs a range vector")
        step = node.step_ms or SUBQUERY_STEP_MS
        low, high = inner.start - node.offset_ms - node.range_ms, inner.last - node.offset_ms
        first = (low // step + 1) * step  # multiples of the step within (low, high]
        if first > high:
            first = high = max(first, high)
            rows = self.compile(node.expr, G.Grid(first, first, step), depth + 1)
        else:
            rows = self.compile(node.expr, G.Grid(first, high, step), depth + 1)
        if isinstance(rows, Scalar):
            rows = self._as_vector(rows, G.Grid(first, max(first, high), step))
        df = rows.df.select("labels", "name", "key", F.col("step").alias("ts"), "value")
        return df, node.range_ms, node.offset_ms, inner, pinned

    def _matrix(self, node, grid: G.Grid) -> DataFrame:
        rows, span, offset, inner, _ = self._range(node, grid, 0)
        at = inner.start - offset
        rows = rows.where((F.col("ts") > at - span) & (F.col("ts") <= at))
        named = F.when(F.col("name").isNull(), F.col("labels")).otherwise(L.put(F.col("labels"), "__name__", F.col("name")))
        return rows.select(F.col("ts").alias("step"), named.alias("labels"), L.series_key(named).alias("key"), "value")

    # -- range functions -----------------------------------------------------------

    def _over_time(self, fn: str, node, grid: G.Grid, depth: int, param: Scalar | None = None, param2: Scalar | None = None) -> Vector:
        modifier = getattr(node, "modifier", None)
        rows, span, offset, inner, pinned = self._range(node, grid, depth)
        if modifier:
            return self._extended(fn, modifier, rows, span, offset, inner, pinned, grid)
        by = ["name", "key", "step"]
        v, ts = F.col("value"), F.col("ts")
        time = _time(rows)
        newest, oldest = [F.max_by(v, time).alias("s"), F.max(ts).alias("t")], [F.min_by(v, time).alias("s"), F.min(ts).alias("t")]
        simple = {
            "sum_over_time": ([N.sum_of(v).alias("s")], [N.sum_of(F.col("s")).alias("value")]),
            "count_over_time": ([F.count(v).alias("s")], [F.sum("s").cast("double").alias("value")]),
            "avg_over_time": ([N.sum_of(v).alias("s"), F.count(v).alias("n")], [(N.sum_of(F.col("s")) / F.sum("n")).alias("value")]),
            "min_over_time": ([N.min_of(v).alias("s")], [N.min_of(F.col("s")).alias("value")]),
            "max_over_time": ([N.max_of(v).alias("s")], [N.max_of(F.col("s")).alias("value")]),
            "present_over_time": ([F.lit(1.0).alias("s")], [F.lit(1.0).alias("value")]),
            "last_over_time": (newest, [F.max_by("s", "t").alias("value")]),
            "first_over_time": (oldest, [F.min_by("s", "t").alias("value")]),
            "ts_of_last_over_time": ([F.max(ts).alias("s")], [(F.max("s") / 1000).alias("value")]),
            "ts_of_first_over_time": ([F.min(ts).alias("s")], [(F.min("s") / 1000).alias("value")]),
        }
        labels = L.of_key(F.col("key"))
        if fn in simple:
            partial, final = simple[fn]
            dealt = G.bucketed(rows, "ts", inner, span, offset)
            if dealt is None:
                one = G.window(rows, "ts", inner, span, offset).groupBy(*by).agg(*partial)
            else:
                one = G.spread(dealt.groupBy("name", "key", "bucket").agg(*partial), inner, span)
            out = one.groupBy(*by).agg(*final).withColumn("labels", labels)
        elif fn in ("stddev_over_time", "stdvar_over_time", "deriv", "predict_linear"):
            seen = G.window(rows, "ts", inner, span, offset)
            x = (ts - F.col("step") + F.lit(offset)) / 1000
            facts = seen.groupBy(*by).agg(
                F.var_pop(v).alias("variance"), F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
                F.regr_slope(v, x).alias("slope"), F.regr_intercept(v, x).alias("level"),
            ).withColumn("labels", labels)
            flat, endless = F.col("low") == F.col("high"), F.abs("low") == N.INF
            slope = F.when(flat, F.when(endless, N.const(N.NAN)).otherwise(0.0)).otherwise(F.col("slope"))
            if fn == "deriv":
                out = facts.where("n > 1").withColumn("value", slope)
            elif fn == "predict_linear":
                level = F.when(flat & ~endless, F.col("low")).otherwise(F.col("level"))
                out = self._with_sides(facts.where("n > 1"), param).withColumn("value", level + slope * param.col)
            else:
                out = facts.withColumn("value", F.sqrt("variance") if fn[:6] == "stddev" else F.col("variance"))
        elif fn in ("rate", "increase", "delta", "resets"):
            out = self._extrapolated(fn, rows, span, offset, inner)
        else:
            seen = G.window(rows, "ts", inner, span, offset)
            arrays = seen.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*_order(seen), "value"))).alias("a")).withColumn("labels", labels)
            sides = [*(param.sides if param else ()), *(param2.sides if param2 else ())]
            for side in sides:
                arrays = arrays.join(F.broadcast(side), "step", "left")  # one row per step
            value = self._folded(fn, inner, offset, param and param.col, param2 and param2.col)
            out = arrays.withColumn("value", value).where(F.col("value").isNotNull())
        if pinned:
            out = G.everywhere(out.drop("step"), grid)
        name = F.col("name") if fn in KEEPS_NAME else F.lit(None).cast("string")
        out = out.select("step", "labels", name.alias("name"), "key", "value")
        hist = self._hists_over_time(fn, node, grid)
        if hist is not None and "value" in hist.columns:
            return Vector(out.unionByName(hist.select(*out.columns)))
        return Vector(out, hist=hist)

    def _extrapolated(self, fn: str, rows: DataFrame, span: int, offset: int, grid: G.Grid) -> DataFrame:
        before = Window.partitionBy("name", "key").orderBy(*_order(rows), "value")
        near = rows.where((F.col("ts") > grid.start - offset - span) & (F.col("ts") <= grid.last - offset))
        near = near.withColumn("p_ts", F.lag("ts").over(before)).withColumn("p", F.lag("value").over(before))
        near = near.withColumn("at", F.row_number().over(before))  # first and last of samples of one time
        begin = F.col("step") - F.lit(offset + span)
        if fn == "resets":
            fallen = F.when(N.COMPARISON[">"](F.col("p"), F.col("value")), 1.0).otherwise(0.0)
        else:
            fallen = F.when(F.col("value") < F.col("p"), F.col("p")).otherwise(F.lit(0.0))
        edges = [
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("f_ts"), F.min_by("value", "at").alias("f"),
            F.max("ts").alias("l_ts"), F.max_by("value", "at").alias("l"),
        ]
        dealt = G.bucketed(near, "ts", grid, span, offset)
        if dealt is None:
            inside = F.when(F.col("p_ts") > begin, fallen).otherwise(F.lit(0.0))
            out = G.window(near, "ts", grid, span, offset).groupBy("name", "key", "step").agg(*edges, F.sum(inside).alias("resets"))
        else:
            # a bucket's first sample may have fallen from one of an earlier bucket, which a
            # window holds or not; all other falls are the bucket's own
            across = F.col("p_ts") <= F.col("bucket") - F.lit(offset + grid.step)
            own = dealt.groupBy("name", "key", "bucket").agg(
                *edges, F.sum(F.when(across, 0.0).otherwise(fallen)).alias("own"),
                F.max(F.when(across, F.col("p_ts"))).alias("c_ts"), F.max(F.when(across, fallen)).alias("c"),
            )
            out = G.spread(own, grid, span).groupBy("name", "key", "step").agg(
                F.sum("n").alias("n"), F.min("f_ts").alias("f_ts"), F.min_by("f", "f_ts").alias("f"), F.max("l_ts").alias("l_ts"), F.max_by("l", "l_ts").alias("l"),
                F.sum(F.col("own") + F.when(F.col("c_ts") > begin, F.col("c")).otherwise(F.lit(0.0))).alias("resets"),
            )
        out = out.withColumn("labels", L.of_key(F.col("key")))
        if fn == "resets":
            return out.withColumn("value", F.col("resets"))
        out = out.where("n >= 2 AND l_ts > f_ts")
        counter = fn != "delta"
        change = F.col("l") - F.col("f")
        out = out.withColumn("res", change + F.col("resets") if counter else change)
        end = F.col("step") - F.lit(offset)
        out = (
            out.withColumn("ds", (F.col("f_ts") - (end - F.lit(span))) / 1000)
            .withColumn("de", (end - F.col("l_ts")) / 1000)
            .withColumn("si", (F.col("l_ts") - F.col("f_ts")) / 1000)
            .withColumn("mean", F.col("si") / (F.col("n") - 1))
            .withColumn("ds", F.when(F.col("ds") >= F.col("mean") * 1.1, F.col("mean") / 2).otherwise(F.col("ds")))
            .withColumn("de", F.when(F.col("de") >= F.col("mean") * 1.1, F.col("mean") / 2).otherwise(F.col("de")))
        )
        if counter:
            zero = F.when((F.col("res") > 0) & (F.col("f") >= 0), F.col("si") * N.div(F.col("f"), F.col("res"))).otherwise(F.col("ds"))
            out = out.withColumn("ds", F.least("ds", zero))
        factor = (F.col("si") + F.col("ds") + F.col("de")) / F.col("si")
        if fn == "rate":
            factor = factor / F.lit(span / 1000)
        return out.withColumn("value", F.col("res") * factor)

    def _folded(self, fn: str, grid: G.Grid, offset: int, param: Column | None, param2: Column | None) -> Column:
        """Functions that need the window's samples in order; null drops the series."""
        a, values = F.col("a"), F.transform(F.col("a"), lambda x: x["value"])
        n, last, before = F.size("a"), F.element_at(F.col("a"), -1), F.get(F.col("a"), F.size("a") - 2)
        pairs = lambda use: F.aggregate(  # noqa: E731  a count over neighbours
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0),
            lambda s, i: s + F.when((n > 1) & use(F.get(a, i - 1)["value"], F.get(a, i)["value"]), 1.0).otherwise(0.0),
        )
        seconds = (last["ts"] - before["ts"]) / 1000
        if fn == "irate":
            rise = F.when(last["value"] < before["value"], last["value"]).otherwise(last["value"] - before["value"])
            return F.when((n > 1) & (seconds > 0), rise / seconds)
        if fn == "idelta":
            return F.when((n > 1) & (seconds > 0), last["value"] - before["value"])
        if fn == "resets":
            return pairs(N.COMPARISON[">"])
        if fn == "changes":
            return pairs(lambda x, y: N.COMPARISON["!="](x, y) & ~(F.isnan(x) & F.isnan(y)))
        if fn == "quantile_over_time":
            return N.quantile(values, param)
        if fn == "mad_over_time":
            half = N.const(0.5)
            return N.let(N.quantile(values, half), lambda middle: N.quantile(F.transform(values, lambda x: F.abs(x - middle)), half))
        if fn in ("ts_of_min_over_time", "ts_of_max_over_time"):
            better = N.COMPARISON["<=" if "min" in fn else ">="]
            pick = F.aggregate(
                a, F.get(a, F.lit(0)),
                lambda s, x: F.when(better(x["value"], s["value"]) | F.isnan(s["value"]), x).otherwise(s),
            )
            return pick["ts"] / 1000
        if fn == "double_exponential_smoothing":
            start = F.struct(F.get(a, F.lit(0))["value"].alias("s"), (F.get(a, F.lit(1))["value"] - F.get(a, F.lit(0))["value"]).alias("b"), F.lit(0).alias("i"))

            def smooth(s: Column, x: Column) -> Column:
                level = param * x["value"] + (1 - param) * (s["s"] + s["b"])
                trend = param2 * (level - s["s"]) + (1 - param2) * s["b"]
                return F.when(s["i"] == 0, F.struct(s["s"].alias("s"), s["b"].alias("b"), F.lit(1).alias("i"))).otherwise(
                    F.struct(level.alias("s"), trend.alias("b"), F.lit(1).alias("i"))
                )

            return F.when(n > 1, F.aggregate(a, start, smooth)["s"])
        raise PlanError(f"unknown function {fn}")

    def _extended(self, fn: str, modifier: str, rows, span: int, offset: int, grid: G.Grid, pinned: bool, outer: G.Grid) -> Vector:
        """``anchored`` and ``smoothed`` ranges: values at both window edges from the samples
        around them (the last one before; or interpolated between neighbours)."""
        allowed = {"anchored": {"rate", "increase", "delta", "resets", "changes"}, "smoothed": {"rate", "increase", "delta"}}[modifier]
        if fn not in allowed:
            raise PlanError(f"{modifier} works with {', '.join(sorted(allowed))} only")
        ahead = self.lookback_ms if modifier == "smoothed" else 0
        wide = G.window(rows, "ts", grid, span + self.lookback_ms + ahead, offset - ahead)
        arrays = wide.groupBy("name", "key", "step").agg(_samples(wide).alias("all")).withColumn("labels", L.of_key(F.col("key")))
        end = F.col("step") - F.lit(offset)
        begin = end - F.lit(span)
        everything = F.col("all")
        upto = lambda t: F.element_at(F.filter(everything, lambda x: x["ts"] <= t), -1)
        after = lambda t: F.get(F.filter(everything, lambda x: x["ts"] > t), F.lit(0))
        inside = F.filter(everything, lambda x: (x["ts"] > begin) & (x["ts"] <= end))
        last = lambda t: F.when(F.size(F.filter(everything, lambda x: x["ts"] <= t)) > 0, upto(t)["value"])

        def edge(t: Column) -> Column:
            if modifier == "anchored":
                return F.coalesce(last(t), after(t)["value"])
            left = F.when(F.size(F.filter(everything, lambda x: x["ts"] <= t)) > 0, upto(t))
            right = after(t)
            weight = (t - left["ts"]) / (right["ts"] - left["ts"])
            # across a counter's reset the climb starts at zero
            base = F.when(F.lit(fn != "delta") & (right["value"] < left["value"]), F.lit(0.0)).otherwise(left["value"])
            between = F.when(left["ts"] == t, left["value"]).otherwise(base + (right["value"] - base) * weight)
            return F.coalesce(F.when(left.isNotNull() & right.isNotNull(), between), left["value"], right["value"])

        point = lambda t, v: F.struct(t.alias("ts"), v.alias("value"))
        framed = F.concat(F.array(point(begin, edge(begin))), F.filter(inside, lambda x: x["ts"] < end), F.array(point(end, edge(end))))
        there = lambda use: F.exists(everything, use)
        seen = there(lambda x: (x["ts"] > begin) & (x["ts"] <= end)) if modifier == "anchored" else there(lambda x: x["ts"] > begin) & there(lambda x: x["ts"] <= end)
        arrays = arrays.where(seen).withColumn("a", framed)
        if fn in ("resets", "changes"):
            value = self._folded(fn, grid, offset, None, None)
        else:
            a = F.col("a")
            value = F.element_at(a, -1)["value"] - F.get(a, F.lit(0))["value"]
            if fn != "delta":
                value = value + F.aggregate(
                    F.sequence(F.lit(1), F.size(a) - 1), F.lit(0.0),
                    lambda s, i: s + F.when(F.get(a, i)["value"] < F.get(a, i - 1)["value"], F.get(a, i - 1)["value"]).otherwise(0.0),
                )
            if fn == "rate":
                value = value / F.lit(span / 1000)
        out = arrays.withColumn("value", value)
        if pinned:
            out = G.everywhere(out.drop("step"), outer)
        return Vector(out.select("step", "labels", F.lit(None).cast("string").alias("name"), "key", "value"))

    # -- helpers ---------------------------------------------------------------------

    def _with_sides(self, df: DataFrame, scalar: Scalar) -> DataFrame:
        for side in scalar.sides:
            df = df.join(F.broadcast(side), "step", "left")  # one row per step
        return df

    def _per_step(self, s: Scalar, grid: G.Grid) -> DataFrame:
        return self._with_sides(grid.frame(self.spark), s).select("step", s.col.alias("value"))

    def _as_vector(self, s: Scalar, grid: G.Grid) -> Vector:
        df = self._per_step(s, grid)
        return Vector(df.select("step", L.no_labels().alias("labels"), F.lit(None).cast("string").alias("name"), F.lit("{}").alias("key"), "value"))

    def _map(self, v: Vector, value: Column, scalar: Scalar | None = None, keep_name: bool = False) -> Vector:
        df = self._with_sides(v.df, scalar) if scalar else v.df
        name = F.col("name") if keep_name else F.lit(None).cast("string")
        return Vector(df.select("step", "labels", name.alias("name"), "key", value.alias("value")))

    def _unary(self, x, f):
        if isinstance(x, Scalar):
            return Scalar(f(x.col), x.sides)
        return self._map(x, f(F.col("value")))

    def _vector(self, node, grid, depth) -> Vector:
        found = self.compile(node, grid, depth)
        if not isinstance(found, Vector):
            raise PlanError("expected an instant vector")
        return found

    def _scalar(self, node, grid, depth) -> Scalar:
        found = self.compile(node, grid, depth)
        if not isinstance(found, Scalar):
            raise PlanError("expected a scalar")
        return found

    @staticmethod
    def _text(node) -> str:
        if not isinstance(node, P.Text):
            raise PlanError("expected a string")
        return node.value

    def _checked(self, df: DataFrame) -> DataFrame:
        twin = F.count(F.lit(1)).over(Window.partitionBy("step", "key", "name"))
        clash = F.raise_error(F.lit("vector cannot contain metrics with the same labelset"))
        return df.withColumn("value", F.when(twin > 1, clash).otherwise(F.col("value")))

    # -- functions -----------------------------------------------------------------------

    def _call(self, node: P.Call, grid: G.Grid, depth: int):
        fn, args = node.name, node.args
        if fn in EXPERIMENTAL and not self.experimental:
            raise PlanError(f"{fn} is experimental")

        def arity(low: int, high: int | None = None) -> None:
            if not low <= len(args) <= (low if high is None else high):
                raise PlanError(f"{fn} takes {low}{'' if high is None else f' to {high}'} argument(s)")

        v = F.col("value")
        if fn in _RANGE_FUNCTIONS:
            arity(1)
            return self._over_time(fn, args[0], grid, depth)
        if fn == "quantile_over_time":
            arity(2)
            return self._over_time(fn, args[1], grid, depth, self._scalar(args[0], grid, depth))
        if fn == "predict_linear":
            arity(2)
            return self._over_time(fn, args[0], grid, depth, self._scalar(args[1], grid, depth))
        if fn == "double_exponential_smoothing":
            arity(3)
            factors = [self._scalar(x, grid, depth) for x in args[1:]]
            if any(s.const is not None and not 0 < s.const < 1 for s in factors):
                raise PlanError("smoothing and trend factors lie between 0 and 1")
            return self._over_time(fn, args[0], grid, depth, *factors)
        if fn in N.ELEMENTWISE:
            arity(1)
            return self._map(self._vector(args[0], grid, depth), N.ELEMENTWISE[fn](v))
        if fn in ("clamp", "clamp_min", "clamp_max"):
            arity(3 if fn == "clamp" else 2)
            x = self._vector(args[0], grid, depth)
            bounds = [self._scalar(a, grid, depth) for a in args[1:]]
            sides = Scalar(v, [s for b in bounds for s in b.sides])
            if fn == "clamp":
                out = self._map(x, N.greatest(bounds[0].col, N.least(bounds[1].col, v)), sides)
                if all(b.const is not None for b in bounds):
                    return Vector(out.df.where(F.lit(not bounds[1].const < bounds[0].const)))
                kept = self._with_sides(x.df, sides).where(~(bounds[1].col < bounds[0].col))
                return Vector(kept.select("step", "labels", F.lit(None).cast("string").alias("name"), "key", N.greatest(bounds[0].col, N.least(bounds[1].col, v)).alias("value")))
            return self._map(x, (N.greatest if fn == "clamp_min" else N.least)(bounds[0].col, v), sides)
        if fn == "round":
            arity(1, 2)
            x = self._vector(args[0], grid, depth)
            to = self._scalar(args[1], grid, depth) if len(args) > 1 else Scalar(N.const(1))
            return self._map(x, N.round_to(v, to.col), to)
        if fn == "pi":
            arity(0)
            return Scalar(N.const(math.pi), const=math.pi)
        if fn in ("max_of", "min_of"):
            arity(2)
            a, b = (self._scalar(x, grid, depth) for x in args)
            return Scalar((N.greatest if fn == "max_of" else N.least)(a.col, b.col), a.sides + b.sides)
        if fn in ("start", "end", "step", "range"):
            arity(0)
            value = {"start": grid.start, "end": grid.end, "step": grid.step, "range": grid.end - grid.start}[fn] / 1000
            return Scalar(N.const(value), const=value)
        if fn == "time":
            arity(0)
            return Scalar(F.col("step") / 1000)
        if fn == "timestamp":
            arity(1)
            x = self._vector(args[0], grid, depth)
            at = F.col("ts") if x.selector is not None else F.col("step")
            return self._map(x, at / 1000)
        if fn in _DATES:
            arity(0, 1)
            x = self._vector(args[0], grid, depth) if args else self._as_vector(Scalar(F.col("step") / 1000), grid)
            whole = F.when(F.isnan(v) | (F.abs(v) > 8.2e12), None).otherwise(N.floor(v))
            # UTC civil time, whatever zone the session has
            at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(whole.cast("long")).cast("timestamp_ntz"))
            return self._map(x, F.coalesce(_DATES[fn](at).cast("double"), N.const(N.NAN)))
        if fn == "scalar":
            arity(1)
            x, name = self._vector(args[0], grid, depth), f"s{next(_ids)}"
            one = x.df.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("v"))
            side = one.select("step", F.when(F.col("n") == 1, F.col("v")).alias(name))
            return Scalar(F.coalesce(F.col(name), N.const(N.NAN)), [side])
        if fn == "vector":
            arity(1)
            return self._as_vector(self._scalar(args[0], grid, depth), grid)
        if fn in ("absent", "absent_over_time"):
            arity(1)
            if fn == "absent":
                present = self._vector(args[0], grid, depth).df
            else:
                present = self._over_time("present_over_time", args[0], grid, depth).df
            target = args[0] if isinstance(args[0], P.Selector) else None
            pairs: dict[str, str] = {}
            if target is not None:
                seen = [m[0] for m in target.matchers]
                pairs = {n: x for n, op, x in target.matchers if op == "=" and seen.count(n) == 1 and n != "__name__" and x}
            missing = grid.frame(self.spark).join(present.select("step").distinct(), "step", "left_anti")
            labels = L.literal(pairs)
            return Vector(missing.select("step", labels.alias("labels"), F.lit(None).cast("string").alias("name"), L.series_key(labels).alias("key"), F.lit(1.0).alias("value")))
        if fn in ("sort", "sort_desc"):
            arity(1)
            x = self._vector(args[0], grid, depth)
            return Vector(x.df, order=[F.isnan("value"), F.asc("value") if fn == "sort" else F.desc("value")])
        if fn in ("sort_by_label", "sort_by_label_desc"):
            x = self._vector(args[0], grid, depth)
            natural = [_natural(L.get(F.col("labels"), self._text(a))) for a in args[1:]]
            return Vector(x.df, order=[c.desc() if fn.endswith("desc") else c.asc() for c in natural])
        if fn == "label_replace":
            arity(5)
            x = self._vector(args[0], grid, depth)
            target, replacement, source, pattern = map(self._text, args[1:])
            anchored = L.anchored(pattern, dot_all=True)
            value = (F.col("name") if source == "__name__" else L.get(F.col("labels"), source))
            value = F.coalesce(value, F.lit(""))
            new = F.regexp_replace(value, anchored, L.java_replacement(replacement))
            return self._relabelled(x, target, F.when(value.rlike(anchored), new), only=value.rlike(anchored))
        if fn == "label_join":
            x = self._vector(args[0], grid, depth)
            target, between, *sources = map(self._text, args[1:])
            parts = [F.coalesce(F.col("name"), F.lit("")) if s == "__name__" else L.get(F.col("labels"), s) for s in sources]
            return self._relabelled(x, target, F.concat_ws(between, *parts) if parts else F.lit(""))
        if fn in _HIST_READS or fn in ("histogram_quantile", "histogram_fraction", "histogram_quantiles"):
            native = self._hist_call(fn, args, grid, depth)
            if native is not None:
                return native
            if fn in _HIST_READS:
                raise PlanError(f"{fn} needs native histograms")
            return self._classic(fn, args, grid, depth)
        if fn == "info":
            arity(1, 2)
            return self._info(self._vector(args[0], grid, depth), args[1] if len(args) > 1 else None, grid)
        raise PlanError(f"unknown function {fn}")

    def _relabelled(self, x: Vector, target: str, value: Column, only: Column | None = None) -> Vector:
        if target == "__name__":
            name = value if only is None else F.when(only, value).otherwise(F.col("name"))
            return Vector(self._checked(x.df.withColumn("name", F.nullif(name, F.lit("")))))
        labels = L.put(F.col("labels"), target, value)
        labels = labels if only is None else F.when(only, labels).otherwise(F.col("labels"))
        df = x.df.withColumn("labels", labels).withColumn("key", L.series_key(F.col("labels")))
        return Vector(self._checked(df).select("step", "labels", "name", "key", "value"))

    def _buckets(self, x: Vector) -> DataFrame:
        """step, key, labels (without le) and ``b``: ascending (le, count), cumulative."""
        le = F.regexp_replace(L.get(F.col("labels"), "le"), r"^\+?Inf$", "Infinity").try_cast("double")
        rows = x.df.withColumn("le", le).where(F.col("le").isNotNull())
        rows = rows.withColumn("labels", L.remove(F.col("labels"), ["le"])).withColumn("key", L.series_key(F.col("labels")))
        same = rows.groupBy("step", "key", "le").agg(F.first("labels").alias("labels"), F.sum("value").alias("n"))
        arrays = same.groupBy("step", "key").agg(F.first("labels").alias("labels"), F.sort_array(F.collect_list(F.struct("le", "n"))).alias("raw"))
        kind = "struct<done: array<struct<le: double, n: double>>, top: double>"
        rise = F.expr(
            f"aggregate(raw, CAST(named_struct('done', array(), 'top', 0D) AS {kind}), (s, x) -> named_struct("
            "'done', concat(s.done, array(named_struct('le', x.le, 'n', greatest(x.n, s.top)))), 'top', greatest(x.n, s.top)), s -> s.done)"
        )
        return arrays.withColumn("b", rise)

    def _classic(self, fn: str, args: list, grid: G.Grid, depth: int) -> Vector:
        if fn == "histogram_quantiles":
            x, label = self._vector(args[0], grid, depth), self._text(args[1])
            qs = [self._scalar(a, grid, depth) for a in args[2:]]
            if not 1 <= len(qs) <= 10 or any(q.const is None for q in qs):
                raise PlanError("histogram_quantiles takes 1 to 10 numbers")
            base = self._buckets(x)
            each = F.explode(F.array(*[F.struct(F.lit(_number(q.const)).alias("l"), _bucket_quantile(q.col).alias("v")) for q in qs]))
            df = base.withColumn("q", each).withColumn("labels", L.put(F.col("labels"), label, F.col("q.l")))
            return Vector(df.select("step", "labels", F.lit(None).cast("string").alias("name"), L.series_key(F.col("labels")).alias("key"), F.col("q.v").alias("value")))
        x = self._vector(args[-1], grid, depth)
        numbers = [self._scalar(a, grid, depth) for a in args[:-1]]
        base = self._with_sides(self._buckets(x), Scalar(F.col("b"), [s for n in numbers for s in n.sides]))
        value = _bucket_quantile(numbers[0].col) if fn == "histogram_quantile" else _bucket_fraction(numbers[0].col, numbers[1].col)
        return Vector(base.select("step", "labels", F.lit(None).cast("string").alias("name"), "key", value.alias("value")))

    def _info(self, x: Vector, selector, grid: G.Grid) -> Vector:
        """Adds the data labels of ``*_info`` series with the same instance and job."""
        wanted = selector.matchers if selector is not None else []
        names = [m for m in wanted if m[0] == "__name__"]
        data = [m for m in wanted if m[0] != "__name__"]
        pick = P.Selector(None if names else "target_info", names + data)
        infos = self._instant(pick, grid).df
        identity = ("instance", "job")
        i = infos.withColumn("sig", L.series_key(L.keep(F.col("labels"), identity)))
        newest = i.groupBy("step", "sig", "name").agg(F.max("ts").alias("ts"))
        twice = i.join(newest, ["step", "sig", "name", "ts"])
        one = twice.groupBy("step", "sig", "name").agg(F.count(F.lit(1)).alias("n"), F.first("labels").alias("info"))
        clash = F.raise_error(F.lit("found duplicate series for info metric"))
        extra = L.remove(F.col("info"), identity)
        chosen = [m[0] for m in data]
        extra = L.keep(extra, chosen) if chosen else extra
        merged = one.withColumn("extra", F.when(F.col("n") > 1, clash).otherwise(extra)).groupBy("step", "sig").agg(F.collect_list("extra").alias("extras"))
        merged = merged.withColumn("extra", F.aggregate("extras", L.no_labels(), lambda s, m: F.map_concat(s, F.map_filter(m, lambda k, v: ~F.map_contains_key(s, k)))))
        left = x.df.withColumn("sig", L.series_key(L.keep(F.col("labels"), identity)))
        joined = left.join(merged.select("step", "sig", "extra"), ["step", "sig"], "left" if not any(not _matches_empty(m) for m in data) else "inner")
        own = F.col("labels")
        new = F.coalesce(F.map_filter(F.col("extra"), lambda k, v: ~F.map_contains_key(own, k)), L.no_labels())
        df = joined.withColumn("labels", F.map_concat(own, new)).withColumn("key", L.series_key(F.col("labels")))
        return Vector(df.select("step", "labels", "name", "key", "value"))

    # -- aggregations -----------------------------------------------------------------

    def _grouped(self, df: DataFrame, node: P.Aggregate) -> DataFrame:
        """Adds g_labels, g_name and group key g."""
        labels = F.col("labels")
        if node.labels is None:
            g, name = L.no_labels(), F.lit(None).cast("string")
        elif node.without:
            g, name = L.remove(labels, node.labels), F.lit(None).cast("string")
        else:
            g = L.keep(labels, node.labels)
            name = F.col("name") if "__name__" in node.labels else F.lit(None).cast("string")
        return df.withColumn("g_labels", g).withColumn("g_name", name).withColumn("g", L.series_key(F.col("g_labels")))

    def _aggregate(self, node: P.Aggregate, grid: G.Grid, depth: int) -> Vector:
        x = self._vector(node.expr, grid, depth)
        df, v, op = self._grouped(x.df, node), F.col("value"), node.op
        hist, counted = self._hist_aggregate(op, x, node)
        if counted is not None:
            df = df.select("step", "g", "g_name", "value").unionByName(counted.select("step", "g", "g_name", F.lit(1.0).alias("value")))
        by = ["step", "g", "g_name"]
        group = Window.partitionBy(*by)
        if op in ("topk", "bottomk", "limitk", "limit_ratio"):
            k = self._scalar(node.param, grid, depth)
            df = self._with_sides(df, k)
            if op == "limit_ratio":
                share = _series_share(F.col("name"), F.col("key"))
                ratio = N.least(N.greatest(k.col, N.const(-1)), N.const(1))
                picked = df.where(F.when(ratio >= 0, share < ratio).otherwise(share >= 1 + ratio))
            else:
                ranked = {"topk": [F.isnan(v), v.desc()], "bottomk": [F.isnan(v), v.asc()], "limitk": []}[op]
                rank = F.row_number().over(group.orderBy(*ranked, "key", "name"))
                number = F.when(F.isnan(k.col), F.raise_error(F.lit("parameter value is NaN"))).otherwise(k.col)
                # a literal bound lets each task cut its groups before the shuffle
                most = F.lit(max(0, math.floor(min(k.const, 2**31 - 1)))) if k.const is not None and not math.isnan(k.const) else N.floor(number)
                picked = df.withColumn("rank", rank).where(F.col("rank") <= most)
            return Vector(picked.select("step", "labels", "name", "key", "value"), order=[F.isnan("value"), F.desc("value") if op == "topk" else F.asc("value")] if op in ("topk", "bottomk") else None)
        if op == "count_values":
            label = self._text(node.param)
            df = df.withColumn("g_labels", L.put(F.col("g_labels"), label, N.go_format(v))).withColumn("g", L.series_key(F.col("g_labels")))
            out = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("value"))
        elif op == "quantile":
            q = self._scalar(node.param, grid, depth)
            arrays = df.groupBy(*by).agg(F.collect_list("value").alias("vs"))
            out = self._with_sides(arrays, q).withColumn("value", N.quantile(F.col("vs"), q.col))
        else:
            value = {
                "sum": N.sum_of(v), "avg": N.avg_of(v), "min": N.min_of(v), "max": N.max_of(v), "count": F.count(F.lit(1)).cast("double"),
                "group": F.max(F.lit(1.0)), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v),
            }[op]
            out = df.groupBy(*by).agg(value.alias("value"))
        return Vector(out.select("step", L.of_key(F.col("g")).alias("labels"), F.col("g_name").alias("name"), F.col("g").alias("key"), "value"), hist=hist)

    # -- binary operators ---------------------------------------------------------------

    def _binary(self, node: P.Binary, grid: G.Grid, depth: int):
        left, right = self.compile(node.left, grid, depth), self.compile(node.right, grid, depth)
        op = node.op
        compare = op in P.COMPARISONS
        f = N.COMPARISON[op] if compare else N.ARITHMETIC.get(op)
        if op in P.SETS:
            if not (isinstance(left, Vector) and isinstance(right, Vector)):
                raise PlanError("set operators need two vectors")
            return self._set(node, left, right)
        hist = self._hist_binary(node, left, right)
        if f is None:
            if hist is None:
                raise PlanError(f"{op} is for native histograms")
            return Vector(hist.select("step", "labels", "name", "key", F.lit(None).cast("double").alias("value")).where("false"), hist=hist)
        out = self._float_binary(node, left, right, f, compare)
        if isinstance(out, Vector):
            out.hist = hist
        return out

    def _float_binary(self, node: P.Binary, left, right, f, compare: bool):
        op = node.op
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if compare and not node.bool_:
                raise PlanError("comparisons between scalars need bool")
            out = f(left.col, right.col)
            return Scalar(F.when(out, 1.0).otherwise(0.0) if compare else out, left.sides + right.sides)
        if isinstance(left, Vector) and isinstance(right, Vector):
            return self._match(node, left, right, f, compare)
        vector, scalar = (left, right) if isinstance(left, Vector) else (right, left)
        v = F.col("value")
        out = f(v, scalar.col) if vector is left else f(scalar.col, v)
        if not compare:
            return self._map(vector, out, scalar)
        if node.bool_:
            return self._map(vector, F.when(out, 1.0).otherwise(0.0), scalar)
        df = self._with_sides(vector.df, scalar).where(out)
        return Vector(df.select("step", "labels", "name", "key", "value"))

    def _signed(self, df: DataFrame, node: P.Binary) -> DataFrame:
        labels = F.col("labels")
        if node.on:
            sig = L.keep(labels, node.labels)
            if "__name__" in node.labels:
                sig = L.put(sig, "__name__", F.col("name"))
        else:
            sig = L.remove(labels, node.labels)
        # never null: a null check of the join would reach the scan and keep its two sides apart
        return df.withColumn("sig", F.coalesce(L.series_key(sig), F.lit("{}")))

    def _set(self, node: P.Binary, left: Vector, right: Vector) -> Vector:
        a, b = self._signed(left.df, node), self._signed(right.df, node)
        columns = ["step", "labels", "name", "key", "value"]
        if node.op == "or":
            rest = b.join(a.select("step", "sig").distinct(), ["step", "sig"], "left_anti")
            return Vector(a.select(*columns).unionByName(rest.select(*columns)))
        how = "left_semi" if node.op == "and" else "left_anti"
        return Vector(a.join(b.select("step", "sig").distinct(), ["step", "sig"], how).select(*columns))

    def _match(self, node: P.Binary, left: Vector, right: Vector, f, compare: bool) -> Vector:
        swapped = node.group == "right"
        many, one = (right, left) if swapped else (left, right)
        a, b = self._signed(many.df, node), self._signed(one.df, node)
        side = "right" if swapped else "left"
        clash = lambda which: F.raise_error(F.lit(f"many-to-many matching: duplicate series on the {which} side"))
        ones = b.groupBy("step", "sig").agg(
            F.count(F.lit(1)).alias("n"), F.first(F.struct("value", "labels", "name")).alias("o")
        ).select("step", "sig", F.when(F.col("n") > 1, clash("one")).otherwise(F.col("o")).alias("o"))
        fill_many, fill_one = (node.fill.get("right"), node.fill.get("left")) if swapped else (node.fill.get("left"), node.fill.get("right"))
        how = "full" if fill_many is not None and fill_one is not None else "left" if fill_one is not None else "right" if fill_many is not None else "inner"
        if node.group is None:
            twin = F.count(F.lit(1)).over(Window.partitionBy("step", "sig"))
            a = a.withColumn("twin", twin)
        else:
            a = a.withColumn("twin", F.lit(1))
        # the check must not be pruned: it rides on the value
        a = a.select("step", "sig", F.col("labels").alias("m_labels"), F.col("name").alias("m_name"), "value", "twin")
        joined = a.join(ones, ["step", "sig"], how)
        mine = F.when(F.col("twin") > 1, clash("many")).otherwise(F.col("value"))
        theirs = F.col("o.value")
        mine = F.coalesce(mine, N.const(fill_many)) if fill_many is not None else mine
        theirs = F.coalesce(theirs, N.const(fill_one)) if fill_one is not None else theirs
        lhs, rhs = (theirs, mine) if swapped else (mine, theirs)
        joined = joined.withColumn("lhs", lhs).withColumn("rhs", rhs)
        out = f(F.col("lhs"), F.col("rhs"))
        base = F.coalesce(F.col("m_labels"), F.col("o.labels"))
        if node.group is None:
            labels = L.keep(base, node.labels) if node.on else L.remove(base, node.labels)
        else:
            labels = base
            for name in node.include:
                labels = L.put(labels, name, F.element_at(F.col("o.labels"), F.lit(name)))
        keeps = compare and not node.bool_ and not (node.on and node.group is None and "__name__" not in node.labels)
        name = F.col("m_name") if keeps else F.lit(None).cast("string")
        if compare and not node.bool_:
            joined, value = joined.where(out), F.col("lhs")
        else:
            value = F.when(out, 1.0).otherwise(0.0) if compare else out
        df = joined.select("step", labels.alias("labels"), name.alias("name"), value.alias("value"))
        df = df.withColumn("key", L.series_key(F.col("labels")))
        return Vector(self._checked(df).select("step", "labels", "name", "key", "value"))


@F.pandas_udf(DoubleType())
def _series_share(name: pd.Series, key: pd.Series) -> pd.Series:
    """Place of a series in [0, 1]: xxh64 of its sorted labels, each name and value ended by
    a byte 255; a series keeps it at all steps."""
    seen: dict[tuple, float] = {}

    def share(n: str | None, k: str) -> float:
        if (n, k) not in seen:
            labels = json.loads(k) | ({"__name__": n} if n else {})
            text = b"".join(x.encode() + b"\xff" for kv in sorted(labels.items()) for x in kv)
            seen[n, k] = xxhash.xxh64_intdigest(text) / float(2**64 - 1)
        return seen[n, k]

    return pd.Series([share(n, k) for n, k in zip(name, key)], dtype="float64")


def _order(rows: DataFrame) -> list[str]:
    """Columns that order a series' samples."""
    return ["ts", "seq"] if "seq" in rows.columns else ["ts"]


def _time(rows: DataFrame) -> Column:
    order = _order(rows)
    return F.struct(*order) if len(order) > 1 else F.col("ts")


def _samples(rows: DataFrame) -> Column:
    """Aggregate of a series' (ts, value) in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*_order(rows), "value")))
    return F.transform(ordered, lambda x: F.struct(x["ts"].alias("ts"), x["value"].alias("value"))) if "seq" in rows.columns else ordered


def _matches_empty(matcher: tuple[str, str, str]) -> bool:
    import re

    _, op, value = matcher
    hit = value == "" if op in ("=", "!=") else re.fullmatch(value, "") is not None
    return hit if op in ("=", "=~") else not hit


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def _natural(text: Column) -> Column:
    """Sort key in which digit runs compare by value: zero-padded to one width."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 32, "0")).otherwise(p)), "")


def _bucket_quantile(q: Column) -> Column:
    b = F.col("b")
    total = F.element_at(b, -1)["n"]
    rank = q * total
    at = F.aggregate(F.sequence(F.size(b) - 1, F.lit(0)), F.size(b) - 1, lambda s, i: F.when(F.get(b, i)["n"] >= rank, i).otherwise(s))
    found = F.get(b, at)
    low = F.when(at == 0, F.lit(0.0)).otherwise(F.get(b, at - 1)["le"])
    under = F.when(at == 0, F.lit(0.0)).otherwise(F.get(b, at - 1)["n"])
    inside = low + (found["le"] - low) * N.div(rank - under, found["n"] - under)
    value = F.when(at == F.size(b) - 1, F.get(b, F.size(b) - 2)["le"]).when((at == 0) & (found["le"] <= 0), found["le"]).otherwise(inside)
    broken = (F.size(b) < 2) | (F.element_at(b, -1)["le"] != N.INF) | (total == 0) | F.isnan(q)
    return F.when(broken, N.const(N.NAN)).when(q < 0, N.const(-N.INF)).when(q > 1, N.const(N.INF)).otherwise(value)


def _bucket_fraction(low: Column, high: Column) -> Column:
    b = F.col("b")
    total = F.element_at(b, -1)["n"]

    def rank(x: Column) -> Column:
        """Observations up to x: whole buckets below it and a linear share of its own."""
        start = F.struct(F.lit(0.0).alias("n"), F.when(F.get(b, F.lit(0))["le"] > 0, F.lit(0.0)).otherwise(N.const(-N.INF)).alias("le"), F.lit(0.0).alias("r"))

        def step(s: Column, e: Column) -> Column:
            share = F.when((s["le"] == -N.INF) | (e["le"] == N.INF), F.lit(0.0)).otherwise(N.div(x - s["le"], e["le"] - s["le"]))
            r = F.when(x >= e["le"], e["n"]).when(x > s["le"], s["n"] + (e["n"] - s["n"]) * share).otherwise(s["r"])
            return F.struct(e["n"].alias("n"), e["le"].alias("le"), F.greatest(r, s["r"]).alias("r"))

        return F.aggregate(b, start, step)["r"]

    value = N.div(rank(high) - rank(low), total)
    broken = (F.size(b) < 2) | (F.element_at(b, -1)["le"] != N.INF) | (total == 0) | F.isnan(low) | F.isnan(high)
    return F.when(broken, N.const(N.NAN)).when(low >= high, F.lit(0.0)).otherwise(value)
