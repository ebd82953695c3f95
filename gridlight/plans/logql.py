"""LogQL compiled to DataFrames.

A log row carries line, labels (stream, metadata and extracted), the names it had
before extraction, and an error pair beside the labels.  Each stage rewrites these
columns; line filters stand before any Python stage, so they reach the scan.  Metric
queries share the windows, aggregations and matching of the PromQL compiler, on a grid
of nanoseconds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import logparse as LP
from ..functions import numeric as N
from ..functions.templates import Template, TemplateError, compile_columns
from ..operators import grid as G
from . import logql_parser as Q
from . import promql_parser as P
from .promql import Engine, PlanError, Scalar, Vector

_MAP = "map<string,string>"
#: Range aggregations that a roll-up answers: its column, and whether the result is per second.
_ROLLED = {"count_over_time": ("count", False), "rate": ("count", True), "bytes_over_time": ("bytes", False), "bytes_rate": ("bytes", True)}


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


@dataclass
class LogEngine:
    """``lines``: labels (map), key, ts (ns), line and, optionally, meta (map).

    ``series`` (key, labels, first, last): where given, matchers and activity bounds pick keys
    there and lines by key.  ``rollup`` (key, labels, ts, count, bytes): sums of the lines in
    (ts - width, ts]; counts and rates of whole streams read it where the grid allows."""

    spark: SparkSession
    lines: DataFrame
    series: DataFrame | None = None
    rollup: DataFrame | None = None
    width: int = 0

    # -- log queries -------------------------------------------------------------------

    def logs(self, text: str, start: int, end: int, limit: int | None = 100, direction: str = "backward") -> DataFrame:
        """Rows ts, labels, key, line of the window (start, end], newest first by default."""
        tree = Q.parse(text)
        if not isinstance(tree, Q.Query):
            raise PlanError("not a log query")
        rows = self.pipeline(tree, self._scan(tree, start, end))
        rows = rows.select("ts", _final(F.col("labels")).alias("labels"), "line").withColumn("key", L.series_key(F.col("labels")))
        order = [F.col("ts").desc() if direction == "backward" else F.col("ts").asc(), "key", "line"]
        return rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(limit)

    def page(self, text: str, start: int, end: int, limit: int, after: tuple[int, str, str] | None = None, direction: str = "backward") -> DataFrame:
        """The next rows after the last one (ts, key, line) of the page before; no row is read
        twice or lost between pages.  Rows equal in all three belong to one page."""
        rows = self.logs(text, start, end, None, direction)
        if after is not None:
            ts, key, line = after
            beyond = F.col("ts") < ts if direction == "backward" else F.col("ts") > ts
            rows = rows.where(beyond | (F.col("ts") == ts) & ((F.col("key") > key) | (F.col("key") == key) & (F.col("line") > line)))
        order = [F.col("ts").desc() if direction == "backward" else F.col("ts").asc(), "key", "line"]
        return rows.orderBy(*order).limit(limit)

    def streams(self, text: str, start: int, end: int, limit: int | None = 100, direction: str = "backward") -> DataFrame:
        """Log rows grouped by final label set: key, labels, entries (ts, line)."""
        rows = self.logs(text, start, end, limit, direction)
        entries = F.sort_array(F.collect_list(F.struct("ts", "line")), asc=direction != "backward")
        return rows.groupBy("key").agg(F.first("labels").alias("labels"), entries.alias("entries"))

    def _scan(self, query: Q.Query, start: int | None = None, end: int | None = None) -> DataFrame:
        df = self.lines
        if start is not None:
            df = df.where((F.col("ts") > start) & (F.col("ts") <= end))
        if self.series is None:
            df = _matched(df, query)
        else:
            known = self.series if start is None else self.series.where((F.col("last") > start) & (F.col("first") <= end))
            df = df.join(_matched(known, query).select("key"), "key", "left_semi")
        labels = F.col("labels")
        if "meta" in df.columns:
            meta = F.transform_keys(F.coalesce("meta", L.no_labels()), lambda k, v: F.when(F.map_contains_key(labels, k), F.concat(k, F.lit("_extracted"))).otherwise(k))
            merged = F.map_concat(labels, F.map_filter(meta, lambda k, v: ~F.map_contains_key(labels, k)))
        else:
            merged = labels
        return df.select("ts", "line", merged.alias("labels"), F.map_keys(merged).alias("own"), F.lit("").alias("err"), F.lit("").alias("errd"))

    def pipeline(self, query: Q.Query, df: DataFrame) -> DataFrame:
        for stage in query.stages:
            df = self._stage(stage, df)
        pair = {"__error__": F.col("err"), "__error_details__": F.col("errd")}
        labels = F.col("labels")
        for name, value in pair.items():
            labels = F.when(value != "", L.put(labels, name, value)).otherwise(labels)
        return df.withColumn("labels", labels)

    # -- stages --------------------------------------------------------------------------

    def _stage(self, stage, df: DataFrame) -> DataFrame:
        line = F.col("line")
        match stage:
            case Q.LineFilter(op, parts):
                def hit(kind: str, text: str) -> Column:
                    if kind == "ip":
                        return LP.ip_column(line, text)
                    if op in ("|=", "!="):
                        return line.contains(text)
                    if op in ("|>", "!>"):
                        return line.rlike(LP.pattern_regex(text)[0])
                    return line.rlike(L.java_regex(text))

                found = _or([hit(k, t) for k, t in parts])
                return df.where(found if op[0] == "|" else ~found)
            case Q.ParserStage():
                return self._parser(stage, df)
            case Q.LabelFilter() | Q.AndOr():
                passed, err = self._label_filter(stage)
                kept = df.withColumn("_p", passed).withColumn("_e", err).where(F.col("_p"))
                fresh = (F.col("err") == "") & F.col("_e")
                return kept.withColumn("errd", F.when(fresh, "could not convert the label's value").otherwise(F.col("errd"))).withColumn(
                    "err", F.when(fresh, "LabelFilterErr").otherwise(F.col("err"))
                ).drop("_p", "_e")
            case Q.LineFormat(template):
                return self._formatted(df, template, "line", None)
            case Q.LabelFormat(items):
                before = df.withColumn("_snap", F.col("labels"))
                for target, kind, source in items:
                    if kind == "label":
                        value = F.element_at(F.col("_snap"), F.lit(source))
                        moved = L.put(L.remove(F.col("labels"), [source]) if source != target else F.col("labels"), target, value)
                        before = before.withColumn("labels", F.when(F.map_contains_key(F.col("_snap"), F.lit(source)), moved).otherwise(F.col("labels")))
                    else:
                        before = self._formatted(before, source, "labels", target)
                return before.drop("_snap")
            case Q.Decolorize():
                return df.withColumn("line", F.regexp_replace("line", "\u001b\\[[0-9;]*m", ""))
            case Q.DropKeep(kind, items):
                return self._drop_keep(kind, items, df)
            case Q.Unwrap(label, convert):
                text = F.element_at(F.col("labels"), F.lit(label))
                value = {"": lambda t: t.try_cast("double"), "bytes": LP.byte_count}.get(convert, LP.duration_seconds)(text)
                bad = text.isNotNull() & value.isNull() & (F.col("err") == "")
                return (
                    df.where(text.isNotNull() | (F.col("err") != ""))
                    .withColumn("value", value)
                    .withColumn("errd", F.when(bad, F.concat(F.lit("cannot convert "), text)).otherwise(F.col("errd")))
                    .withColumn("err", F.when(bad, "SampleExtractionErr").otherwise(F.col("err")))
                    .withColumn("labels", L.remove(F.col("labels"), [label]))
                )
        raise PlanError(f"unknown stage {stage!r}")

    def _extracted(self, df: DataFrame, found: Column) -> DataFrame:
        """Merge new labels: a clash with the stream's or metadata's gets ``_extracted``; what
        was extracted before stays."""
        own, labels = F.col("own"), F.col("labels")
        df, found = df.withColumn("_found", found), F.col("_found")  # read twice, computed once
        renamed = F.transform_keys(found, lambda k, v: F.when(F.array_contains(own, k), F.concat(k, F.lit("_extracted"))).otherwise(k))
        fresh = F.map_filter(renamed, lambda k, v: ~F.map_contains_key(labels, k))
        return df.withColumn("labels", F.when(found.isNull(), labels).otherwise(F.map_concat(labels, fresh))).drop("_found")

    def _failed(self, df: DataFrame, bad: Column, name: str, details: str) -> DataFrame:
        fresh = bad & (F.col("err") == "")
        return df.withColumn("errd", F.when(fresh, details).otherwise(F.col("errd"))).withColumn("err", F.when(fresh, name).otherwise(F.col("err")))

    def _parser(self, stage: Q.ParserStage, df: DataFrame) -> DataFrame:
        line = F.col("line")
        if stage.kind == "json" and not stage.params:
            df = df.withColumn("_flat", LP.flatten_column(line))
            df = self._failed(df, F.col("_flat").isNull(), "JSONParserErr", "Value looks like object, but can't find closing '}' symbol")
            return self._extracted(df, F.from_json("_flat", _MAP)).drop("_flat")
        if stage.kind == "json":
            ok = F.try_parse_json(line).isNotNull()
            items = []
            for name, path in stage.params:
                dotted = "$" + "".join(f"[{p[1:-1]}]" if p.startswith("[") and p[1:-1].isdigit() else f"['{p.strip(chr(34) + '[]')}']" for p in _path(path))
                items += [F.lit(name), F.coalesce(F.get_json_object(line, dotted), F.lit(""))]
            df = self._failed(df, ~ok, "JSONParserErr", "the line is no JSON")
            return self._extracted(df, F.when(ok, F.create_map(*items)))
        if stage.kind == "logfmt":
            df = df.withColumn("_flat", LP.logfmt_column(line, "--strict" in stage.flags, "--keep-empty" in stage.flags))
            df = self._failed(df, F.col("_flat").isNull(), "LogfmtParserErr", "logfmt syntax error")
            found = F.from_json("_flat", _MAP)
            if stage.params:
                found = F.when(found.isNotNull(), F.create_map(*[x for name, key in stage.params for x in (F.lit(name), F.coalesce(F.element_at(found, F.lit(LP.sanitize(key))), F.lit("")))]))
            return self._extracted(df, found).drop("_flat")
        if stage.kind in ("regexp", "pattern"):
            import re

            if stage.kind == "regexp":
                regex = L.java_regex(stage.pattern)
                names = re.findall(r"\(\?<(\w+)>", regex)
                if not names:
                    raise PlanError("regexp needs a named capture")
                groups = [m.start() for m in re.finditer(r"(?<!\\)\((?!\?(?!<\w))", regex)]
                at = {n: groups.index(regex.index(f"(?<{n}>")) + 1 for n in names}
            else:
                regex, names = LP.pattern_regex(stage.pattern)
                at = {n: i + 1 for i, n in enumerate(names)}
            found = F.create_map(*[x for n in names for x in (F.lit(n), F.regexp_extract(line, regex, at[n]))]) if names else L.no_labels()
            return self._extracted(df, F.when(line.rlike(regex), found))
        if stage.kind == "unpack":
            df = df.withColumn("_packed", F.when(F.trim(line).startswith("{"), F.from_json(line, _MAP)))
            df = self._failed(df, F.col("_packed").isNull(), "JSONParserErr", "expecting json object")
            packed = F.col("_packed")
            df = self._extracted(df, F.map_filter(packed, lambda k, v: (k != "_entry") & v.isNotNull()))
            return df.withColumn("line", F.coalesce(F.element_at(packed, F.lit("_entry")), line)).drop("_packed")
        raise PlanError(f"unknown parser {stage.kind}")

    def _label(self, name: str) -> Column:
        if name == "__error__":
            return F.col("err")
        if name == "__error_details__":
            return F.col("errd")
        return L.get(F.col("labels"), name)

    def _label_filter(self, node) -> tuple[Column, Column]:
        """(row passes, an error arises); what short-circuits raises none."""
        if isinstance(node, Q.AndOr):
            lp, le = self._label_filter(node.left)
            rp, re_ = self._label_filter(node.right)
            runs = lp if node.op == "and" else ~lp
            return (lp & rp if node.op == "and" else lp | rp), le | (runs & re_)
        value = self._label(node.name)
        if node.kind == "text":
            return L.matches(value, "=" if node.op == "==" else node.op, node.value), F.lit(False)
        there = F.map_contains_key(F.col("labels"), F.lit(node.name))
        if node.kind == "ip":
            hit = LP.ip_column(value, node.value, whole=True)
            return there & (hit if node.op in ("=", "==") else ~hit), F.lit(False)
        number = {"number": lambda t: t.try_cast("double"), "duration": LP.duration_seconds, "bytes": LP.byte_count}[node.kind](value)
        hit = N.COMPARISON[node.op](number, N.const(node.value))
        return there & F.coalesce(hit, F.lit(True)), there & number.isNull()

    def _drop_keep(self, kind: str, items, df: DataFrame) -> DataFrame:
        def chosen(k: Column, v: Column) -> Column:
            return _or([(k == n) & (L.matches(v, op, x) if op else F.lit(True)) for n, op, x in items])

        out = df.withColumn("labels", F.map_filter("labels", lambda k, v: chosen(k, v) if kind == "keep" else ~chosen(k, v)))
        if kind == "drop":
            for n, op, x in items:
                if n in ("__error__", "__error_details__"):
                    for column in ("err", "errd") if n == "__error__" else ("errd",):
                        hit = L.matches(F.col("err" if n == "__error__" else "errd"), op, x) if op else F.lit(True)
                        out = out.withColumn(column, F.when(hit, "").otherwise(F.col(column)))
        return out

    def _formatted(self, df: DataFrame, template: str, column: str, target: str | None) -> DataFrame:
        labels = F.col("_snap") if target else F.col("labels")
        plain = compile_columns(template, labels, F.col("line"))
        if plain is not None:
            return df.withColumn("line", plain) if column == "line" else df.withColumn("labels", L.put(F.col("labels"), target, plain))
        Template(template)  # a bad template fails the plan

        @F.pandas_udf("struct<text: string, bad: string>")
        def run(labels_json: pd.Series, lines: pd.Series, ts: pd.Series) -> pd.DataFrame:
            own = Template(template)
            texts, bad = [], []
            for text, line, at in zip(labels_json, lines, ts):
                try:
                    texts.append(own.run(json.loads(text), line or "", int(at)))
                    bad.append(None)
                except TemplateError as e:
                    texts.append(None)
                    bad.append(str(e)[:200] or "error")
            return pd.DataFrame({"text": texts, "bad": bad}, dtype="object")

        df = df.withColumn("_t", run(F.to_json(labels), F.col("line"), F.col("ts")))
        df = self._failed(df, F.col("_t.bad").isNotNull(), "TemplateFormatErr", "template error")
        text = F.col("_t.text")
        new = F.coalesce(text, F.col("line")) if column == "line" else F.when(text.isNotNull(), L.put(F.col("labels"), target, text)).otherwise(F.col("labels"))
        return df.withColumn(column, new).drop("_t")

    # -- metric queries --------------------------------------------------------------------

    def metric(self, text: str, start: int, end: int | None = None, step: int = 60 * 10**9) -> DataFrame:
        """Rows step (ns), labels, key, value."""
        end = start if end is None else end
        tree = Q.parse(text)
        grid = G.Grid(start, end, step)
        inner = _MetricEngine(self.spark, self.lines, logs=self)
        found = inner.variants(tree, grid) if isinstance(tree, Q.Variants) else inner.compile(tree, grid, 0)
        if isinstance(found, Scalar):
            found = inner._as_vector(found, grid)
        out = found.df.select("step", "labels", "key", "value")
        return out.orderBy(*found.order, "key") if found.order and start == end else out


def _matched(df: DataFrame, query: Q.Query) -> DataFrame:
    for name, op, value in query.matchers:
        df = df.where(L.matches(L.get(F.col("labels"), name), op, value))
    return df


def _path(path: str) -> list[str]:
    import re

    return re.findall(r'\["[^"]*"\]|\[\d+\]|[^.\[\]]+', path)


def _final(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, v: v != "")


@dataclass
class _MetricEngine(Engine):
    logs: LogEngine | None = None
    ranges: dict[tuple[str, G.Grid], Vector] = field(default_factory=dict)

    def compile(self, node, grid: G.Grid, depth: int):
        if isinstance(node, Q.Range):
            # equal ranges are one frame, so that Spark reads and parses their lines once
            same = (repr(node), grid)
            if same not in self.ranges:
                self.ranges[same] = self._range_aggregate(node, grid, None)
            return replace(self.ranges[same])
        if isinstance(node, P.Aggregate) and node.op == "approx_topk":
            if grid.count != 1:
                raise PlanError("approx_topk is for instant queries")
            # exact here: a top-k needs no sketch when rows can be spilled
            node = P.Aggregate("topk", node.expr, node.param, node.without, node.labels)
        if isinstance(node, P.Binary) and node.op in P.COMPARISONS:
            left, right = node.left, node.right
            if isinstance(left, P.Number) and isinstance(right, P.Number):
                node.bool_ = True
        return super().compile(node, grid, depth)

    def variants(self, node: Q.Variants, grid: G.Grid) -> Vector:
        """All variants over one scan of the common pipeline."""
        base = self.logs._scan(node.query, grid.start - node.range_ns, grid.last)
        for stage in node.query.stages:
            base = self.logs._stage(stage, base)
        parts = []
        for i, part in enumerate(node.parts):
            if not isinstance(part, Q.Range):
                raise PlanError("a variant is a range aggregation")
            part.range_ns = node.range_ns
            v = self._range_aggregate(part, grid, base).df
            labels = L.put(F.col("labels"), "__variant__", F.lit(str(i)))
            parts.append(v.withColumn("labels", labels).withColumn("key", L.series_key(F.col("labels"))))
        return Vector(reduce(DataFrame.unionByName, parts))

    def _rolled(self, node: Q.Range, grid: G.Grid) -> bool:
        if self.logs.rollup is None or node.query.stages or node.labels is not None or node.op not in _ROLLED:
            return False
        return not any(x % self.logs.width for x in (grid.start, grid.step, node.range_ns, node.offset_ns))

    def _from_rollup(self, node: Q.Range, grid: G.Grid) -> Vector:
        column, per_second = _ROLLED[node.op]
        rows = _matched(self.logs.rollup, node.query).select("key", "ts", F.col(column).alias("s"))
        dealt = G.bucketed(rows, "ts", grid, node.range_ns, node.offset_ns)
        if dealt is None:
            one = G.window(rows, "ts", grid, node.range_ns, node.offset_ns)
        else:
            one = G.spread(dealt.groupBy("key", "bucket").agg(F.sum("s").alias("s")), grid, node.range_ns)
        total = F.sum("s").cast("double")
        value = total / F.lit(node.range_ns / 1e9) if per_second else total
        out = one.groupBy("key", "step").agg(value.alias("value"))
        return _vector(out.select("step", L.of_key(F.col("key")).alias("labels"), "key", "value"))

    def _range_aggregate(self, node: Q.Range, grid: G.Grid, base: DataFrame | None) -> Vector:
        span, offset = node.range_ns, node.offset_ns
        if base is None and self._rolled(node, grid):
            return self._from_rollup(node, grid)
        if base is None:
            base = self.logs._scan(node.query, grid.start - offset - span, grid.last - offset)
        rows = self.logs.pipeline(node.query, base)
        unwrapped = "value" in rows.columns
        failed = F.raise_error(F.concat(F.lit("pipeline error: "), F.col("err")))
        value = F.col("value") if unwrapped else F.octet_length("line").cast("double")
        labels = _final(F.col("labels"))
        if node.labels is not None:
            labels = L.remove(labels, node.labels) if node.without else L.keep(labels, node.labels)
        rows = rows.select(
            "ts", labels.alias("labels"), F.when(F.col("err") != "", failed).otherwise(value).alias("value"),
            F.xxhash64("line").alias("h"),
        ).withColumn("key", L.series_key(F.col("labels")))
        op = node.op
        seconds = span // 10**9 + span % 10**9 / 1e9
        v = F.col("value")
        if op == "absent_over_time":
            present = G.window(rows, "ts", grid, span, offset).select("step").distinct()
            missing = grid.frame(self.spark).join(present, "step", "left_anti")
            names = [m[0] for m in node.query.matchers]
            pairs = {n: x for n, o, x in node.query.matchers if o == "=" and names.count(n) == 1}
            lit = L.literal(pairs)
            return _vector(missing.select("step", lit.alias("labels"), L.series_key(lit).alias("key"), F.lit(1.0).alias("value")))
        partial, final = {
            "count_over_time": (F.count(v), F.sum("s").cast("double")),
            "rate": (F.sum(v) if unwrapped else F.count(v), F.sum("s") / F.lit(seconds)),
            "bytes_over_time": (F.sum(v), F.sum("s")), "bytes_rate": (F.sum(v), F.sum("s") / F.lit(seconds)),
            "sum_over_time": (N.sum_of(v), N.sum_of(F.col("s"))),
            "avg_over_time": (N.sum_of(v), N.sum_of(F.col("s")) / F.sum("n")),
            "min_over_time": (N.min_of(v), N.min_of(F.col("s"))), "max_over_time": (N.max_of(v), N.max_of(F.col("s"))),
            "first_over_time": (F.min(F.struct("ts", "h", "value")), F.min("s")["value"]),
            "last_over_time": (F.max(F.struct("ts", "h", "value")), F.max("s")["value"]),
        }.get(op, (None, None))
        named = L.of_key(F.col("key"))
        if partial is not None:
            dealt = G.bucketed(rows, "ts", grid, span, offset)
            if dealt is None:
                one = G.window(rows, "ts", grid, span, offset).groupBy("key", "step").agg(partial.alias("s"), F.count(v).alias("n"))
            else:
                one = G.spread(dealt.groupBy("key", "bucket").agg(partial.alias("s"), F.count(v).alias("n")), grid, span)
            out = one.groupBy("key", "step").agg(final.alias("value"))
        elif op in ("stddev_over_time", "stdvar_over_time"):
            f = F.stddev_pop if op[:6] == "stddev" else F.var_pop
            out = G.window(rows, "ts", grid, span, offset).groupBy("key", "step").agg(f(v).alias("value"))
        else:
            seen = G.window(rows, "ts", grid, span, offset)
            a = seen.groupBy("key", "step").agg(F.sort_array(F.collect_list(F.struct("ts", "h", "value"))).alias("a"))
            values = F.transform("a", lambda x: x["value"])
            if op == "quantile_over_time":
                out = a.withColumn("value", N.quantile(values, N.const(node.param)))
            else:  # rate_counter
                out = a.withColumn("value", _rate_counter(span, seconds))
        return _vector(out.select("step", named.alias("labels"), "key", "value"))


def _vector(df: DataFrame) -> Vector:
    return Vector(df.select("step", "labels", F.lit(None).cast("string").alias("name"), "key", "value"))


def _rate_counter(span: int, seconds: float) -> Column:
    """Counter increase per second; the window's start enters in the units that the
    query language's own implementation has (range in ms as seconds against ns / 1000)."""
    a, n = F.col("a"), F.size("a")
    first, last = F.get(a, F.lit(0)), F.element_at(a, -1)
    res = last["value"] - first["value"] + F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0),
        lambda s, i: s + F.when((n > 1) & (F.get(a, i)["value"] < F.get(a, i - 1)["value"]), F.get(a, i - 1)["value"]).otherwise(0.0),
    )
    to_start = F.lit(span / 1e6 / 1000)
    sampled = (last["ts"] - first["ts"]) / F.lit(1000.0)
    mean = sampled / (n - 1)
    zero = F.when((res > 0) & (first["value"] >= 0), sampled * N.div(first["value"], res)).otherwise(to_start)
    start = F.least(to_start, zero)
    limit = mean * 1.1
    extra = F.when(start < limit, start).otherwise(mean / 2)
    end = F.when(F.lit(0.0) < limit, F.lit(0.0)).otherwise(mean / 2)
    grown = res * N.div(sampled + extra + end, sampled)
    return F.when(n < 2, F.lit(0.0)).otherwise(grown / F.lit(seconds))
