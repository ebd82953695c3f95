"""TraceQL compiled to DataFrames.

Spans and their attributes (one row per attribute) stay apart.  What a query reads of
the attributes is pivoted in one aggregate and joined once; trace-level fields come from
one aggregate per trace.  Span sets are (trace_id, span_id) tables; structural operators
are semi and anti joins of them, transitive ones a walk down and up each trace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numeric as N
from . import traceql_parser as T
from .promql import PlanError

_ID = ["trace_id", "span_id"]
_ROOTLESS = ("", "0" * 16)
#: Intrinsics that are columns of a span.
_STORED = {"name", "duration", "status", "kind", "statusMessage", "span:id", "span:parentID", "trace:id", "instrumentation:name", "instrumentation:version"}


def _traces(rows: DataFrame, use, schema: str) -> DataFrame:
    """``use(trace_id, rows)`` for each trace of ``rows`` (trace_id first), whose rows are
    brought together by one shuffle and read in order; a task holds one trace at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema(from_ddl(schema))
        at, held, out = None, [], []

        def full() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields) if out else None
            out.clear()
            return found

        for batch in batches:
            for trace, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if trace != at:
                    if held:
                        out += use(at, held)
                    at, held = trace, []
                held.append(row)
            if len(out) > 50_000:
                yield full()
        if held:
            out += use(at, held)
        if out:
            yield full()

    return rows.repartition("trace_id").sortWithinPartitions(*names).mapInArrow(run, schema)


def from_ddl(schema: str) -> list[pa.Field]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return [pa.field(n, kinds[t]) for n, t in (x.split() for x in schema.split(","))]


def _forest(rows: list[tuple[str, str | None]]) -> tuple[list[str], dict[str, list[str]]]:
    """Roots and children of (span, parent) rows in order.  Orphans are roots; so is the first
    member of a cycle, which nothing else reaches."""
    ids = {span for span, _ in rows}
    children: dict[str, list[str]] = {}
    roots = []
    for span, parent in rows:
        if parent in ids and parent != span:
            children.setdefault(parent, []).append(span)
        else:
            roots.append(span)
    seen = set()

    def reach(root: str) -> None:
        stack = [root]
        while stack:
            span = stack.pop()
            if span not in seen:
                seen.add(span)
                stack += children.get(span, ())

    for root in roots:
        reach(root)
    for span, _ in rows:
        if span not in seen:
            roots.append(span)
            reach(span)
    return roots, children


def nested_sets(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, ns_left, ns_right, ns_parent: Euler tour per trace in (ts, span id)
    order; a root's parent is -1, orphans and members of cycles become roots."""

    def number(trace: str, rows: list) -> list[tuple]:
        first = {}
        for _, span, parent in rows:
            first.setdefault(span, parent)
        roots, children = _forest(list(first.items()))
        out: dict[str, list] = {}
        counter = 1
        for root in roots:
            out[root] = [counter, 0, -1]
            counter += 1
            stack = [(root, iter(children.get(root, ())))]
            while stack:
                span, rest = stack[-1]
                child = next(rest, None)
                if child is None:
                    out[span][1] = counter
                    counter += 1
                    stack.pop()
                elif child not in out:
                    out[child] = [counter, 0, out[span][0]]
                    counter += 1
                    stack.append((child, iter(children.get(child, ()))))
        return [(trace, span, *x) for span, x in out.items()]

    return _traces(spans.select("trace_id", "ts_ns", "span_id", "parent_id"), number, "trace_id string, span_id string, ns_left long, ns_right long, ns_parent long")


def _descent(spans: DataFrame, above: DataFrame, below: DataFrame) -> DataFrame:
    """trace_id, span_id, is_above, is_below: members of ``above`` with a descendant in
    ``below`` and the reverse, by one walk down and one up each trace that has both."""
    parts = [df.select("trace_id", "ts_ns", "span_id", "parent_id", F.lit(tag).alias("tag")) for df, tag in ((spans, "s"), (above, "a"), (below, "b"))]

    def walk(trace: str, rows: list) -> list[tuple]:
        top, low = {r[1] for r in rows if r[3] == "a"}, {r[1] for r in rows if r[3] == "b"}
        if not top or not low:
            return []
        first = {}
        for _, span, parent, _ in rows:
            first.setdefault(span, parent)
        roots, children = _forest(list(first.items()))
        under, order, seen = {}, [], set()
        stack = [(root, None) for root in roots]
        while stack:
            span, parent = stack.pop()
            if span in seen:
                continue
            seen.add(span)
            order.append((span, parent))
            under[span] = parent is not None and (under[parent] or parent in top)
            stack += [(child, span) for child in children.get(span, ())]
        over = dict.fromkeys(seen, False)
        for span, parent in reversed(order):
            if parent is not None and (over[span] or span in low):
                over[parent] = True
        hits = [(span, span in top and over[span], span in low and under[span]) for span, _ in order]
        return [(trace, *h) for h in hits if h[1] or h[2]]

    return _traces(reduce(DataFrame.unionByName, parts), walk, "trace_id string, span_id string, is_above boolean, is_below boolean")


def _unique(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per span, after one shuffle by ``by``.  dropDuplicates would keep texts in its
    buffers, which sorts all rows before and after the shuffle; here they are sorted once, by a
    hash of the ids that settles all but a few comparisons."""
    each = Window.partitionBy("_h", *_ID).orderBy("_h")
    dealt = spans.repartition(*(by or _ID)).withColumn("_h", F.xxhash64(*_ID))
    return dealt.withColumn("_n", F.row_number().over(each)).where("_n = 1").drop("_h", "_n")


def trace_context(spans: DataFrame) -> DataFrame:
    """trace_id, root name and service, start, duration over all of a trace's spans."""
    order = F.struct(F.coalesce(~F.col("parent_id").isin(*_ROOTLESS), F.lit(False)).alias("o"), "ts_ns", "span_id")
    return spans.groupBy("trace_id").agg(
        F.min_by("name", order).alias("root_name"), F.min_by("service", order).alias("root_service"),
        F.min("ts_ns").alias("trace_start"), (F.max(F.col("ts_ns") + F.col("duration_ns")) - F.min("ts_ns")).alias("trace_duration"),
    )


@dataclass
class TraceEngine:
    """``spans``: trace_id, span_id, parent_id, name, service, ts_ns, duration_ns, status, kind,
    status_message, scope_name, scope_version.  ``attrs``: trace_id, span_id, scope, key, val,
    val_num.  ``many`` (optional): event and link values, same columns as ``attrs``.

    ``columns``: where given, ``spans`` also has every attribute that ``attrs`` has, as a text
    and a number column by (scope, key); then no attribute row is read, shuffled or joined."""

    spark: SparkSession
    spans: DataFrame
    attrs: DataFrame
    columns: dict[tuple[str, str], tuple[str, str]] | None = None

    # -- fields --------------------------------------------------------------------------

    def _needed(self, x, found: set) -> set:
        if isinstance(x, T.Field):
            found.add(x)
        elif isinstance(x, (list, tuple)):
            for y in x:
                self._needed(y, found)
        elif hasattr(x, "__dataclass_fields__"):
            for name in x.__dataclass_fields__:
                self._needed(getattr(x, name), found)
        return found

    def _column(self, f: T.Field) -> str:
        return f"f_{f.kind[0]}_{f.scope}_{f.name}".replace(".", "_").replace(":", "_").replace("-", "_").replace("/", "_")

    def _required(self, x) -> list[Column]:
        """Conditions on single attribute rows that every match of ``x`` must have."""
        if isinstance(x, T.Op) and x.op == "&&":
            return self._required(x.left) + self._required(x.right)
        if not isinstance(x, T.Op) or x.op not in ("=", ">", "<", ">=", "<=", "=~"):
            return []
        left, right, op = x.left, x.right, x.op
        if isinstance(left, T.Literal) and isinstance(right, T.Field):
            left, right, op = right, left, {">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(op, op)
        if not (isinstance(left, T.Field) and self._by_attr(left) and isinstance(right, T.Literal)) or right.kind == "nil":
            return []
        scopes, key = self._key(left)
        test = self._test(F.col("val"), F.col("val_num"), op, right)
        return [F.coalesce((F.col("key") == key) & F.col("scope").isin(*scopes) & test, F.lit(False))]

    @staticmethod
    def _by_attr(f: T.Field) -> bool:
        return f.kind == "attribute" or f.name.startswith(("event:", "link:"))

    def _in_row(self, fields) -> bool:
        """Whether a span's own row has all ``fields``."""
        return all(self.columns is not None if self._by_attr(f) else f.kind == "intrinsic" and f.name in _STORED for f in fields)

    def _beside_span(self, f: T.Field) -> list[Column]:
        """The columns that ``frame`` adds for an attribute out of ``columns``."""
        scopes, key = self._key(f)
        kept = sorted((scope != "span", *names) for (scope, k), names in self.columns.items() if k == key and scope in scopes)
        value = lambda text, number: F.when(F.col(text).isNotNull(), F.struct(F.col(text).alias("val"), F.col(number).alias("val_num")))
        none = F.lit(None).cast("struct<val: string, val_num: double>")
        own, rest = ([value(*names) for later, *names in kept if later is which] for which in (False, True))
        best = F.coalesce(*own, *([rest[0]] if len(rest) == 1 else [F.least(*rest)] if rest else []), none)
        name = self._column(f)
        found = [best.alias(name)]
        if self._many(f):
            found.append(F.array_distinct(F.array_compact(F.array(*own, *rest, none))).alias(name + "_all"))
        return found

    def frame(self, fields: set, spans: DataFrame | None = None, where=None) -> DataFrame:
        """Spans with a column per needed field: structs (text, number, values).  With ``where``,
        only spans that may satisfy it: attribute rows that its conditions ask for name the
        candidates, and only their attributes are gathered."""
        df = self.spans if spans is None else spans
        everything = self.spans
        by_attr = [f for f in fields if self._by_attr(f)]
        if by_attr and self.columns is not None:
            df = df.select("*", *[c for f in by_attr for c in self._beside_span(f)])
        elif by_attr:
            keys = {self._key(f)[1] for f in by_attr}
            hit = self.attrs.where(F.col("key").isin(*keys))
            required = self._required(where)
            if required:
                if len(by_attr) == 1 and len(required) == 1 and by_attr[0].scope in ("span", "resource", "instrumentation"):
                    hit = hit.where(required[0])  # a scope has one value, so its row is the answer
                else:
                    marks = [F.max(test).alias(f"r{i}") for i, test in enumerate(required)]
                    asked = hit.where(reduce(Column.__or__, required)).groupBy(*_ID).agg(*marks)
                    hit = hit.join(asked.where(" AND ".join(f"r{i}" for i in range(len(required)))).select(*_ID), _ID, "left_semi")
            picks = []
            for f in by_attr:
                scopes, key = self._key(f)
                mine = (F.col("key") == key) & F.col("scope").isin(*scopes)
                # a span's own value goes before its resource's
                rank = F.when(F.col("scope") == "span", 0).otherwise(1)
                best = F.min_by(F.when(mine, F.struct("val", "val_num")), F.when(mine, F.struct(rank.alias("r"), F.col("val").alias("v"))))
                picks.append(best.alias(self._column(f)))
                if self._many(f):
                    picks.append(F.collect_set(F.when(mine, F.struct("val", "val_num"))).alias(self._column(f) + "_all"))
            df = df.join(hit.groupBy(*_ID).agg(*picks), _ID, "inner" if required else "left")
        return self._with_context(df, fields, everything)

    @staticmethod
    def _many(f: T.Field) -> bool:
        return f.scope in ("event", "link") or f.name.startswith(("event:", "link:"))

    def _with_context(self, df: DataFrame, fields: set, everything: DataFrame) -> DataFrame:
        names = {f.name for f in fields if f.kind == "intrinsic"}
        if names & {"traceDuration", "rootName", "rootServiceName"}:
            df = df.join(trace_context(everything), "trace_id", "left")
        if "childCount" in names:
            children = everything.groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.countDistinct(F.col("span_id")).alias("children"))
            df = df.join(children, _ID, "left")
        if any(n.startswith("nestedSet") for n in names):
            df = df.join(self._tours, _ID, "left")
        return df

    @cached_property
    def _tours(self) -> DataFrame:
        return nested_sets(self.spans)

    def _key(self, f: T.Field) -> tuple[list[str], str]:
        if f.kind == "intrinsic":
            scope, key = f.name.split(":")
            return [scope], f"{scope}:{key}"
        return ([f.scope] if f.scope else ["span", "resource", "instrumentation", "event", "link"]), f.name

    def _intrinsic(self, name: str) -> Column:
        direct = {
            "name": "name", "duration": "duration_ns", "status": "status", "kind": "kind", "statusMessage": "status_message",
            "span:id": "span_id", "span:parentID": "parent_id", "trace:id": "trace_id", "traceDuration": "trace_duration",
            "rootName": "root_name", "rootServiceName": "root_service", "instrumentation:name": "scope_name",
            "instrumentation:version": "scope_version", "nestedSetLeft": "ns_left", "nestedSetRight": "ns_right", "nestedSetParent": "ns_parent",
        }
        if name == "childCount":
            return F.coalesce(F.col("children"), F.lit(0))
        return F.col(direct[name])

    def text(self, x) -> Column:
        if isinstance(x, T.Literal):
            return F.lit(x.value if isinstance(x.value, str) else str(x.value).lower())
        if isinstance(x, T.Field) and (x.kind == "attribute" or x.name.startswith(("event:", "link:"))):
            return F.col(self._column(x))["val"]
        if isinstance(x, T.Field):
            return self._intrinsic(x.name).cast("string")
        return N.go_format(self.number(x))

    def number(self, x) -> Column:
        if isinstance(x, T.Literal):
            return N.const(x.value) if x.value is not None else F.lit(None).cast("double")
        if isinstance(x, T.Field) and (x.kind == "attribute" or x.name.startswith(("event:", "link:"))):
            return F.col(self._column(x))["val_num"]
        if isinstance(x, T.Field):
            return self._intrinsic(x.name).cast("double")
        if isinstance(x, T.Unary):
            return -self.number(x.expr)
        return N.ARITHMETIC[x.op](self.number(x.left), self.number(x.right))

    def boolean(self, x) -> Column:
        """Matches or not; absent operands and non-booleans do not match."""
        if x is None:
            return F.lit(True)
        if isinstance(x, T.Literal):
            return F.lit(x.value is True)
        if isinstance(x, T.Field):  # a bare attribute is true when its value is
            return F.coalesce(self.text(x) == "true", F.lit(False))
        if isinstance(x, T.Unary):
            inner = x.expr
            there = F.lit(True) if not isinstance(inner, T.Field) else F.coalesce(self.text(inner).isin("true", "false"), F.lit(False))
            return there & ~self.boolean(inner)
        if x.op in ("&&", "||"):
            a, b = self.boolean(x.left), self.boolean(x.right)
            return a & b if x.op == "&&" else a | b
        return self._comparison(x)

    def _comparison(self, x: T.Op) -> Column:
        left, right, op = x.left, x.right, x.op
        if isinstance(left, T.Literal) and isinstance(right, T.Field):
            flipped = {">": "<", "<": ">", ">=": "<=", "<=": ">="}
            left, right, op = right, left, flipped.get(op, op)
        if isinstance(right, T.Literal) and right.kind == "nil":
            there = self.text(left).isNotNull()
            return there if op == "!=" else ~there
        absent_counts = op in ("!=", "!~")
        many = isinstance(left, T.Field) and self._many(left)
        if many and isinstance(right, T.Literal):
            # any value may satisfy; a negation holds when none equals
            positive = {"!=": "=", "!~": "=~"}.get(op, op)
            hit = F.exists(F.coalesce(F.col(self._column(left) + "_all"), F.array()), lambda v: self._test(v["val"], v["val_num"], positive, right))
            return ~hit if absent_counts else hit
        if isinstance(right, T.Literal):
            hit = self._test(self.text(left) if not isinstance(left, (T.Op, T.Unary)) else None, self.number(left) if T.kind_of(left) != "text" else None, op, right)
            return F.coalesce(hit, F.lit(absent_counts))
        kinds = {T.kind_of(left), T.kind_of(right)}
        sign = "==" if op == "=" else op
        numeric = N.COMPARISON[sign](self.number(left), self.number(right)) if "text" not in kinds else F.lit(None).cast("boolean")
        if "number" in kinds or isinstance(left, (T.Op, T.Unary)) or isinstance(right, (T.Op, T.Unary)):
            return F.coalesce(numeric, F.lit(False))
        a, b = self.text(left), self.text(right)
        plain = {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        return F.coalesce(numeric, plain, F.lit(False))

    def _test(self, text: Column | None, number: Column | None, op: str, literal: T.Literal) -> Column:
        if literal.kind in ("text", "bool"):
            value = literal.value if literal.kind == "text" else str(literal.value).lower()
            if op in ("=~", "!~"):
                hit = text.rlike(L.anchored(value))
                return hit if op == "=~" else ~hit
            return {"=": text == value, "!=": text != value, ">": text > value, "<": text < value, ">=": text >= value, "<=": text <= value}[op]
        return N.COMPARISON["==" if op == "=" else op](number, N.const(literal.value))

    # -- spansets --------------------------------------------------------------------------

    def spanset(self, node, spans: DataFrame | None = None, more: dict | None = None, by: list[str] | None = None) -> DataFrame:
        """trace_id, span_id, parent_id, ts_ns of the matched spans; of a filter also ``more``
        (a field expression and its column by name), dealt by the columns ``by``."""
        cols = [*_ID, "parent_id", "ts_ns"]
        if isinstance(node, T.Query):
            return self.groups(node).select(*cols).distinct()
        if isinstance(node, T.Spanset):
            more = more or {}
            fields = self._needed([node.expr, *[x for x, _ in more.values()]], set())
            found = self.frame(fields, spans, node.expr).where(self.boolean(node.expr))
            return _unique(found.select(*cols, *[c.alias(name) for name, (_, c) in more.items()]), by)
        a, b = self.spanset(node.left, spans), self.spanset(node.right, spans)
        if isinstance(node, T.Combine):
            if node.op == "&&":
                both = a.select("trace_id").distinct().join(b.select("trace_id").distinct(), "trace_id")
                a, b = a.join(both, "trace_id", "left_semi"), b.join(both, "trace_id", "left_semi")
            return _unique(a.unionByName(b))
        if node.op in (">>", "<<"):
            above, below = (a, b) if node.op == ">>" else (b, a)
            met = _descent(self.spans, above, below)
            mine, theirs = ("is_below", "is_above") if node.op == ">>" else ("is_above", "is_below")
            take = lambda df, flag, how="left_semi": df.join(met.where(flag).select(*_ID), _ID, how)
            right, left = lambda how="left_semi": take(b, mine, how), lambda: take(a, theirs)
        else:
            right, left = lambda how="left_semi": self._beside(node.op, b, a, how), lambda: self._beside({">": "<", "<": ">"}.get(node.op, node.op), a, b, "left_semi")
        if node.mode == "plain":
            return right()
        if node.mode == "not":
            return right("left_anti")
        return _unique(left().unionByName(right()))

    @staticmethod
    def _beside(op: str, mine: DataFrame, other: DataFrame, how: str) -> DataFrame:
        """Spans of ``mine`` that are children (>), parents (<) or siblings (~) of one in ``other``."""
        o = other.select(*[F.col(c).alias(f"o_{c}") for c in ("trace_id", "span_id", "parent_id")])
        on = {
            ">": F.col("parent_id") == F.col("o_span_id"), "<": F.col("o_parent_id") == F.col("span_id"),
            "~": (F.col("parent_id") == F.col("o_parent_id")) & ~F.col("parent_id").isin(*_ROOTLESS),
        }[op]
        return mine.join(o, (F.col("trace_id") == F.col("o_trace_id")) & on & (F.col("span_id") != F.col("o_span_id")), how)

    # -- pipeline ----------------------------------------------------------------------------

    def groups(self, query: T.Query) -> DataFrame:
        """Matched spans with ``group`` ('' unless by() splits a trace) after all stages."""
        read = {i: (s.args[0], (self.text if s.kind == "by" else self.number)(s.args[0])) for i, s in enumerate(query.stages) if s.args and s.kind in ("by", "aggregate")}
        own = isinstance(query.root, T.Spanset)  # then what the stages read comes with the spans
        if own:
            by = ["trace_id"] if any(s.kind == "aggregate" for s in query.stages) else None
            found = self.spanset(query.root, more={f"_x{i}": x for i, x in read.items()}, by=by)
        else:
            found = self.spanset(query.root)
        found = found.withColumn("group", F.lit(""))
        for i, stage in enumerate(query.stages):
            if i in read and not own:
                field, value = read[i]
                keyed = _unique(self.frame(self._needed(field, set())).select(*_ID, value.alias(f"_x{i}")))
                found = found.join(keyed, _ID)
            if stage.kind == "filter":
                found = found.join(self.spanset(stage.value).select(*_ID), _ID, "left_semi")
            elif stage.kind == "by":
                found = found.withColumn("group", F.coalesce(f"_x{i}", F.lit("nil")))
            elif stage.kind == "coalesce":
                found = found.withColumn("group", F.lit(""))  # a span is in one group, so none repeats
            elif stage.kind == "aggregate":
                value = F.count(F.lit(1))
                if stage.args:
                    v = F.col(f"_x{i}")
                    value = {"avg": F.avg(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v)}[stage.name]
                found = found.withColumn("_agg", value.over(Window.partitionBy("trace_id", "group")).cast("double"))
                found = found.where(F.coalesce(N.COMPARISON["==" if stage.op == "=" else stage.op](F.col("_agg"), self.number(stage.value)), F.lit(False))).drop("_agg")
            elif stage.kind != "select":
                raise PlanError(f"{stage.kind} is no search stage")
        return found.drop(*[f"_x{i}" for i in read])

    def search(self, text: str, start: int | None = None, end: int | None = None, limit: int = 20, spans_per_set: int = 3) -> DataFrame:
        """The newest matching traces: trace summary and up to ``spans_per_set`` spans per group,
        with the fields of select()."""
        query = T.parse(text)
        inside = None if start is None else (F.col("ts_ns") > start) & (F.col("ts_ns") <= end)
        found = self._found(query, inside)
        newest = found.groupBy("trace_id").agg(F.max("ts_ns").alias("last"), F.countDistinct(F.col("span_id")).alias("matched"))
        top = F.broadcast(newest.orderBy(F.col("last").desc(), "trace_id").limit(limit))  # at most ``limit`` traces
        # matches stay within their trace, so the rest needs those traces only
        few = TraceEngine(self.spark, self.spans.join(top, "trace_id", "left_semi"), self.attrs.join(top, "trace_id", "left_semi"), self.columns)
        rank = F.row_number().over(Window.partitionBy("trace_id", "group").orderBy("ts_ns", "span_id"))
        shown = few._found(query, inside).join(top, "trace_id").withColumn("rank", rank).where(F.col("rank") <= spans_per_set)
        out = shown.join(trace_context(few.spans), "trace_id").drop("rank")
        fields = [a for s in query.stages if s.kind == "select" for a in s.args]
        if fields:
            extra = few.frame(self._needed(fields, set())).select(*_ID, *[self.text(f).alias(f"{f.scope + '.' if f.scope else ''}{f.name}") for f in fields])
            out = out.join(_unique(extra), _ID, "left")
        return out

    def _found(self, query: T.Query, inside: Column | None) -> DataFrame:
        """Groups of the spans ``inside`` a window; a filter alone reads only those."""
        if inside is None:
            return self.groups(query)
        if isinstance(query.root, T.Spanset) and all(s.kind == "select" for s in query.stages):
            return self.spanset(query.root, self.spans.where(inside)).withColumn("group", F.lit(""))
        return self.groups(query).where(inside)

    def trace(self, trace_id: str) -> DataFrame:
        """All stored spans of a trace; replays of a (span, kind) collapse."""
        return self.spans.where(F.col("trace_id") == trace_id).dropDuplicates(["span_id", "kind"])

    # -- metrics -------------------------------------------------------------------------------

    def series_probe(self, text: str, start: int, end: int, step: int, cap: int) -> DataFrame:
        """series (at most cap + 1) of a metrics query and whether they are ``over`` the cap."""
        few = self.metrics(text, start, end, step).select(L.series_key(F.col("labels")).alias("key")).distinct().limit(cap + 1)
        return few.agg(F.count(F.lit(1)).alias("series")).withColumn("over", F.col("series") > cap)

    def metrics(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """Rows step (ns), labels (map), value.  Buckets are aligned to the epoch, [t, t + step);
        the window is snapped outward to them."""
        query = T.parse(text)
        at = next((i for i, s in enumerate(query.stages) if s.kind in ("metric", "compare")), None)
        if at is None:
            raise PlanError("not a metrics query")
        low, high = start - start % step, end + (-end) % step
        search = T.Query(query.root, query.stages[:at])
        stage = query.stages[at]
        inside = self.spans.where((F.col("ts_ns") >= low) & (F.col("ts_ns") < high))
        own = [*self._needed([query.root.expr], set())] if isinstance(query.root, T.Spanset) else []
        if own and not query.stages[:at] and self._in_row(own):
            inside = self.frame({*own}, inside).where(self.boolean(query.root.expr)).select(*self.spans.columns)  # replays of a span agree
        inside = _unique(inside)
        if isinstance(query.root, T.Spanset) and not query.stages[:at]:
            fields = self._needed([query.root.expr, stage.by, stage.args, self._inline_side(stage)], set())
            rows = self.frame(fields, inside, query.root.expr).where(self.boolean(query.root.expr))
        else:
            rows = self.frame(self._needed([stage.by, stage.args, self._inline_side(stage)], set()), inside).join(self.groups(search).select(*_ID).distinct(), _ID, "left_semi")
        rows = rows.withColumn("step", F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(step)))
        if stage.kind == "compare":
            return self._compare(stage, rows)
        keys = [F.coalesce(self.text(b), F.lit("nil")).alias(f"k{i}") for i, b in enumerate(stage.by)]
        names = [f"{b.scope + '.' if b.scope else ''}{b.name}" for b in stage.by]
        seconds = step / 1e9
        fn = stage.name
        if stage.args:
            target = stage.args[0]
            scale = 1e9 if isinstance(target, T.Field) and target.name in ("duration", "traceDuration") else 1.0
            rows = rows.withColumn("v", self.number(target)).where(F.col("v").isNotNull())
        by = ["step", *[f"k{i}" for i in range(len(keys))]]
        base = rows.select("step", *keys, *(["v"] if stage.args else []))
        labels = [x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"k{i}"))]
        one = lambda df: df.select("step", (F.create_map(*labels) if labels else L.no_labels()).alias("labels"), "value")
        if fn in ("rate", "count_over_time"):
            n = F.count(F.lit(1)).cast("double")
            out = one(base.groupBy(*by).agg((n / seconds if fn == "rate" else n).alias("value")))
        elif fn in ("sum_over_time", "min_over_time", "max_over_time", "avg_over_time"):
            f = {"s": F.sum, "m": F.min if fn[1] == "i" else F.max, "a": F.avg}[fn[0]]
            out = one(base.groupBy(*by).agg((f("v") / scale).alias("value")))
        elif fn == "quantile_over_time":
            qs = [a.value for a in stage.args[1:]]
            found = base.groupBy(*by).agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("qs"))
            each = found.select(*by, F.posexplode("qs").alias("i", "q"))
            p = F.element_at(F.array(*[F.lit(_short(q)) for q in qs]), F.col("i") + 1)
            out = each.select("step", F.create_map(*labels, F.lit("p"), p).alias("labels"), (F.col("q") / scale).alias("value"))
        else:
            v = F.col("v").cast("long")
            # the smallest power of two that is not below v
            bucket = F.expr("shiftleft(1L, CAST(length(bin(CAST(v AS BIGINT) - 1)) AS INT))")
            found = base.where(v >= 2).withColumn("b", bucket).groupBy(*by, "b").agg(F.count(F.lit(1)).cast("double").alias("value"))
            out = found.select("step", F.create_map(*labels, F.lit("__bucket"), N.go_format(F.col("b") / scale)).alias("labels"), "value")
        for later in query.stages[at + 1 :]:
            if later.kind == "threshold":
                op = "==" if later.op == "=" else later.op
                out = out.where(N.COMPARISON[op](F.col("value"), N.const(later.value)))
            else:
                out = out.withColumn("key", L.series_key(F.col("labels")))
                order = F.col("value").desc() if later.kind == "topk" else F.col("value").asc()
                rank = F.row_number().over(Window.partitionBy("step").orderBy(order, "key"))
                out = out.withColumn("rank", rank).where(F.col("rank") <= int(later.args[0].value)).drop("rank", "key")
        return out

    def exemplars(self, text: str, start: int, end: int, step: int, most: int = 1) -> DataFrame:
        """step, trace_id, ts_ns: the first ``most`` matched spans of each bucket."""
        query = T.parse(text)
        stages = [s for s in query.stages if s.kind not in ("metric", "topk", "bottomk", "threshold", "compare")]
        found = self.groups(T.Query(query.root, stages)).where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end))
        found = found.withColumn("step", F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(step)))
        rank = F.row_number().over(Window.partitionBy("step").orderBy("ts_ns", "trace_id", "span_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= most).select("step", "trace_id", "ts_ns")

    def _inline_side(self, stage: T.Stage):
        """The filter of compare(), if a span's own row decides it."""
        node = stage.value if stage.kind == "compare" else None
        return node.expr if isinstance(node, T.Spanset) and self._in_row(self._needed(node.expr, set())) else None

    def _compare(self, stage: T.Stage, rows: DataFrame) -> DataFrame:
        """Counts per (step, side, key, value); ``nil`` complements and totals."""
        if self._inline_side(stage) is not None:
            marked = rows.withColumn("sel", self.boolean(stage.value.expr))
        else:
            marked = rows.join(self.spanset(stage.value).select(*_ID).withColumn("sel", F.lit(True)), _ID, "left")
        marked = marked.withColumn("side", F.when(F.col("sel"), "selection").otherwise("baseline"))
        pairs = [(k, F.col(c)) for k, c in (("name", "name"), ("status", "status"), ("kind", "kind"), ("resource.service.name", "service"))]
        pairs += [(f"{scope}.{key}", F.col(text)) for (scope, key), (text, _) in (self.columns or {}).items()]
        # the pair without a key counts the spans themselves
        own = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("val")) for k, c in [*pairs, (None, F.lit(""))]])
        each = marked.select("step", "side", F.explode(own).alias("x")).select("step", "side", "x.*")
        if self.columns is None:
            from_attr = marked.select(*_ID, "step", "side").join(self.attrs, _ID)
            each = each.unionByName(from_attr.select("step", "side", F.concat("scope", F.lit("."), "key").alias("key"), "val"))
        every = each.where(F.col("val").isNotNull()).groupBy("step", "side", "key", "val").agg(F.count(F.lit(1)).alias("n"))
        # windows, not joins: every branch of a join would read and count all spans anew
        of_key = Window.partitionBy("step", "side", "key")
        total = F.max(F.when(F.col("key").isNull(), F.col("n"))).over(Window.partitionBy("step", "side"))
        ranked = every.withColumn("total", total).withColumn("seen", F.sum("n").over(of_key)).withColumn("rank", F.row_number().over(of_key.orderBy("val")))
        row = lambda side, val, n: F.struct(side.alias("side"), val.alias("val"), n.cast("long").alias("n"))
        side, left, first = F.col("side"), F.col("total") - F.col("seen"), F.col("rank") == 1
        shown = F.array_compact(F.array(
            row(side, F.col("val"), F.col("n")), F.when(first & (left > 0), row(side, F.lit("nil"), left)), F.when(first, row(F.concat(side, F.lit("_total")), F.lit(""), F.col("total")))
        ))
        out = ranked.where("key IS NOT NULL").select("step", "key", F.explode(shown).alias("x")).select("step", "key", "x.*")
        labels = F.create_map(F.lit("__meta_type"), F.col("side"), F.col("key"), F.col("val"))
        return out.select("step", labels.alias("labels"), "side", "key", "val", F.col("n").cast("double").alias("value"))


def _short(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def edges(spans: DataFrame) -> DataFrame:
    """Service-graph halves: side, trace_id, pair_id, conn_type, service, duration_ns, failed."""
    client = F.col("kind").isin(3, 4)
    return spans.where(F.col("kind").isin(2, 3, 4, 5)).select(
        F.when(client, "client").otherwise("server").alias("side"), "trace_id", "span_id", "ts_ns",
        F.when(client, F.col("span_id")).otherwise(F.col("parent_id")).alias("pair_id"),
        F.when(F.col("kind").isin(2, 3), "rpc").otherwise("messaging").alias("conn_type"),
        "service", "duration_ns", (F.col("status") == 2).alias("failed"),
    )


def service_graph(spans: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """client, server, conn_type, calls, failed, p50, p95, p99 (seconds), most calls first."""
    halves = edges(spans)
    if start is not None:
        halves = halves.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end))
    halves = halves.dropDuplicates(["side", "trace_id", "span_id"])
    c = halves.where("side = 'client'").groupBy("trace_id", "pair_id", "conn_type").agg(F.min("service").alias("client"), F.max("failed").alias("c_failed"))
    s = halves.where("side = 'server'").select("trace_id", "pair_id", "conn_type", F.col("service").alias("server"), "duration_ns", F.col("failed").alias("s_failed"))
    pairs = s.join(c, ["trace_id", "pair_id", "conn_type"])
    p = F.percentile("duration_ns", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = pairs.groupBy("client", "server", "conn_type").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("s_failed") | F.col("c_failed")).alias("failed"), p.alias("p")
    )
    return out.select("client", "server", "conn_type", "calls", "failed", *[(F.col("p")[i] / 1e9).alias(f"p{q}") for i, q in enumerate((50, 95, 99))]).orderBy(F.col("calls").desc(), "client", "server")


def legacy_tags(tags: str, min_duration: str = "", max_duration: str = "") -> str:
    """logfmt tags of the old search form as a TraceQL query."""
    import json

    from ..functions.logparse import logfmt

    parts = []
    for k, v in json.loads(logfmt(tags)).items():
        quoted = json.dumps(v)
        if k in ("service_name",):
            parts.append(f"resource.service.name = {quoted}")
        elif k in ("name", "status", "kind"):
            parts.append(f"{k} = {quoted if k == 'name' else v}")
        else:
            parts.append(f".{k} = {quoted}")
    if min_duration:
        parts.append(f"duration >= {min_duration}")
    if max_duration:
        parts.append(f"duration <= {max_duration}")
    return "{ " + " && ".join(parts) + " }" if parts else "{}"
