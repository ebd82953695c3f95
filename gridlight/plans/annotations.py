"""Warnings beside a PromQL result.

What the query's text tells is found in its tree; malformed bucket bounds are read from the
buckets that a classic histogram function gets.  ``annotate`` returns rows level, message,
each once; nothing is computed until they are read.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import grid as G
from . import promql_parser as P

if TYPE_CHECKING:
    from .promql import Engine, Vector

# fixed values: message texts
BAD_QUANTILE = "PromQL warning: quantile value should be between 0 and 1, got {}"
BAD_RATIO = "PromQL warning: ratio value should be between -1 and 1, got {}, capping to {}"
IDLE_SORT = "PromQL warning: sort is ineffective for range queries since results are always ordered by labels"
BAD_BOUND = 'PromQL warning: bucket label "le" is missing or has a malformed value of '

_SORTS = {"sort", "sort_desc", "sort_by_label", "sort_by_label_desc"}
_SCHEMA = "level string, message string"


def children(node: Any) -> list:
    match node:
        case P.Call():
            return node.args
        case P.Aggregate():
            return [node.expr] if node.param is None else [node.param, node.expr]
        case P.Binary():
            return [node.left, node.right]
        case P.Negate() | P.Subquery():
            return [node.expr]
    return []


def constant(node: Any) -> float | None:
    """Value of a number, signed or not; other scalars are known at run time only."""
    if isinstance(node, P.Negate):
        value = constant(node.expr)
        return None if value is None else -value
    return node.value if isinstance(node, P.Number) else None


def shown(v: float) -> str:
    """Shortest text of a number; exponents below 1e-4 and from 1e21 on."""
    if math.isnan(v) or math.isinf(v):
        return "NaN" if math.isnan(v) else "+Inf" if v > 0 else "-Inf"
    if 1e16 <= abs(v) < 1e21:
        return str(int(v))
    return repr(float(v)).removesuffix(".0")


def quantiles(node: Any) -> list:
    """Parameters of ``node`` that must lie in [0, 1]."""
    match node:
        case P.Aggregate(op="quantile"):
            return [node.param]
        case P.Call(name="quantile_over_time" | "histogram_quantile"):
            return node.args[:1]
        case P.Call(name="histogram_quantiles"):
            return node.args[2:]
    return []


def of_text(tree: Any, is_range: bool) -> list[str]:
    """Messages that need no data, in the order of the text, each once."""
    found: dict[str, None] = {}

    def visit(node: Any) -> None:
        for q in map(constant, quantiles(node)):
            if q is not None and not 0 <= q <= 1:
                found[BAD_QUANTILE.format(shown(q))] = None
        if isinstance(node, P.Aggregate) and node.op == "limit_ratio":
            ratio = constant(node.param)
            if ratio is not None and abs(ratio) > 1:
                found[BAD_RATIO.format(shown(ratio), shown(math.copysign(1, ratio)))] = None
        if isinstance(node, P.Call) and node.name in _SORTS and is_range:
            found[IDLE_SORT] = None
        for child in children(node):
            visit(child)

    visit(tree)
    return list(found)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def bad_bounds(x: Vector) -> DataFrame:
    """Warnings of float series whose ``le`` is no number."""
    le = L.get(F.col("labels"), "le")
    number = F.regexp_replace(le, r"^[+-]?Inf$", "Infinity").try_cast("double")
    name = F.coalesce(F.col("name"), F.lit(""))
    wrong = x.df.where(number.isNull()).select(le.alias("le"), name.alias("name")).distinct()
    metric = F.when(F.col("name") != "", F.concat(F.lit(" for metric name "), _quoted(F.col("name")))).otherwise("")
    return wrong.select(F.lit("warning").alias("level"), F.concat(F.lit(BAD_BOUND), _quoted(F.col("le")), metric).alias("message"))


def annotate(engine: Engine, text: str, start: int, end: int | None = None, step: int = 60_000) -> DataFrame:
    """level and message of a query's warnings.  Buckets inside a subquery are judged at the
    steps of the outer query."""
    end = start if end is None else end
    tree = P.parse(text, {"start": start, "end": end, "step": step})
    grid = G.Grid(start, end, step)
    out = engine.spark.createDataFrame([("warning", m) for m in of_text(tree, start != end)], _SCHEMA)

    def visit(node: Any) -> None:
        nonlocal out
        if isinstance(node, P.Call) and node.name in ("histogram_quantile", "histogram_quantiles", "histogram_fraction"):
            buckets = node.args[0] if node.name == "histogram_quantiles" else node.args[-1]
            out = out.unionByName(bad_bounds(engine.compile(buckets, grid, 0)))
        for child in children(node):
            visit(child)

    visit(tree)
    return out.distinct()
