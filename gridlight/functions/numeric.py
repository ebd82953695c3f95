"""IEEE-754 arithmetic, comparisons and Go number formatting as Column expressions.

Spark's ANSI arithmetic raises on division by zero, sorts NaN above everything and
treats NaN as equal to itself; sample values need the IEEE rules instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def const(x: float) -> Column:
    return F.lit(float(x))


NAN, INF = float("nan"), float("inf")


def _negative_zero(x: Column) -> Column:
    return x.cast("string") == "-0.0"


def div(a: Column, b: Column) -> Column:
    by_zero = (
        F.when(F.isnan(a) | (a == 0), const(NAN))
        .when((a > 0) != _negative_zero(b), const(INF))
        .otherwise(const(-INF))
    )
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def mod(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), const(NAN)).otherwise(F.try_mod(a, b))


def whole_div(a: Column, b: int) -> Column:
    """Quotient of two integers without a detour over doubles (nanoseconds exceed them)."""
    return F.call_function("div", a, F.lit(b))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": div,
    "%": mod,
    "^": F.pow,
    "atan2": F.atan2,
}


def _numbers(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: (a == b) & _numbers(a, b),
    "!=": lambda a, b: ~((a == b) & _numbers(a, b)),
    ">": lambda a, b: (a > b) & _numbers(a, b),
    "<": lambda a, b: (a < b) & _numbers(a, b),
    ">=": lambda a, b: (a >= b) & _numbers(a, b),
    "<=": lambda a, b: (a <= b) & _numbers(a, b),
}


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (x < 0), const(NAN)).when(x == 0, const(-INF)).otherwise(f(x))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    # Spark's floor and ceil give BIGINT; doubles beyond 2**52 are whole already
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= float(1 << 52)), x).otherwise(f(x).cast("double"))


floor, ceil = _whole(F.floor), _whole(F.ceil)


def sgn(x: Column) -> Column:
    return F.when(F.isnan(x) | (x == 0), x).when(x > 0, const(1)).otherwise(const(-1))


ELEMENTWISE: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": ceil, "floor": floor, "sqrt": F.sqrt, "exp": F.exp,
    "ln": _log(F.ln), "log2": _log(F.log2), "log10": _log(F.log10), "sgn": sgn,
    "deg": lambda x: x * 180.0 / F.pi(), "rad": lambda x: x * F.pi() / 180.0,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
}


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), const(NAN)).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), const(NAN)).otherwise(F.greatest(a, b))


def round_to(x: Column, nearest: Column) -> Column:
    inverse = div(const(1), nearest)
    return div(floor(x * inverse + 0.5), inverse)


def min_of(x: Column) -> Column:
    """Aggregate minimum; NaN only when nothing else is there."""
    return F.when(F.count(F.when(~F.isnan(x), 1)) > 0, F.min(F.when(~F.isnan(x), x))).otherwise(F.min(x))


def max_of(x: Column) -> Column:
    return F.when(F.count(F.when(~F.isnan(x), 1)) > 0, F.max(F.when(~F.isnan(x), x))).otherwise(F.min(x))


def _halves(x: Column) -> tuple[Column, Column]:
    """Upper and lower 26 bits of a double's mantissa; their sums round much later than its own."""
    split = x * 134217729.0
    high = F.when(F.abs(x) < 1e290, split - (split - x)).otherwise(x)
    return high, F.when(F.abs(x) < 1e290, x - high).otherwise(F.lit(0.0))


def sum_of(x: Column) -> Column:
    """Aggregate sum, compensated: exact but for a last rounding over some 10^7 values of
    like size, in whatever order partial sums meet."""
    high, low = _halves(x)
    return F.sum(high) + F.sum(low)


def avg_of(x: Column) -> Column:
    return sum_of(x) / F.count(x)


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once a row, however often and wherever ``use`` reads it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def quantile(values: Column, q: Column) -> Column:
    """Linear interpolation over an array of doubles; NaN elements order first."""

    def ranked(ordered: Column) -> Column:
        rank = q * (F.size(ordered) - 1)
        low = F.floor(rank).cast("int")
        high = F.least(low + 1, F.size(ordered) - 1)
        weight = rank - low
        inside = F.get(ordered, low) * (1 - weight) + F.get(ordered, high) * weight
        # an infinite neighbour with no weight must not give NaN
        inside = F.when(weight == 0, F.get(ordered, low)).otherwise(inside)
        return (
            F.when(F.isnan(q) | (F.size(ordered) == 0), const(NAN))
            .when(q < 0, const(-INF)).when(q > 1, const(INF)).otherwise(inside)
        )

    first = lambda v: F.concat(F.filter(v, F.isnan), F.sort_array(F.filter(v, lambda x: ~F.isnan(x))))
    return let(let(values, first), ranked)


def go_format(x: Column) -> Column:
    """Shortest decimal of a double, without exponent in the usual range."""
    text = x.cast("string")
    plain = F.when((F.abs(x) < 1e15) & (x == F.floor(x).cast("double")), x.cast("decimal(38,0)").cast("string")).otherwise(text)
    return F.when(F.isnan(x), "NaN").when(x == INF, "+Inf").when(x == -INF, "-Inf").otherwise(plain)
