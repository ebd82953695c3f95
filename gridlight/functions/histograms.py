"""Native (sparse exponential) histograms.

A histogram is a struct column: schema, zero_threshold, zero_count, count, sum and the
sparse buckets ``pos`` and ``neg`` (index, n).  Bucket i of schema s covers
(2**((i-1) * 2**-s), 2**(i * 2**-s)].  ``Histogram`` is the algebra; the functions below apply
it Arrow-batched to columns and, for sums and rates, to groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from .numeric import let

SIDE = "array<struct<i: int, n: double>>"
TYPE = f"struct<schema: int, zero_threshold: double, zero_count: double, count: double, sum: double, pos: {SIDE}, neg: {SIDE}>"
MIN_SCHEMA, MAX_SCHEMA = -4, 8


@dataclass
class Histogram:
    schema: int = 0
    zero_threshold: float = 0.0
    zero_count: float = 0.0
    count: float = 0.0
    sum: float = 0.0
    pos: dict[int, float] = field(default_factory=dict)
    neg: dict[int, float] = field(default_factory=dict)

    # -- rows ----------------------------------------------------------------------------

    @classmethod
    def of(cls, row) -> Histogram | None:
        if row is None:
            return None
        side = lambda xs: {int(x["i"]): float(x["n"]) for x in (xs if xs is not None else ())}
        return cls(int(row["schema"]), row["zero_threshold"], row["zero_count"], row["count"], row["sum"], side(row["pos"]), side(row["neg"]))

    def row(self) -> dict:
        side = lambda d: [{"i": i, "n": float(d[i])} for i in sorted(d)]
        return {"schema": self.schema, "zero_threshold": float(self.zero_threshold), "zero_count": float(self.zero_count), "count": float(self.count), "sum": float(self.sum), "pos": side(self.pos), "neg": side(self.neg)}

    # -- shape ---------------------------------------------------------------------------

    def bound(self, i: int) -> float:
        return 2.0 ** (i * 2.0 ** -self.schema)

    def downscale(self, schema: int) -> Histogram:
        """Merge neighbouring buckets until the given, coarser schema."""
        by = self.schema - schema
        if by < 0:
            raise ValueError("a histogram cannot be refined")

        def merge(side: dict[int, float]) -> dict[int, float]:
            out: dict[int, float] = {}
            for i, n in side.items():
                k = -((-i) >> by)  # ceil(i / 2**by)
                out[k] = out.get(k, 0.0) + n
            return out

        return Histogram(schema, self.zero_threshold, self.zero_count, self.count, self.sum, merge(self.pos), merge(self.neg))

    def compact(self) -> Histogram:
        drop = lambda side: {i: n for i, n in side.items() if n}
        return Histogram(self.schema, self.zero_threshold, self.zero_count, self.count, self.sum, drop(self.pos), drop(self.neg))

    def widen_zero(self, threshold: float) -> Histogram:
        """Move buckets that begin below the threshold into the zero bucket."""
        if threshold <= self.zero_threshold:
            return self
        moved, top = 0.0, threshold
        for side in (self.pos, self.neg):
            for i, n in side.items():
                if n and self.bound(i - 1) < threshold:
                    moved, top = moved + n, max(top, self.bound(i))
        if top > threshold:
            return self.widen_zero(top)
        keep = lambda side: {i: n for i, n in side.items() if self.bound(i - 1) >= threshold}
        return Histogram(self.schema, threshold, self.zero_count + moved, self.count, self.sum, keep(self.pos), keep(self.neg))

    # -- arithmetic ------------------------------------------------------------------------

    def _aligned(self, other: Histogram) -> tuple[Histogram, Histogram]:
        schema = min(self.schema, other.schema)
        a, b = self.downscale(schema), other.downscale(schema)
        while a.zero_threshold != b.zero_threshold:
            top = max(a.zero_threshold, b.zero_threshold)
            a, b = a.widen_zero(top), b.widen_zero(top)
        return a, b

    def add(self, other: Histogram, sign: float = 1.0) -> Histogram:
        a, b = self._aligned(other)
        both = lambda x, y: {i: x.get(i, 0.0) + sign * y.get(i, 0.0) for i in {*x, *y}}
        return Histogram(a.schema, a.zero_threshold, a.zero_count + sign * b.zero_count, a.count + sign * b.count, a.sum + sign * b.sum, both(a.pos, b.pos), both(a.neg, b.neg)).compact()

    def sub(self, other: Histogram) -> Histogram:
        return self.add(other, -1.0)

    def scale(self, by: float) -> Histogram:
        times = lambda side: {i: n * by for i, n in side.items()}
        return Histogram(self.schema, self.zero_threshold, self.zero_count * by, self.count * by, self.sum * by, times(self.pos), times(self.neg))

    def reset_since(self, before: Histogram) -> bool:
        """Whether a counter restarted between ``before`` and this one."""
        if self.count < before.count or self.schema > before.schema or self.zero_threshold < before.zero_threshold:
            return True
        a, b = self._aligned(before)
        return a.zero_count < b.zero_count or any(x.get(i, 0.0) < n for x, y in ((a.pos, b.pos), (a.neg, b.neg)) for i, n in y.items())

    # -- reading -----------------------------------------------------------------------------

    def buckets(self) -> list[tuple[float, float, float]]:
        """(lower, upper, n) from the most negative to the most positive."""
        out = [(-self.bound(i), -self.bound(i - 1), self.neg[i]) for i in sorted(self.neg, reverse=True)]
        if self.zero_count:
            low = -self.zero_threshold if self.neg else 0.0
            high = self.zero_threshold if self.pos or not self.neg else 0.0
            out.append((low, high, self.zero_count))
        return out + [(self.bound(i - 1), self.bound(i), self.pos[i]) for i in sorted(self.pos)]

    @staticmethod
    def _within(low: float, high: float, share: float) -> float:
        """Value at a share of a bucket: exponential, linear through zero."""
        if low > 0:
            return low * (high / low) ** share
        if high < 0:
            return -(-low) * ((-high) / (-low)) ** share
        return low + (high - low) * share

    def quantile(self, q: float) -> float:
        if math.isnan(q) or not self.count:
            return math.nan
        if q < 0 or q > 1:
            return math.inf if q > 1 else -math.inf
        rank, seen, found = q * self.count, 0.0, None
        for low, high, n in self.buckets():
            if n:
                found = (low, high, n, seen)
                seen += n
                if seen >= rank:
                    break
        if found is None:
            return math.nan
        low, high, n, under = found
        return self._within(low, high, min(max((rank - under) / n, 0.0), 1.0))

    def fraction(self, low: float, high: float) -> float:
        if not self.count or math.isnan(low) or math.isnan(high):
            return math.nan
        return 0.0 if low >= high else (self._rank(high) - self._rank(low)) / self.count

    def _rank(self, x: float) -> float:
        total = 0.0
        for low, high, n in self.buckets():
            if x >= high:
                total += n
            elif x > low:
                share = math.log(x / low) / math.log(high / low) if low > 0 else 1 - math.log(x / high) / math.log(low / high) if high < 0 else (x - low) / (high - low)
                total += n * share
        return total

    @property
    def avg(self) -> float:
        return self.sum / self.count if self.count else math.nan

    def variance(self) -> float:
        """From the buckets' geometric centres."""
        if not self.count:
            return math.nan
        centre = lambda a, b: 0.0 if a <= 0 <= b else math.copysign(math.sqrt(a * b), a)
        return sum(n * (centre(a, b) - self.avg) ** 2 for a, b, n in self.buckets()) / self.count

    def trim(self, bound: float, upper: bool) -> Histogram:
        """Observations up to (``upper``) or above a bound; buckets across it are split."""
        out = Histogram(self.schema, self.zero_threshold)
        kept_sum = 0.0
        for side, sign in ((self.pos, 1), (self.neg, -1)):
            for i, n in side.items():
                low, high = sorted((sign * self.bound(i - 1), sign * self.bound(i)))
                below = 1.0 if bound >= high else 0.0 if bound <= low else Histogram(self.schema, count=n, pos={i: n} if sign > 0 else {}, neg={} if sign > 0 else {i: n})._rank(bound) / n
                share = below if upper else 1 - below
                if share:
                    (out.pos if sign > 0 else out.neg)[i] = n * share
                    kept_sum += n * share * sign * math.sqrt(self.bound(i - 1) * self.bound(i))
        low, high = -self.zero_threshold if self.neg else 0.0, self.zero_threshold if self.pos or not self.neg else 0.0
        below = 1.0 if bound >= high else 0.0 if bound <= low else (bound - low) / (high - low)
        out.zero_count = self.zero_count * (below if upper else 1 - below)
        out.count = out.zero_count + sum(out.pos.values()) + sum(out.neg.values())
        out.sum = self.sum if out.count == self.count else kept_sum
        return out


def from_exponential(scale: int, zero_count: float, zero_threshold: float, count: float, total: float, pos_offset: int, pos: list[float], neg_offset: int = 0, neg: list[float] = ()) -> Histogram:
    """An OTLP exponential data point; scales beyond the schema range are merged or refused."""
    if scale < MIN_SCHEMA:
        raise ValueError("the scale is too coarse")
    h = Histogram(scale, zero_threshold, zero_count, count, total, {pos_offset + 1 + k: float(n) for k, n in enumerate(pos) if n}, {neg_offset + 1 + k: float(n) for k, n in enumerate(neg) if n})
    return h.downscale(MAX_SCHEMA) if scale > MAX_SCHEMA else h


# -- columns --------------------------------------------------------------------------------


def rowwise(df: DataFrame, f: Callable[[dict], dict | None], add: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns ``add`` (DDL) that ``f`` reads off each, Arrow batch by batch;
    rows for which it gives None fall away."""
    new = StructType.fromDDL(add)
    kept = [x for x in df.schema.fields if x.name not in {*drop, *new.names}]
    schema = StructType([*kept, *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist(maps_as_pydicts="strict"):
                found = f(row)
                if found is not None:
                    out.append({x: row[x] if x in row and x not in found else found[x] for x in arrow.names})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def of_exponential(p: Column) -> Column:
    """``from_exponential`` of a point's struct, as a Column; the caller refuses coarser scales."""
    scale = F.coalesce(p["scale"], F.lit(0))
    by = F.greatest(scale - MAX_SCHEMA, F.lit(0))
    number = lambda text: F.coalesce(F.nullif(text, F.lit("")).cast("double"), F.lit(0.0))
    bucket = lambda i, n: F.struct(i.cast("int").alias("i"), n.alias("n"))

    def merged(raw: Column) -> Column:
        # ceil(i / 2**by) rises with i, so the kept order is that of the merged buckets
        at = F.transform(raw, lambda x: bucket(-F.call_function("shiftright", -x["i"], by), x["n"]))
        sums = lambda xs: F.transform(F.array_distinct(F.transform(xs, lambda x: x["i"])), lambda i: bucket(
            i, F.aggregate(F.filter(xs, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["n"])))
        return F.when(by > 0, let(at, sums)).otherwise(raw)

    def side(x: Column) -> Column:
        first = F.coalesce(x["offset"], F.lit(0)) + 1
        raw = F.transform(F.coalesce(x["bucketCounts"], F.array()), lambda n, k: bucket(first + k, n.cast("double")))
        return let(F.filter(raw, lambda x: x["n"] != 0), merged)

    return F.struct(
        F.least(scale, F.lit(MAX_SCHEMA)).alias("schema"), F.coalesce(p["zeroThreshold"], F.lit(0.0)).alias("zero_threshold"), number(p["zeroCount"]).alias("zero_count"),
        number(p["count"]).alias("count"), F.coalesce(p["sum"], F.lit(0.0)).alias("sum"), side(p["positive"]).alias("pos"), side(p["negative"]).alias("neg"),
    ).cast(TYPE)


def _scalar(f: Callable[[Histogram], float]) -> Callable[[Column], Column]:
    @F.pandas_udf(DoubleType())
    def run(h: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r["count"] is None else f(Histogram.of(r)) for r in h.to_dict("records")], dtype="float64")

    return run


def histogram_quantile(h: Column, q: float) -> Column:
    return _scalar(lambda x: x.quantile(q))(h)


def histogram_fraction(h: Column, low: float, high: float) -> Column:
    return _scalar(lambda x: x.fraction(low, high))(h)


def histogram_stdvar(h: Column) -> Column:
    return _scalar(lambda x: x.variance())(h)


def histogram_stddev(h: Column) -> Column:
    return F.sqrt(histogram_stdvar(h))


def histogram_count(h: Column) -> Column:
    return h["count"]


def histogram_sum(h: Column) -> Column:
    return h["sum"]


def histogram_avg(h: Column) -> Column:
    return F.when(h["count"] != 0, h["sum"] / h["count"]).otherwise(F.lit(math.nan))


def sum_by(df: DataFrame, keys: list[str], h: str = "hist", mean: bool = False) -> DataFrame:
    """Sum (or mean) of histograms per group, natively: buckets are merged to the group's coarsest
    schema and added as ordinary aggregates, so a hot group is summed map-side.  Groups
    must share one zero threshold."""
    least = df.groupBy(*keys).agg(F.min(f"{h}.schema").alias("_s"), F.max(f"{h}.zero_threshold").alias("_t"), F.count(F.lit(1)).alias("_n"))
    same = lambda other: reduce(Column.__and__, [F.col(k).eqNullSafe(other[f"_{k}"]) for k in keys])
    renamed = lambda other: other.withColumnsRenamed({k: f"_{k}" for k in keys})
    least = renamed(least.withColumn("_n", F.col("_n").cast("double")))
    own = df.join(least, same(least)).drop(*[f"_{k}" for k in keys])
    shift = F.pow(F.lit(2.0), F.col(f"{h}.schema") - F.col("_s"))
    by = F.max("_n") if mean else F.lit(1.0)
    totals = own.groupBy(*keys).agg(F.first("_s").alias("schema"), F.first("_t").alias("zero_threshold"), *[(F.sum(f"{h}.{c}") / by).alias(c) for c in ("zero_count", "count", "sum")])
    sides = []
    for side in ("pos", "neg"):
        b = own.select(*keys, "_n", shift.alias("shift"), F.explode(f"{h}.{side}").alias("b")).groupBy(*keys, F.ceil(F.col("b.i") / F.col("shift")).cast("int").alias("i")).agg((F.sum("b.n") / by).alias("n"))
        sides.append(b.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias(side)))
    out = totals
    for side in map(renamed, sides):
        out = out.join(side, same(side), "left").drop(*[f"_{k}" for k in keys])
    none = F.array().cast(SIDE)
    return out.select(*keys, F.struct("schema", "zero_threshold", "zero_count", "count", "sum", F.coalesce("pos", none).alias("pos"), F.coalesce("neg", none).alias("neg")).alias(h))


def grown(samples: list[Histogram], counter: bool) -> Histogram:
    """Last minus first of a window's samples in time order; a counter's resets are made up for."""
    first = samples[0]
    if counter and samples[1].reset_since(first):
        first = Histogram(samples[1].schema)  # what was before the reset does not matter
        samples = [first, *samples[1:]]
    total = samples[-1].sub(first)
    if counter:
        for before, after in zip(samples[1:], samples[2:]):
            if after.reset_since(before):
                total = total.add(before)
    return total


def extrapolated(samples: list[tuple[int, Histogram]], begin: int, end: int, counter: bool, per_second: bool) -> Histogram | None:
    """``grown`` stretched towards the window's edges (ms): by the gap there, or half the mean
    distance where the gap is wide; never below a counter's zero."""
    if len(samples) < 2:
        return None
    total = grown([h for _, h in samples], counter)
    first, last = samples[0][0], samples[-1][0]
    seen = (last - first) / 1000
    mean = seen / (len(samples) - 1)
    edge = lambda gap: mean / 2 if gap >= mean * 1.1 else gap
    before, after = edge((first - begin) / 1000), edge((end - last) / 1000)
    if counter and total.count > 0 and samples[0][1].count >= 0:
        before = min(before, seen * samples[0][1].count / total.count)
    return total.scale((seen + before + after) / seen / ((end - begin) / 1000 if per_second else 1))


def increase(df: DataFrame, keys: list[str], ts: str = "ts", h: str = "hist") -> DataFrame:
    """Reset-aware increase of a counter histogram over each group's samples in time order
    (a series' window, bounded by it)."""

    windows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(h).alias("h")))).alias("_a"))

    def total(row: dict) -> dict:
        samples = [Histogram.of(x["h"]) for x in row["_a"]]
        return {h: (grown(samples, True) if len(samples) > 1 else samples[0].scale(0).compact()).row()}

    return rowwise(windows, total, f"{h} {TYPE}", drop=("_a",))
