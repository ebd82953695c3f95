"""The evaluation grid and windows over it, without range joins.

A sample belongs to the steps t with t - offset - range < ts <= t - offset.  These are
consecutive, so each row computes its first and last step and explodes that short
sequence on its own; all that is shuffled afterwards are (series, step) groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_POINTS = 11_000


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... <= end (milliseconds or nanoseconds alike)."""

    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.step <= 0 or self.end < self.start:
            raise ValueError("the grid needs a positive step and end >= start")
        if self.count > MAX_POINTS:
            raise ValueError(f"more than {MAX_POINTS} points per series")

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def last(self) -> int:
        return self.start + (self.count - 1) * self.step

    def steps(self) -> Column:
        return F.sequence(F.lit(self.start).cast("long"), F.lit(self.last).cast("long"), F.lit(self.step).cast("long"))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.explode(self.steps()).alias("step"))


def steps_of(ts: Column, grid: Grid, span: int, offset: int) -> Column:
    """Array of the grid's steps whose window (t - offset - span, t - offset] has ts.
    Integer arithmetic throughout: nanoseconds exceed a double."""
    low = ts + F.lit(offset - grid.start)
    up = lambda x: x + F.pmod(-x, F.lit(grid.step).cast("long"))
    first = F.greatest(up(low), F.lit(0).cast("long"))
    last = F.least(up(low + F.lit(span)) - F.lit(grid.step), F.lit(grid.last - grid.start).cast("long"))
    steps = F.sequence(first + F.lit(grid.start), last + F.lit(grid.start), F.lit(grid.step).cast("long"))
    return F.when(first <= last, steps)


def window(df: DataFrame, ts: str, grid: Grid, span: int, offset: int = 0) -> DataFrame:
    """``df`` with a row per (row, step) of the window; only rows of the scanned time range."""
    near = df.where((F.col(ts) > grid.start - offset - span) & (F.col(ts) <= grid.last - offset))
    return near.withColumn("step", F.explode(steps_of(F.col(ts), grid, span, offset)))


def bucketed(df: DataFrame, ts: str, grid: Grid, span: int, offset: int = 0) -> DataFrame | None:
    """``df`` with ``bucket``, the first step that sees the row, if the range is a multiple
    of the step; then partial aggregates per bucket can be combined by ``spread``."""
    if span % grid.step or span == grid.step:
        return None
    near = df.where((F.col(ts) > grid.start - offset - span) & (F.col(ts) <= grid.last - offset))
    low = F.col(ts) + F.lit(offset - grid.start)
    return near.withColumn("bucket", low + F.pmod(-low, F.lit(grid.step).cast("long")) + F.lit(grid.start))


def spread(df: DataFrame, grid: Grid, span: int) -> DataFrame:
    """Bucket rows at every step whose window has them."""
    first = F.greatest(F.col("bucket"), F.lit(grid.start).cast("long"))
    last = F.least(F.col("bucket") + F.lit(span - grid.step), F.lit(grid.last).cast("long"))
    steps = F.when(first <= last, F.sequence(first, last, F.lit(grid.step).cast("long")))
    return df.withColumn("step", F.explode(steps)).drop("bucket")


def everywhere(df: DataFrame, grid: Grid) -> DataFrame:
    """Rows without step, repeated at every step."""
    return df.withColumn("step", F.explode(grid.steps()))
