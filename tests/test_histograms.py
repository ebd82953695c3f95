import math

import pytest
from pyspark.sql import functions as F

from gridlight.functions import histograms as H

A = H.Histogram(0, 0.001, 1, 10, 30.0, {1: 4.0, 2: 5.0})
B = H.Histogram(1, 0.001, 0, 3, 4.0, {1: 1.0, 3: 2.0})


def test_algebra():
    c = A.add(B)
    assert (c.schema, c.count, c.zero_count, c.pos) == (0, 13, 1, {1: 5.0, 2: 7.0})
    assert c.sub(B.downscale(0)).pos == A.pos and A.scale(2).count == 20
    assert B.downscale(0).pos == {1: 1.0, 2: 2.0} and H.Histogram(1, pos={-1: 1.0, 0: 1.0}).downscale(0).pos == {0: 2.0}
    assert A.widen_zero(1.5).pos == {2: 5.0} and A.widen_zero(1.5).zero_count == 5
    assert B.reset_since(A) and not A.scale(2).reset_since(A)


def test_reading():
    assert A.quantile(1) == 4 and A.quantile(0.3) == pytest.approx(2 ** 0.5) and math.isnan(H.Histogram().quantile(0.5))
    assert A.quantile(2) == math.inf and A.quantile(-1) == -math.inf and A.avg == 3
    assert A.fraction(1, 2) == pytest.approx(0.4) and A.fraction(-math.inf, math.inf) == pytest.approx(1)
    mirrored = H.Histogram(0, 0.001, 1, 10, -30.0, {}, {1: 4.0, 2: 5.0})
    assert mirrored.quantile(0) == -4 and mirrored.quantile(0.7) == pytest.approx(-(2 ** 0.5))
    low, high = A.trim(2, True), A.trim(2, False)
    assert low.pos == {1: 4.0} and high.pos == {2: 5.0} and low.count + high.count == A.count
    assert H.from_exponential(9, 0, 0, 3, 1, 0, [1, 2]).pos == {1: 3.0}
    with pytest.raises(ValueError):
        H.from_exponential(-5, 0, 0, 0, 0, 0, [])


def test_columns(spark):
    df = spark.createDataFrame([("a", 1, A.row()), ("a", 2, A.scale(2).row()), ("a", 3, B.row()), ("b", 1, B.row())], f"k string, ts long, hist {H.TYPE}")
    sums = {r.k: H.Histogram.of(r.hist.asDict(True)) for r in H.sum_by(df, ["k"]).collect()}
    assert sums["a"].pos == {1: 13.0, 2: 17.0} and sums["a"].count == 33 and sums["b"] == B
    grown = {r.k: r.hist["count"] for r in H.increase(df, ["k"]).collect()}
    assert grown == {"a": 13.0, "b": 0.0}
    q = {(r.k, r.ts): r.q for r in df.select("k", "ts", H.histogram_quantile(F.col("hist"), 1.0).alias("q")).collect()}
    assert q["a", 1] == 4
