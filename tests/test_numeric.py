import math

import pytest
from pyspark.sql import functions as F

from gridlight.functions import labels as L
from gridlight.functions import numeric as N

NAN, INF = math.nan, math.inf


def _eval(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def _same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b


def test_ieee_arithmetic(spark):
    cases = [(1, 0, INF), (-1, 0, -INF), (1, -0.0, -INF), (0, 0, NAN), (NAN, 1, NAN), (INF, INF, NAN), (6, 3, 2)]
    got = _eval(spark, *[N.div(N.const(a), N.const(b)) for a, b, _ in cases])
    assert all(_same(g, c[2]) for g, c in zip(got, cases))
    got = _eval(spark, *[N.mod(N.const(a), N.const(b)) for a, b in ((5, 0), (-5.5, 3), (5, NAN))])
    assert math.isnan(got[0]) and got[1] == -2.5 and math.isnan(got[2])


def test_comparisons_with_nan(spark):
    nan, one = N.const(NAN), N.const(1)
    got = _eval(spark, *[N.COMPARISON[op](nan, one) for op in ("==", "!=", ">", "<", ">=", "<=")], N.COMPARISON["=="](nan, nan))
    assert got == [False, True, False, False, False, False, False]


def test_elementwise(spark):
    got = _eval(spark, N.ELEMENTWISE["ln"](N.const(0)), N.ELEMENTWISE["log2"](N.const(-1)), N.floor(N.const(INF)), N.ceil(N.const(-1.5)), N.round_to(N.const(-2.5), N.const(1)), N.round_to(N.const(7), N.const(5)))
    assert got[0] == -INF and math.isnan(got[1]) and got[2] == INF and got[3] == -1 and got[4] == -2 and got[5] == 5


@pytest.mark.parametrize(("values", "q", "want"), [([1, 2, 3, 4], 0.5, 2.5), ([1, 2, NAN, 4], 0, NAN), ([1, 2, NAN, 4], 1, 4), ([1], -1, -INF), ([1], 2, INF), ([], 0.5, NAN), ([INF, 1], 0, 1)])
def test_quantile(spark, values, q, want):
    array = F.array(*[N.const(v) for v in values]) if values else F.array().cast("array<double>")
    assert _same(_eval(spark, N.quantile(array, N.const(q)))[0], want)


def test_min_max_ignore_nan(spark):
    df = spark.createDataFrame([("a", NAN), ("a", 2.0), ("b", NAN)], "k string, v double")
    got = {r.k: (r.lo, r.hi) for r in df.groupBy("k").agg(N.min_of(F.col("v")).alias("lo"), N.max_of(F.col("v")).alias("hi")).collect()}
    assert got["a"] == (2.0, 2.0) and all(map(math.isnan, got["b"]))


def test_go_format(spark):
    got = _eval(spark, *[N.go_format(N.const(x)) for x in (1, -2.5, NAN, INF, 1234567)])
    assert got == ["1", "-2.5", "NaN", "+Inf", "1234567"]


def test_labels(spark):
    m = L.literal({"b": "2", "a": "1"})
    key, kept, gone, put, cut = _eval(spark, L.series_key(m), L.keep(m, ["a"]), L.remove(m, ["a"]), L.put(m, "c", F.lit("3")), L.put(m, "b", F.lit("")))
    assert key == '{"a":"1","b":"2"}' and kept == {"a": "1"} and gone == {"b": "2"} and put == {"a": "1", "b": "2", "c": "3"} and cut == {"a": "1"}
    hits = _eval(spark, L.matches(F.lit("ab\n"), "=~", "ab"), L.matches(F.lit("ab"), "=~", "a."), L.matches(F.lit(""), "!~", "a"))
    assert hits == [False, True, True]
    for bad in ("(?=a)", "(a)\\1", "(?<!x)y", "a++"):
        with pytest.raises(ValueError):
            L.java_regex(bad)
    assert L.java_replacement("${1}-$name$$") == r"$1-${name}\$"
