import math
import time

import pytest
from pyspark.sql import functions as F

from gridlight.functions import labels as L
from gridlight.plans import promql_parser as P
from gridlight.plans.promql import Engine, PlanError
from gridlight.sources import views

MIN = 60_000


def _samples(spark, series):
    """{(metric, labels...): [(ts, value or None for stale)]}"""
    rows = [(m, dict(ls), ts, 0.0 if v is None else float(v), v is None) for (m, ls), points in series.items() for ts, v in points]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts long, value double, stale boolean")
    return df.withColumn("key", L.series_key(F.col("labels")))


@pytest.fixture(scope="module")
def engine(spark):
    s = lambda **k: tuple(sorted(k.items()))
    series = {
        ("up", s(job="a", i="1")): [(0, 1), (MIN, 2), (2 * MIN, None), (10 * MIN, 5)],
        ("up", s(job="a", i="2")): [(0, 10), (MIN, 20), (2 * MIN, 30)],
        ("up", s(job="b", i="1")): [(0, math.nan), (MIN, math.nan)],
        ("hits", s(job="a")): [(k * MIN, v) for k, v in enumerate((0, 10, 20, 5, 15, 25))],
        ("lat_bucket", s(le="1")): [(0, 2)], ("lat_bucket", s(le="2")): [(0, 6)], ("lat_bucket", s(le="+Inf")): [(0, 10)],
        ("target_info", s(job="a", instance="x", env="prod")): [(0, 1)], ("q", s(job="a", instance="x")): [(0, 3)],
        ("v", s(n="a10")): [(0, 1)], ("v", s(n="a9")): [(0, 2)], ("v", s(n="a")): [(0, math.nan)],
    }
    return Engine(spark, _samples(spark, series))


def _run(engine, text, at=0, end=None, step=MIN):
    out = engine.query(text, at, end, step).collect()
    return {(r.step, tuple(sorted(r.labels.items()))): r.value for r in out}


def test_lookback_and_staleness(engine):
    at = lambda t: _run(engine, 'up{job="a"}', t)
    assert sorted(at(MIN).values()) == [2, 20]
    assert list(at(2 * MIN).values()) == [30]  # the other is stale
    assert list(at(7 * MIN).values()) == []  # left-open window of five minutes
    assert list(at(7 * MIN - 1).values()) == [30]


def test_names(engine):
    (key,) = {k[1] for k in _run(engine, 'up{i="2"}')}
    assert dict(key)["__name__"] == "up"
    (key,) = {k[1] for k in _run(engine, 'up{i="2"} + 0')}
    assert "__name__" not in dict(key)
    (key,) = {k[1] for k in _run(engine, 'last_over_time(up{i="2"}[5m])')}
    assert dict(key)["__name__"] == "up"


def test_rate_resets(engine):
    got = list(_run(engine, "increase(hits[5m])", 5 * MIN).values())[0]
    # (0m, 5m]: 10 20 5 15 25 -> 15 + 20 over four minutes; the start is extrapolated
    # by a whole interval at most, limited by the zero point at 10/35 of four minutes
    assert got == pytest.approx(35 * (240 + 60) / 240)
    assert list(_run(engine, "resets(hits[6m])", 5 * MIN).values()) == [1]
    assert list(_run(engine, "irate(hits[5m])", 3 * MIN).values()) == [pytest.approx(5 / 60)]


def test_nan_rules(engine):
    assert list(_run(engine, 'max(up{i="1"})').values()) == [1]
    assert _run(engine, 'up{job="b"} > 1') == {}
    assert list(_run(engine, 'up{job="b"} != bool 1').values()) == [1]
    order = [r.value for r in engine.query("sort_desc(v)", 0).collect()]
    assert order[:2] == [2, 1] and math.isnan(order[2])


def test_matching_errors(engine):
    for bad in ('up{job="a"} + on (job) up{job="a"}', "up * on (job) group_left () up", 'label_replace(up, "i", "x", "", "")'):
        with pytest.raises(Exception, match="duplicate|same labelset"):
            _run(engine, bad)
    for bad in ("up and 1", "1 > 2", "sum(1)", "rate(up)", "up[5m]", "nope(up)", "clamp(up)"):
        with pytest.raises((PlanError, P.ParseError)):
            engine.query(bad, 0, MIN)


def test_group_left_include(engine):
    got = _run(engine, "q * on (job, instance) group_left (env) target_info")
    assert got == {(0, (("env", "prod"), ("instance", "x"), ("job", "a"))): 3}
    assert _run(engine, "info(q)") == {(0, (("__name__", "q"), ("env", "prod"), ("instance", "x"), ("job", "a"))): 3}


def test_histogram(engine):
    assert list(_run(engine, "histogram_quantile(0.5, lat_bucket)").values()) == [1.75]
    assert list(_run(engine, "histogram_quantile(0.9, lat_bucket)").values()) == [2]
    assert list(_run(engine, "histogram_fraction(0, 1.5, lat_bucket)").values()) == [0.4]


def test_natural_sort(engine):
    assert [r.labels["n"] for r in engine.query('sort_by_label(v, "n")', 0).collect()] == ["a", "a9", "a10"]


def test_subquery_and_at(engine):
    assert list(_run(engine, "sum_over_time(hits[3m:1m])", 5 * MIN).values()) == [45]
    assert set(_run(engine, "hits @ 60", 0, 2 * MIN).values()) == {10}
    assert list(_run(engine, "hits offset -1m").values()) == [10]


def test_absent_scalar_time(engine):
    assert _run(engine, 'absent(nope{a="b", c=~"d"})') == {(0, (("a", "b"),)): 1}
    assert _run(engine, "scalar(up)") and math.isnan(_run(engine, "scalar(up)")[(0, ())])
    assert _run(engine, "time() + 1", MIN)[(MIN, ())] == 61
    assert _run(engine, "vector(1) / 0")[(0, ())] == math.inf


def test_parser():
    tree = P.parse("-2 ^ 2 + a * on (x) group_left (y) b")
    assert tree.op == "+" and isinstance(tree.left, P.Negate) and tree.right.group == "left" and tree.right.include == ["y"]
    assert P.parse("a[1h30m]").range_ms == 5_400_000 and P.parse("x[5m:1m] offset -1h @ 3").at == 3000
    for bad in ("", "{}", "a[", "sum by (x", "a offset", "topk(a)", 'a{b="c"', "1 and", "a[0s]", '{__name__="a", __name__="b"} x'):
        with pytest.raises(P.ParseError):
            P.parse(bad)
    with pytest.raises(P.ParseError):
        P.parse("1" * 200_000)


def test_limit_ratio_picks_by_series_hash(spark, sf_dir):
    import xxhash

    rows = views.gauge(spark, sf_dir)
    at = 1_705_276_800_000
    share = lambda r: xxhash.xxh64_intdigest(b"".join(x.encode() + b"\xff" for kv in sorted(r.labels.items()) for x in kv)) / float(2**64 - 1)
    everything = Engine(spark, rows).query("last_over_time(event_value[5d])", at).collect()
    for ratio in (0.3, -0.3):
        got = {r.key for r in Engine(spark, rows).query(f"limit_ratio({ratio}, last_over_time(event_value[5d]))", at).collect()}
        assert got == {r.key for r in everything if (share(r) < ratio if ratio > 0 else share(r) >= 1 + ratio)} and got


def test_native_histograms_replace_floats(spark, sf_dir):
    hists = views.native(spark, sf_dir)
    floats = hists.select("metric", "labels", "ts", F.lit(7.0).alias("value"), "key", "stale")
    late = floats.withColumn("ts", F.col("ts") + 60_000)
    at = 1_705_276_800_000
    engine = Engine(spark, floats.unionByName(late), hists=hists)
    rows = engine.query("event_native", at).collect()
    assert rows and all((r.value is None) == (r.hist is not None) for r in rows)
    assert {r.value for r in engine.query("count(event_native @ %d)" % (at // 1000), at).collect()} == {5.0}
    with pytest.raises(PlanError):
        Engine(spark, floats).query("histogram_count(event_native)", at)


def test_annotations(engine):
    def of(text, end=0):
        return {r.message.removeprefix("PromQL warning: ") for r in engine.annotations(text, 0, end).collect()}

    assert of("sum(up)") == of("histogram_quantile(0.5, lat_bucket)") == of("sort(up)") == of("limit_ratio(-1, up)") == set()
    assert of("-(quantile(-Inf, up) + quantile_over_time(1.25, up[5m]))") == {f"quantile value should be between 0 and 1, got {x}" for x in ("-Inf", "1.25")}
    assert of('histogram_quantiles(lat_bucket, "q", 0.5, 2)') == {"quantile value should be between 0 and 1, got 2"}
    assert of("limit_ratio(1.5, up)") == {"ratio value should be between -1 and 1, got 1.5, capping to 1"}
    assert of("sort_by_label(up, \"i\")", MIN) == {"sort is ineffective for range queries since results are always ordered by labels"}
    bad = 'bucket label "le" is missing or has a malformed value of '
    assert of('histogram_quantile(0.5, label_replace(up{i="2"}, "le", "a\\"b", "", ""))') == {bad + '"a\\"b" for metric name "up"'}
    assert of("histogram_fraction(0, 1, sum(up))") == {bad + '""'}


def test_samples_of_one_time_stand_in_sequence(spark):
    # 1 2 3 0 1 2, where 3 and 0 share a time: one reset, and the window's last sample is the later of two
    points = [(0, 1, 1), (MIN, 2, 2), (2 * MIN, 3, 3), (2 * MIN, 0, 4), (3 * MIN, 1, 5), (4 * MIN, 9, 6), (4 * MIN, 2, 7)]
    df = spark.createDataFrame([("n", {}, t, float(v), q, False) for t, v, q in points], "metric string, labels map<string,string>, ts long, value double, seq long, stale boolean")
    engine = Engine(spark, df.withColumn("key", L.series_key(F.col("labels"))))
    one = lambda text: list(_run(engine, text, 4 * MIN).values())
    assert one("resets(n[5m])") == [2.0] and one("n") == [2.0] and one("last_over_time(n[5m])") == [2.0]
    # 2 - 1 and the falls from 3 and 9, over four minutes of five (the start is zero at most)
    assert one("increase(n[5m])")[0] == pytest.approx(13 * (240 + min(20, 240 / 13)) / 240)
    assert _run(engine, "increase(n[4m])", 4 * MIN, 5 * MIN)[(4 * MIN, ())] == pytest.approx(12 * (180 + min(18, 180 * 2 / 12)) / 180)


def test_mad_of_a_wide_window(spark):
    rows = [("n", {}, k, float(k % 101), False) for k in range(1, 20_001)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts long, value double, stale boolean")
    engine = Engine(spark, df.withColumn("key", L.series_key(F.col("labels"))))
    began = time.monotonic()
    assert list(_run(engine, "mad_over_time(n[5m])", 5 * MIN).values()) == [25.0]
    assert time.monotonic() - began < 60  # a median within each deviation took n * n * log n steps
    assert list(_run(engine, "quantile_over_time(0.5, n[5m])", 5 * MIN).values()) == [50.0]
