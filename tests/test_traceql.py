import pytest
from pyspark.sql import functions as F

from gridlight.plans.promql_parser import ParseError
from gridlight.plans.traceql import TraceEngine, legacy_tags, nested_sets, service_graph
from gridlight.plans.traceql_parser import parse


@pytest.fixture(scope="module")
def engine(spark):
    spans = [  # a tree r -> (a -> b, c), an orphan o, a self-loop l, a cycle x <-> y
        ("t", "r", "", "root", 0, 100, 0, 2), ("t", "a", "r", "a", 1, 50, 2, 3), ("t", "b", "a", "b", 2, 20, 2, 2), ("t", "c", "r", "c", 3, 10, 0, 1),
        ("u", "o", "gone", "o", 5, 5, 0, 1), ("u", "l", "l", "l", 6, 5, 0, 1), ("u", "x", "y", "x", 7, 5, 0, 1), ("u", "y", "x", "y", 8, 5, 0, 1),
    ]
    df = spark.createDataFrame([(t, s, p, n, "svc-" + n, ts, d, st, k, "", "", "") for t, s, p, n, ts, d, st, k in spans], "trace_id string, span_id string, parent_id string, name string, service string, ts_ns long, duration_ns long, status int, kind int, status_message string, scope_name string, scope_version string")
    attrs = spark.createDataFrame([("t", "a", "span", "n", "5", 5.0), ("t", "b", "span", "n", "7", 7.0), ("t", "b", "resource", "n", "9", 9.0), ("t", "c", "span", "ok", "true", None), ("t", "a", "event", "event:name", "e1", None), ("t", "a", "event", "event:name", "e2", None)], "trace_id string, span_id string, scope string, key string, val string, val_num double")
    return TraceEngine(spark, df, attrs)


def _ids(engine, text):
    return sorted(r.span_id for r in engine.groups(parse(text)).select("span_id").collect())


@pytest.mark.parametrize(("text", "want"), [
    ('{ name = "root" } > {}', ["a", "c"]), ('{ name = "root" } >> {}', ["a", "b", "c"]), ('{} < { name = "b" }', []), ('{ name = "b" } < {}', ["a"]), ('{ name = "b" } << {}', ["a", "r"]),
    ('{ name = "a" } ~ {}', ["c"]), ('{ name = "root" } !>> {}', ["l", "o", "r", "x", "y"]), ('{ name = "a" } &> {}', ["a", "b"]), ('{ name = "l" } > {}', []),
    ("{ span.n > 5 }", ["b"]), ("{ .n = 7 }", ["b"]), ("{ resource.n = 9 }", ["b"]), ("{ .n != 5 && duration > 9ns }", ["b", "c", "r"]), ("{ span.ok }", ["c"]), ("{ !span.ok && span.ok != nil }", []),
    ('{ event:name = "e2" }', ["a"]), ('{ event:name != "e1" && name = "a" }', []), ("{ childCount = 2 }", ["r"]), ("{ status = error } | count() = 2", ["a", "b"]), ("{} | avg(duration) > 40", ["a", "b", "c", "r"]),
    ("{ nestedSetParent = -1 }", ["l", "o", "r", "x"]), ("{ span.n ^ 2 = 25 }", ["a"]), ("{ rootName = \"root\" && kind = server }", ["b", "r"]),
])
def test_spansets(engine, text, want):
    assert _ids(engine, text) == want


def test_nested_sets(engine):
    got = {r.span_id: (r.ns_left, r.ns_right, r.ns_parent) for r in nested_sets(engine.spans).collect()}
    assert got["r"] == (1, 8, -1) and got["a"] == (2, 5, 1) and got["b"] == (3, 4, 2) and got["c"] == (6, 7, 1)


def test_search(engine):
    rows = engine.search("{} | select(span.n)", limit=1).collect()
    assert {r.trace_id for r in rows} == {"u"} and len(rows) == 3
    assert engine.trace("t").count() == 4


def test_graph(engine):
    assert [tuple(r)[:5] for r in service_graph(engine.spans).collect()] == [("svc-a", "svc-b", "rpc", 1, 1)]


def test_checks():
    for bad in ('{ duration = "x" }', "{ status > ok }", "{ name =~ 5 }", "{ 1 + true = 2 }", "{} | count(duration) > 1", "{} | avg(name) > 1", "{} | rate() | count() > 1", "{} | quantile_over_time(duration, 2)", "{} | by()", "{ nope = 1 }", "{ a", '{ name =~ "(" }', "{} | rate() by (.a, .b, .c, .d, .e, .f)"):
        with pytest.raises(ParseError):
            parse(bad)
    assert parse("{} | rate() with (a=1, a=2)").hints == {"a": 2}
    parse(legacy_tags('service_name=x http.code=200 name="a b"', "1s"))


def test_rejected_metrics():
    import pytest

    from gridlight.plans.promql_parser import ParseError
    from gridlight.plans.traceql_parser import parse

    five = "by (name, kind, status, span.a, span.b)"
    for text in ("{} | compare({ kind = client }) | topk(2)", f"{{}} | quantile_over_time(duration, 0.5) {five}", f"{{}} | histogram_over_time(duration) {five}"):
        with pytest.raises(ParseError):
            parse(text)
    assert parse(f"{{}} | rate() {five}") and parse("{} | compare({ kind = client })")


#: Attributes of ``engine`` that have one value a span, as columns beside the spans.
COLUMNS = {("span", "n"): ("a", "a_num"), ("resource", "n"): ("b", "b_num"), ("span", "ok"): ("c", "c_num")}


@pytest.fixture(scope="module")
def beside(engine):
    pick = lambda scope, key, v: F.max(F.when((F.col("scope") == scope) & (F.col("key") == key), F.col(v)))
    wide = engine.attrs.groupBy("trace_id", "span_id").agg(*[pick(*k, v).alias(n) for k, names in COLUMNS.items() for v, n in zip(("val", "val_num"), names)])
    spans = engine.spans.join(wide, ["trace_id", "span_id"], "left")
    return TraceEngine(engine.spark, spans.unionByName(spans), engine.attrs, COLUMNS)  # every span is replayed


@pytest.mark.parametrize("text", [
    "{ span.n > 5 }", "{ .n = 7 }", "{ resource.n = 9 }", "{ .n != 5 && duration > 9ns }", "{ span.ok }", "{ !span.ok && span.ok != nil }", "{ .none = nil && .n != nil }", "{ span.n ^ 2 = 25 }",
    "{} | by(span.n) | count() > 5", "{} | by(.n) | coalesce() | count() > 3", "{} | by(kind) | avg(duration) > 9", "{ kind = internal } | by(name) | sum(span.n) > 1", "{} | min(span.n) < 6",
    "({ span.n > 5 } || { span.n = 5 }) | by(span.n) | count() < 2", "{} | by(name) | { span.n > 5 } | count() = 1",
])
def test_columns_beside_spans_are_the_attributes(engine, beside, text):
    found = lambda e: sorted((r.span_id, r.group) for r in e.groups(parse(text)).select("span_id", "group").collect())
    assert found(beside) == found(engine) and "_x0" not in beside.groups(parse(text)).columns


@pytest.mark.parametrize("text", ["{} | compare({ span.n > 5 })", "{ .n != nil } | compare({ childCount = 0 })", "{} | compare({ name = \"a\" } >> {})"])
def test_compare_counts_replays_once(engine, beside, text):
    own = lambda e: sorted((r.side, r.key, r.val, r.value) for r in e.metrics(text, 0, 10, 10).collect() if r.key != "event.event:name")
    assert own(beside) == own(engine) != []


def test_compare_reads_spans_once_and_sorts_no_aggregate(spark, sf_dir):
    from gridlight.registry import traces

    plan = traces.QUERIES["traceql_compare"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan


def test_by_reads_spans_once_and_joins_nothing(spark, sf_dir):
    from gridlight.registry import traces

    plan = traces.QUERIES["traceql_by"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "SortAggregate" not in plan
