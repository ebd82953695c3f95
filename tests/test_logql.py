import pytest
from pyspark.sql import functions as F

from gridlight.functions import labels as L
from gridlight.functions import logparse as LP
from gridlight.functions.templates import Template, TemplateError, compile_columns
from gridlight.plans import logql_parser as Q
from gridlight.plans.logql import LogEngine

S = 10**9


@pytest.fixture(scope="module")
def engine(spark):
    lines = [
        (1, {"app": "x"}, '{"a":{"b":1.50,"c d":null},"e":[1],"s":"t","app":"inner"}', {"m": "1"}),
        (2, {"app": "x"}, "level=info msg=\"two words\" took=1m30s size=2KiB flag", {}),
        (3, {"app": "x"}, "plain 10.1.2.3 and ::1", {}),
        (4, {"app": "y"}, "n=4 v=abc", {}), (5, {"app": "y"}, "n=5 v=2", {}),
    ]
    df = spark.createDataFrame([(t * S, ls, x, m) for t, ls, x, m in lines], "ts long, labels map<string,string>, line string, meta map<string,string>")
    return LogEngine(spark, df.withColumn("key", L.series_key(F.col("labels"))))


def _labels(engine, text, at=None):
    return [r.labels for r in engine.logs(text, 0, 10 * S, direction="forward").collect()]


def test_json(engine):
    assert _labels(engine, '{app="x"} | json | s="t"')[0] == {"app": "x", "m": "1", "a_b": "1.50", "s": "t", "app_extracted": "inner"}
    assert [r.get("__error__") for r in _labels(engine, '{app="x"} | json')] == [None, "JSONParserErr", "JSONParserErr"]
    assert len(_labels(engine, '{app="x"} | json | __error__=""')) == 1
    assert "__error__" not in _labels(engine, '{app="x"} | json | drop __error__, __error_details__')[1]


def test_logfmt(engine):
    got = _labels(engine, '{app="x"} | logfmt | took > 1m and size >= 2KB')
    assert len(got) == 1 and got[0]["msg"] == "two words"
    assert LP.logfmt("a=1 b", keep_empty=True) == '{"a": "1", "b": ""}' and LP.logfmt('x="', strict=True) is None


def test_numeric_filter_errors(engine):
    got = _labels(engine, '{app="y"} | logfmt | v > 1')
    assert [r.get("__error__") for r in got] == ["LabelFilterErr", None]
    assert [r.get("__error__") for r in _labels(engine, '{app="y"} | logfmt | n > 3 or v > 1')] == [None, None]  # short circuit


def test_ip_and_pattern(engine):
    assert len(_labels(engine, '{app="x"} |= ip("10.0.0.0/8")')) == 1 and len(_labels(engine, '{app="x"} |= ip("::1")')) == 1
    assert _labels(engine, '{app="x"} | pattern "plain <ip> <_>" | ip="10.1.2.3"')[0]["ip"] == "10.1.2.3"


def test_what_is_no_address_is_in_no_range(spark):
    values = ["10.0.4.9", "10.0.300.9", "x", "::1"]
    df = spark.createDataFrame([({"app": "x"}, k * S, f"from {v} ok") for k, v in enumerate(values, 1)], "labels map<string,string>, ts long, line string")
    engine = LogEngine(spark, df.withColumn("key", L.series_key(F.col("labels"))))
    got = lambda op: sorted(r["a"] for r in _labels(engine, f'{{app="x"}} | pattern "from <a> ok" | a{op}ip("10.0.3.1-10.0.5.255")'))
    assert got("=") == ["10.0.4.9"] and got("!=") == ["10.0.300.9", "::1", "x"]


def test_unwrap_error_fails(engine):
    with pytest.raises(Exception, match="pipeline error"):
        engine.metric('sum_over_time({app="y"} | logfmt | unwrap v [10s])', 10 * S).collect()
    got = engine.metric('sum_over_time({app="y"} | logfmt | unwrap v | __error__="" [10s])', 10 * S).collect()
    assert [r.value for r in got] == [2.0]


def test_direction_and_limit(engine):
    assert [r.ts for r in engine.logs('{app=~".+"}', 0, 10 * S, limit=2).collect()] == [5 * S, 4 * S]
    assert [len(r.entries) for r in engine.streams('{app=~".+"}', 0, 10 * S).orderBy("key").collect()] == [1, 2, 2]


def test_parser_checks():
    for bad in ('{a=~".*"}', "{}", '{a="b"} | json | unwrap', 'sum_over_time({a="b"}[1m])', 'count_over_time({a="b"} | unwrap x [1m])', 'rate({a="b"}[1m]) by (x)', '{a="b"} | label_format __error__="x"', '{a="b"} |= x'):
        with pytest.raises(Q.ParseError):
            Q.parse(bad)


@pytest.mark.parametrize(("template", "want"), [
    ("{{.a}}-{{ .b | ToUpper }}", "1-XY"), ('{{if and .a (eq .b "xy")}}y{{else if .c}}z{{end}}', "y"), ('{{range $i, $x := fromJson "[1,2]"}}{{$i}}:{{$x}} {{end}}', "0:1 1:2 "),
    ('{{define "t"}}<{{.}}>{{end}}{{template "t" .b}}', "<xy>"), ("{{add 1 2 | mul 3}} {{div 7 2}} {{mod 7 3}} {{divf 1 4}}", "9 3 1 0.25"),
    ('{{printf "%-4s|%03d|%.2f" .b 7 1.5}}', "xy  |007|1.50"), ('{{alignLeft 4 .b}}|{{alignRight 1 .b}}', "xy  |y"), ('{{trunc -1 .b}}{{substr 0 1 .b}}{{title "ab cd"}}', "yxAb Cd"),
    ('{{regexReplaceAll "(x)(y)" .b "$2$1"}}{{count "x" "xx"}}', "yx2"), ('{{ __timestamp__ | date "2006-01-02 15:04:05.000" }}', "1970-01-01 00:00:01.500"),
    ('{{default "d" .none}}{{b64enc .b}}{{urlencode "a b"}}', "deHk=a+b"), ('{{with $v := .b}}{{$v}}{{len $v}}{{end}}', "xy2"), ("a {{- .a -}} b", "a1b"), ("{{round 2.345 2}} {{max 1 3 2}} {{int \"7\"}}", "2.35 3 7"),
    ('{{ unixToTime "1700000000" | unixEpoch }}', "1700000000"), ('{{ toDate "2006-01-02" "2024-03-05" | date "Jan 2 2006" }}', "Mar 5 2024"), ("{{ bytes \"2KB\" }} {{ duration \"1m\" }}", "2000 60"),
])
def test_templates(template, want):
    assert Template(template).run({"a": "1", "b": "xy"}, "the line", 1_500_000_000) == want


def test_template_errors(spark):
    for bad in ("{{", "{{if .a}}", "{{nope .a}}", "{{end}}"):
        with pytest.raises(TemplateError):
            Template(bad).run({})
    with pytest.raises(TemplateError):
        Template("{{div 1 0}}").run({})
    assert compile_columns("{{.a}}{{if .b}}x{{end}}", F.col("m"), F.col("l")) is None


def test_equal_ranges_read_their_lines_once(spark):
    df = spark.createDataFrame([(k * S, {"app": "xy"[k % 2]}, f"user={k % 3}") for k in range(1, 9)], "ts long, labels map<string,string>, line string")
    engine = LogEngine(spark, df.withColumn("key", L.series_key(F.col("labels"))))
    one = 'count_over_time({app=~".+"} | logfmt [4s])'
    out = engine.metric(f"{one} / on (app) group_left () sum by (app) ({one})", 4 * S, 8 * S, 2 * S)
    got = {(r.step // S, r.labels["app"], r.labels["user"]): r.value for r in out.collect()}
    assert got[4, "x", "2"] == 0.5 and got[8, "y", "1"] == 0.5 and len(got) == 12
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("ArrowEvalPython") == 1
    other = engine.metric(f"{one} / on (app, user) {one.replace('4s', '2s')}", 8 * S).collect()  # another range is another frame
    assert {(r.labels["app"], r.labels["user"]): r.value for r in other} == {("x", "2"): 1.0, ("y", "1"): 1.0}
