"""TraceQL text to a tree, with the static checks of the language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .logql_parser import duration_ns
from .promql_parser import ParseError, _unquote

# fixed values: names of the language
INTRINSICS = {
    "name", "duration", "status", "kind", "statusMessage", "childCount", "nestedSetParent", "nestedSetLeft",
    "nestedSetRight", "traceDuration", "rootName", "rootServiceName",
}
SCOPED_INTRINSICS = {
    "span:name": "name", "span:duration": "duration", "span:status": "status", "span:kind": "kind",
    "span:statusMessage": "statusMessage", "span:childCount": "childCount", "span:id": "span:id",
    "span:parentID": "span:parentID", "trace:id": "trace:id", "trace:duration": "traceDuration", "trace:rootName": "rootName",
    "trace:rootService": "rootServiceName", "instrumentation:name": "instrumentation:name",
    "instrumentation:version": "instrumentation:version", "event:name": "event:name",
    "event:timeSinceStart": "event:timeSinceStart", "link:spanID": "link:spanID", "link:traceID": "link:traceID",
}
SCOPES = {"span", "resource", "instrumentation", "event", "link"}
STATUS = {"unset": 0, "ok": 1, "error": 2}
KIND = {"unspecified": 0, "internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
METRICS = {
    "rate", "count_over_time", "sum_over_time", "min_over_time", "max_over_time", "avg_over_time", "quantile_over_time",
    "histogram_over_time",
}
AGGREGATES = {"count", "avg", "sum", "min", "max"}
STRUCTURAL = {">", ">>", "<", "<<", "~"}
TEXT_FIELDS = {"name", "statusMessage", "rootName", "rootServiceName", "span:id", "span:parentID", "trace:id", "instrumentation:name", "instrumentation:version", "event:name", "link:spanID", "link:traceID"}
NUMBER_FIELDS = {"duration", "traceDuration", "childCount", "nestedSetParent", "nestedSetLeft", "nestedSetRight", "event:timeSinceStart"}


@dataclass(frozen=True)
class Field:
    kind: str  # "intrinsic" or "attribute"
    name: str
    scope: str = ""


@dataclass(frozen=True)
class Literal:
    kind: str  # text, number, duration, bool, status, kind, nil
    value: Any


@dataclass
class Op:
    op: str
    left: Any
    right: Any


@dataclass
class Unary:
    op: str
    expr: Any


@dataclass
class Spanset:
    expr: Any  # None: every span


@dataclass
class Combine:
    op: str  # && or ||
    left: Any
    right: Any


@dataclass
class Structure:
    op: str  # one of STRUCTURAL
    mode: str  # plain, not, union
    left: Any
    right: Any


@dataclass
class Stage:
    kind: str  # filter, aggregate, select, by, coalesce, metric, topk, bottomk, compare, threshold
    name: str = ""
    args: list = field(default_factory=list)
    by: list = field(default_factory=list)
    op: str = ""
    value: Any = None


@dataclass
class Query:
    root: Any
    stages: list[Stage]
    hints: dict[str, Any] = field(default_factory=dict)


_TOKEN = re.compile(
    r"""(?P<space>\s+)
      |(?P<string>"(?:\\.|[^"\\])*"|`[^`]*`)
      |(?P<unit>\d+(?:\.\d+)?(?:ns|us|µs|ms|[smhdw](?![\w]))(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|[smhdw]))*)
      |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<field>(?:parent\.)?(?:span|resource|instrumentation|event|link)?\.(?:"(?:\\.|[^"\\])+"|[A-Za-z_][\w\-./]*)(?:\.(?:"(?:\\.|[^"\\])+"))*)
      |(?P<colon>(?:span|trace|event|link|instrumentation):[A-Za-z]+)
      |(?P<word>[A-Za-z_]\w*)
      |(?P<op>&>>|&<<|!>>|!<<|&>|&<|&~|!>|!<|!~|&&|\|\||>>|<<|>=|<=|!=|=~|==|[-+*/%^(){}|,=<>~!])""",
    re.X,
)


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected character at {at}: {text[at]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self):
        token = self.peek()
        self.at += 1
        return token

    def take(self, text: str) -> bool:
        if self.peek()[0] in ("op", "word") and self.peek()[1] == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ParseError(f"expected {text!r}, found {self.peek()[1]!r}")

    def parse(self) -> Query:
        query = Query(None, [])
        word = self.peek()[1]
        if self.peek()[0] == "word" and (word in AGGREGATES or word in METRICS or word in ("by", "coalesce", "select", "compare")):
            query.root = Spanset(None)
            query.stages.append(self.stage())
        else:
            query.root = self.spansets(0)
        while self.take("|"):
            query.stages.append(self.stage())
        if query.stages and query.stages[-1].kind in ("metric", "topk", "bottomk") and self.peek()[1] in (">", ">=", "<", "<=", "=", "!="):
            op = self.next()[1]
            query.stages.append(Stage("threshold", op=op, value=self.literal().value))
        while self.take("with"):
            self.need("(")
            while not self.take(")"):
                name = self.next()[1]
                self.need("=")
                query.hints[name] = self.literal().value  # the last wins
                self.take(",")
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r}")
        check(query)
        return query

    # -- spansets ---------------------------------------------------------------------

    def spansets(self, level: int):
        levels = [("||",), ("&&",), (">", ">>", "<", "<<", "~", "!>", "!>>", "!<", "!<<", "!~", "&>", "&>>", "&<", "&<<", "&~")]
        if level == len(levels):
            return self.spanset()
        left = self.spansets(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in levels[level]:
            op = self.next()[1]
            right = self.spansets(level + 1)
            if op in ("&&", "||"):
                left = Combine(op, left, right)
            else:
                mode = {"!": "not", "&": "union"}.get(op[0], "plain")
                left = Structure(op if mode == "plain" else op[1:], mode, left, right)
        return left

    def spanset(self):
        if self.take("("):
            inner = self.spansets(0)
            if self.peek() == ("op", "|"):
                stages = []
                while self.take("|"):
                    stages.append(self.stage())
                inner = Query(inner, stages)
            self.need(")")
            return inner
        self.need("{")
        if self.take("}"):
            return Spanset(None)
        found = self.expression(0)
        self.need("}")
        return Spanset(found)

    # -- field expressions ----------------------------------------------------------------

    _LEVELS = [("||",), ("&&",), ("=", "!=", "=~", "!~", ">", ">=", "<", "<="), ("+", "-"), ("*", "/", "%"), ("^",)]

    def expression(self, level: int):
        if level == len(self._LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in self._LEVELS[level]:
            op = self.next()[1]
            left = Op(op, left, self.expression(level if op == "^" else level + 1))
        return left

    def unary(self):
        for op in ("!", "-"):
            if self.take(op):
                return Unary(op, self.unary())
        if self.take("("):
            inner = self.expression(0)
            self.need(")")
            return inner
        return self.atom()

    def atom(self):
        kind, text = self.peek()
        if kind == "field":
            self.next()
            scope, name = text.split(".", 1)
            if scope == "parent":
                raise ParseError("parent scope is not supported")
            name = re.sub(r'"((?:\\.|[^"\\])*)"', lambda m: _unquote(m[0]), name)
            return Field("attribute", name, scope)
        if kind == "colon":
            self.next()
            if text not in SCOPED_INTRINSICS:
                raise ParseError(f"unknown intrinsic {text}")
            return Field("intrinsic", SCOPED_INTRINSICS[text])
        if kind == "word" and text in INTRINSICS:
            self.next()
            return Field("intrinsic", text)
        return self.literal()

    def literal(self) -> Literal:
        sign = -1 if self.take("-") else 1
        kind, text = self.next()
        if kind == "string":
            return Literal("text", _unquote(text))
        if kind == "number":
            return Literal("number", sign * float(text))
        if kind == "unit":
            return Literal("duration", sign * float(duration_ns(text)))
        if text in ("true", "false"):
            return Literal("bool", text == "true")
        if text == "nil":
            return Literal("nil", None)
        if text in STATUS:
            return Literal("status", STATUS[text])
        if text in KIND:
            return Literal("kind", KIND[text])
        raise ParseError(f"unexpected {text or 'end of query'!r}")

    # -- pipeline -------------------------------------------------------------------------

    def arguments(self) -> list:
        self.need("(")
        found = []
        while not self.take(")"):
            found.append(self.expression(3))
            if not self.take(","):
                self.need(")")
                break
        return found

    def stage(self) -> Stage:
        kind, text = self.peek()
        if kind == "op" and text in ("{", "("):
            return Stage("filter", value=self.spansets(0))
        self.next()
        if text in METRICS:
            stage = Stage("metric", text, self.arguments())
            if self.take("by"):
                stage.by = self.arguments()
            return stage
        if text in ("topk", "bottomk"):
            return Stage(text, args=self.arguments())
        if text == "compare":
            self.need("(")
            selection = self.spansets(0)
            rest = []
            while self.take(","):
                rest.append(self.literal().value)
            self.need(")")
            return Stage("compare", args=rest, value=selection)
        if text in ("by", "select"):
            return Stage(text, args=self.arguments())
        if text == "coalesce":
            self.need("(")
            self.need(")")
            return Stage("coalesce")
        if text in AGGREGATES:
            stage = Stage("aggregate", text, self.arguments())
            if self.peek()[1] not in ("=", "!=", ">", ">=", "<", "<="):
                raise ParseError("an aggregate needs a comparison")
            stage.op = self.next()[1]
            stage.value = self.expression(3)
            return stage
        raise ParseError(f"unknown stage {text!r}")


# -- static checks -----------------------------------------------------------------------


def kind_of(x) -> str:
    """text, number, bool, status, kind, nil or any."""
    if isinstance(x, Literal):
        return "number" if x.kind == "duration" else x.kind
    if isinstance(x, Field):
        if x.kind == "attribute":
            return "any"
        return "text" if x.name in TEXT_FIELDS else "number" if x.name in NUMBER_FIELDS else x.name
    if isinstance(x, Unary):
        return "bool" if x.op == "!" else "number"
    return "number" if x.op in "+-*/%^" else "bool"


def _check_expr(x) -> None:
    if isinstance(x, Unary):
        _check_expr(x.expr)
        if kind_of(x.expr) not in ("any", "bool" if x.op == "!" else "number"):
            raise ParseError(f"illegal operand of {x.op}")
    if isinstance(x, Op):
        _check_expr(x.left)
        _check_expr(x.right)
        a, b = kind_of(x.left), kind_of(x.right)
        if x.op in ("&&", "||"):
            if not {a, b} <= {"any", "bool"}:
                raise ParseError(f"illegal operands of {x.op}")
        elif x.op in ("=~", "!~"):
            if not isinstance(x.right, Literal) or b != "text" or a not in ("any", "text"):
                raise ParseError("a regular expression compares text with a literal")
            try:
                re.compile(x.right.value)
            except re.error as e:
                raise ParseError(f"bad regular expression: {e}") from e
        elif x.op in "+-*/%^":
            if not {a, b} <= {"any", "number"}:
                raise ParseError(f"illegal operands of {x.op}")
        else:
            if "any" not in (a, b) and "nil" not in (a, b) and a != b:
                raise ParseError(f"cannot compare {a} with {b}")
            if x.op not in ("=", "!=") and {a, b} & {"bool", "status", "kind", "nil"}:
                raise ParseError(f"illegal operator {x.op}")


def _fields(x) -> bool:
    if isinstance(x, Field):
        return True
    return any(_fields(y) for y in (getattr(x, n, None) for n in ("left", "right", "expr")) if y is not None and not isinstance(y, (str, int, float)))


def check(query: Query) -> None:
    def spanset(x) -> None:
        if isinstance(x, Spanset):
            if x.expr is not None:
                _check_expr(x.expr)
                if kind_of(x.expr) not in ("bool", "any"):
                    raise ParseError("a span filter must be boolean")
        elif isinstance(x, Query):
            check(x)
        else:
            spanset(x.left)
            spanset(x.right)

    spanset(query.root)
    metric = compared = False
    for stage in query.stages:
        if compared:
            raise ParseError("nothing follows compare")
        if metric and stage.kind not in ("topk", "bottomk", "threshold"):
            raise ParseError("nothing but topk, bottomk or a threshold follows a metric")
        if stage.kind in ("topk", "bottomk", "threshold") and not metric:
            raise ParseError(f"{stage.kind} follows a metric")
        if stage.kind == "filter":
            spanset(stage.value)
        if stage.kind == "aggregate":
            if (stage.name == "count") != (not stage.args):
                raise ParseError(f"wrong arguments of {stage.name}")
            for a in stage.args:
                _check_expr(a)
                if kind_of(a) not in ("any", "number") or not _fields(a):
                    raise ParseError(f"{stage.name} needs a numeric field")
        if stage.kind == "by" and (len(stage.args) != 1 or not _fields(stage.args[0])):
            raise ParseError("by takes one field")
        if stage.kind == "compare":
            spanset(stage.value)
        if stage.kind in ("metric", "compare"):
            metric, compared = True, stage.kind == "compare"
            most = 4 if stage.name in ("quantile_over_time", "histogram_over_time") else 5  # these add a label of their own
            if len(stage.by) > most:
                raise ParseError(f"at most {most} fields in by")
            if stage.name == "quantile_over_time":
                qs = [a.value for a in stage.args[1:] if isinstance(a, Literal)]
                if not qs or len(qs) != len(stage.args) - 1 or any(not 0 <= q <= 1 for q in qs):
                    raise ParseError("quantiles lie between 0 and 1")
            elif stage.name in ("rate", "count_over_time") and stage.args:
                raise ParseError(f"{stage.name} takes no argument")
            elif stage.name.endswith("_over_time") and stage.name != "count_over_time" and len(stage.args) != 1:
                raise ParseError(f"{stage.name} takes one field")


def parse(text: str) -> Query:
    return Parser(text).parse()
