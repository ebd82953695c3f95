"""LogQL text to a tree.  Vector-level operators share the PromQL nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from . import promql_parser as P
from .promql_parser import ParseError, _unquote

# fixed values: operators of the language
RANGE_OPS = {
    "rate", "count_over_time", "bytes_rate", "bytes_over_time", "sum_over_time", "avg_over_time", "min_over_time",
    "max_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "first_over_time", "last_over_time",
    "absent_over_time", "rate_counter",
}
NEEDS_UNWRAP = {
    "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time",
    "quantile_over_time", "first_over_time", "last_over_time", "rate_counter",
}
GROUPED = {"avg_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "first_over_time", "last_over_time"}
VECTOR_OPS = {"sum", "avg", "min", "max", "count", "stddev", "stdvar", "topk", "bottomk", "approx_topk", "sort", "sort_desc"}
_DURATION_NS = {"ns": 1, "us": 1000, "µs": 1000, "μs": 1000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 604800 * 10**9, "y": 31536000 * 10**9}
BYTES = {"b": 1, "kb": 1000, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40, "pib": 1 << 50}


def duration_ns(text: str) -> int:
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|μs|ms|s|m|h|d|w|y)", text)
    return sum(round(float(n) * _DURATION_NS[u]) for n, u in parts)


@dataclass
class Query:
    """A log selection: matchers and pipeline stages."""

    matchers: list[tuple[str, str, str]]
    stages: list = field(default_factory=list)


@dataclass
class LineFilter:
    op: str
    parts: list[tuple[str, str]]  # ("text" or "ip", pattern), any of them


@dataclass
class ParserStage:
    kind: str
    params: list[tuple[str, str]] = field(default_factory=list)
    pattern: str = ""
    flags: set[str] = field(default_factory=set)


@dataclass
class LabelFilter:
    name: str
    op: str
    kind: str  # text, number, duration, bytes, ip
    value: Any


@dataclass
class AndOr:
    op: str
    left: Any
    right: Any


@dataclass
class LineFormat:
    template: str


@dataclass
class LabelFormat:
    items: list[tuple[str, str, str]]  # (target, "label" or "template", source)


@dataclass
class DropKeep:
    kind: str
    items: list[tuple[str, str, str]]  # (name, op or "", value)


@dataclass
class Unwrap:
    label: str
    convert: str = ""


@dataclass
class Decolorize:
    pass


@dataclass
class Range:
    op: str
    query: Query
    range_ns: int
    offset_ns: int = 0
    param: float | None = None
    without: bool = False
    labels: list[str] | None = None


@dataclass
class Variants:
    parts: list
    query: Query
    range_ns: int


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      |(?P<string>"(?:\\.|[^"\\])*"|`[^`]*`)
      |(?P<flag>--[a-z-]+)
      |(?P<unit>\d+(?:\.\d+)?(?:ns|us|µs|μs|ms|[smhdwy](?![A-Za-z]))(?:\d+(?:\.\d+)?(?:ns|us|µs|μs|ms|[smhdwy]))*(?![A-Za-z_]))
      |(?P<bytes>\d+(?:\.\d+)?(?:[kKmMgGtTpP]i?)?[bB](?![A-Za-z_]))
      |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
      |(?P<op>\|=|\|~|\|>|!>|=~|!~|==|!=|>=|<=|[-+*/%^(){}\[\],=<>|])""",
    re.X,
)


class Parser(P.Parser):
    def __init__(self, text: str):
        if len(text.encode()) > P.MAX_TEXT:
            raise ParseError("the query is too long")
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected character at {at}: {text[at]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def parse(self):
        if self.peek() == ("op", "{"):
            found = self.log_query()
        elif self.peek()[1] == "variants":
            found = self.variants()
        else:
            found = self.expression(0)
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r}")
        return found

    # -- metric level (binary levels and matching come from the parent class) ----------

    def primary(self):
        kind, text = self.next()
        if kind == "op" and text == "(":
            inner = self.expression(0)
            self.need(")")
            return inner
        if kind == "number":
            return P.Number(float(text))
        if kind != "word":
            raise ParseError(f"unexpected {text or 'end of query'!r}")
        if text in RANGE_OPS:
            return self.range_call(text)
        if text in VECTOR_OPS:
            return self.vector_op(text)
        if text == "vector":
            self.need("(")
            value = self.signed()
            self.need(")")
            return P.Call("vector", [P.Number(value)])
        if text == "label_replace":
            self.need("(")
            args = [self.expression(0)]
            while self.take(","):
                args.append(P.Text(_unquote(self.next()[1])))
            self.need(")")
            if len(args) != 5:
                raise ParseError("label_replace takes 5 arguments")
            return P.Call("label_replace", args)
        raise ParseError(f"unknown function {text}")

    def postfix(self, node):
        return node

    def vector_op(self, op: str):
        node = P.Aggregate(op, None)

        def grouping() -> None:
            for word in ("by", "without"):
                if self.take(word):
                    node.without, node.labels = word == "without", list(dict.fromkeys(self.names()))

        grouping()
        self.need("(")
        if op in ("topk", "bottomk", "approx_topk"):
            node.param = P.Number(float(self.next()[1]))
            self.need(",")
        node.expr = self.expression(0)
        self.need(")")
        if node.labels is None:
            grouping()
        if op in ("sort", "sort_desc"):
            return P.Call(op, [node.expr])
        return node

    def range_call(self, op: str) -> Range:
        self.need("(")
        param = None
        if op == "quantile_over_time":
            param = self.signed()
            self.need(",")
        query, span, offset = self.range_body()
        self.need(")")
        node = Range(op, query, span, offset, param)
        for word in ("by", "without"):
            if self.take(word):
                if op not in GROUPED:
                    raise ParseError(f"grouping not allowed for {op}")
                node.without, node.labels = word == "without", list(dict.fromkeys(self.names()))
        unwraps = [s for s in query.stages if isinstance(s, Unwrap)]
        if op in NEEDS_UNWRAP and not unwraps:
            raise ParseError(f"{op} needs an unwrap")
        if op in ("count_over_time", "bytes_rate", "bytes_over_time") and unwraps:
            raise ParseError(f"{op} takes no unwrap")
        return node

    def range_body(self) -> tuple[Query, int, int]:
        inside = self.take("(")
        query = self.log_query(in_range=True)
        if inside and self.peek() == ("op", ")"):
            self.next()
        self.need("[")
        span = duration_ns(self.next()[1])
        self.need("]")
        query.stages += self.stages(in_range=True)  # stages may also follow the range
        offset = 0
        if self.take("offset"):
            sign = -1 if self.take("-") else 1
            offset = sign * duration_ns(self.next()[1])
        if not span:
            raise ParseError("a range must be positive")
        return query, span, offset

    def variants(self) -> Variants:
        self.next()
        self.need("(")
        parts = [self.expression(0)]
        while self.take(","):
            parts.append(self.expression(0))
        self.need(")")
        self.need("of")
        self.need("(")
        query, span, _ = self.range_body()
        self.need(")")
        return Variants(parts, query, span)

    # -- log level ---------------------------------------------------------------------

    def log_query(self, in_range: bool = False) -> Query:
        self.need("{")
        matchers = []
        while not self.take("}"):
            name = self.next()[1]
            op = self.next()[1]
            if op not in ("=", "!=", "=~", "!~"):
                raise ParseError(f"bad matcher {op!r}")
            matchers.append((name, op, _unquote(self.next()[1])))
            if not self.take(","):
                self.need("}")
                break
        positive = [m for m in matchers if (m[1] == "=" and m[2]) or (m[1] == "=~" and not re.fullmatch(m[2], ""))]
        if not positive:
            raise ParseError("a selector needs at least one matcher that does not match the empty string")
        return Query(matchers, self.stages(in_range))

    def stages(self, in_range: bool = False) -> list:
        found = []
        while True:
            kind, text = self.peek()
            if kind == "op" and text in ("|=", "!=", "|~", "!~", "|>", "!>"):
                self.next()
                parts = [self.filter_part()]
                while self.peek() == ("word", "or"):
                    self.next()
                    parts.append(self.filter_part())
                found.append(LineFilter(text, parts))
            elif kind == "op" and text == "|":
                self.next()
                found.append(self.stage())
            else:
                return found

    def filter_part(self) -> tuple[str, str]:
        if self.take("ip"):
            self.need("(")
            value = _unquote(self.next()[1])
            self.need(")")
            return ("ip", value)
        kind, text = self.next()
        if kind != "string":
            raise ParseError("a line filter needs a string")
        return ("text", _unquote(text))

    def stage(self):
        kind, text = self.peek()
        ahead = self.peek(1)
        compares = ahead[0] == "op" and ahead[1] in ("=", "!=", "=~", "!~", "==", ">", ">=", "<", "<=")
        if kind == "word" and not compares:
            if text in ("json", "logfmt"):
                self.next()
                stage = ParserStage(text)
                while self.peek()[0] == "flag":
                    stage.flags.add(self.next()[1])
                while self.peek()[0] == "word" and (self.peek(1)[1] in ("=", ",") or self.peek(1)[0] in ("op", "end")):
                    name = self.next()[1]
                    stage.params.append((name, _unquote(self.next()[1]) if self.take("=") else name))
                    if not self.take(","):
                        break
                return stage
            if text in ("regexp", "pattern"):
                self.next()
                return ParserStage(text, pattern=_unquote(self.next()[1]))
            if text == "unpack":
                self.next()
                return ParserStage("unpack")
            if text == "decolorize":
                self.next()
                return Decolorize()
            if text == "line_format":
                self.next()
                return LineFormat(_unquote(self.next()[1]))
            if text == "label_format":
                self.next()
                items = []
                while True:
                    target = self.next()[1]
                    if target == "__error__":
                        raise ParseError("__error__ cannot be formatted")
                    self.need("=")
                    k, value = self.next()
                    items.append((target, "template", _unquote(value)) if k == "string" else (target, "label", value))
                    if not self.take(","):
                        return LabelFormat(items)
            if text == "unwrap":
                self.next()
                kind, name = self.next()
                if kind != "word":
                    raise ParseError("unwrap needs a label")
                if self.take("("):
                    label = self.next()[1]
                    self.need(")")
                    if name not in ("duration", "duration_seconds", "bytes"):
                        raise ParseError(f"unknown conversion {name}")
                    return Unwrap(label, name)
                return Unwrap(name)
            if text in ("drop", "keep"):
                self.next()
                items = []
                while True:
                    name, op, value = self.next()[1], "", ""
                    if self.peek()[1] in ("=", "!=", "=~", "!~"):
                        op = self.next()[1]
                        value = _unquote(self.next()[1])
                    items.append((name, op, value))
                    if not self.take(","):
                        return DropKeep(text, items)
        return self.label_or()

    def label_or(self):
        left = self.label_and()
        while self.peek() == ("word", "or"):
            self.next()
            left = AndOr("or", left, self.label_and())
        return left

    def label_and(self):
        left = self.label_atom()
        while self.peek() == ("word", "and") or self.peek() == ("op", ",") or (
            self.peek()[0] == "word" and self.peek(1)[0] == "op" and self.peek(1)[1] in ("=", "!=", "=~", "!~", "==", ">", ">=", "<", "<=")
        ):
            if self.peek()[1] in ("and", ","):
                self.next()
            left = AndOr("and", left, self.label_atom())
        return left

    def label_atom(self):
        if self.take("("):
            inner = self.label_or()
            self.need(")")
            return inner
        name = self.next()[1]
        op = self.next()[1]
        if op not in ("=", "!=", "=~", "!~", "==", ">", ">=", "<", "<="):
            raise ParseError(f"bad comparison {op!r}")
        if self.peek()[1] == "ip":
            self.next()
            self.need("(")
            value = _unquote(self.next()[1])
            self.need(")")
            return LabelFilter(name, op, "ip", value)
        sign = -1 if self.take("-") else 1
        kind, text = self.next()
        if kind == "string":
            return LabelFilter(name, op, "text", _unquote(text))
        op = "==" if op == "=" else op
        if kind == "number":
            return LabelFilter(name, op, "number", sign * float(text))
        if kind == "unit":
            return LabelFilter(name, op, "duration", sign * duration_ns(text) / 1e9)
        if kind == "bytes":
            n, unit = re.fullmatch(r"([\d.]+)(\D+)", text).groups()
            return LabelFilter(name, op, "bytes", float(n) * BYTES[unit.lower()])
        raise ParseError(f"bad value {text!r}")


def parse(text: str):
    return Parser(text).parse()
