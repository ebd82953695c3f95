"""PromQL text to a small tree of tuples and dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

MAX_TEXT = 131_072

# fixed values: names of the language
AGGREGATES = {
    "sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "topk", "bottomk", "quantile",
    "count_values", "limitk", "limit_ratio",
}
WITH_PARAM = {"topk", "bottomk", "quantile", "count_values", "limitk", "limit_ratio"}
COMPARISONS = {"==", "!=", ">", "<", ">=", "<="}
SETS = {"and", "or", "unless"}
_LEVELS = [("or",), ("and", "unless"), ("==", "!=", "<=", "<", ">=", ">"), ("+", "-"), ("*", "/", "%", "atan2"), ("^",)]
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}


class ParseError(ValueError):
    pass


@dataclass
class Number:
    value: float


@dataclass
class Text:
    value: str


@dataclass
class Selector:
    name: str | None
    matchers: list[tuple[str, str, str]]
    range_ms: Any = None
    offset_ms: Any = 0
    at: Any = None  # ms, "start", "end" or None
    modifier: str | None = None  # anchored, smoothed


@dataclass
class Subquery:
    expr: Any
    range_ms: Any
    step_ms: Any
    offset_ms: Any = 0
    at: Any = None


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Aggregate:
    op: str
    expr: Any
    param: Any = None
    without: bool = False
    labels: list[str] | None = None


@dataclass
class Binary:
    op: str
    left: Any
    right: Any
    bool_: bool = False
    on: bool | None = None  # True: on, False: ignoring
    labels: list[str] = field(default_factory=list)
    group: str | None = None  # left, right
    include: list[str] = field(default_factory=list)
    fill: dict[str, float] = field(default_factory=dict)


@dataclass
class Negate:
    expr: Any


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      |(?P<duration>\d+(?:ms|[smhdwy])(?:\d+(?:ms|[smhdwy]))*(?![A-Za-z0-9_]))
      |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?:[iI][nN][fF]|[nN][aA][nN])(?![A-Za-z0-9_:]))
      |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)
      |(?P<word>[A-Za-z_:][A-Za-z0-9_:]*)
      |(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^()\[\]{},=<>:@])""",
    re.X,
)


def duration_ms(text: str) -> int:
    return sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)(ms|[smhdwy])", text))


def _unquote(text: str) -> str:
    if text[0] == "`":
        return text[1:-1]
    simple = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}

    def turn(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xuU":
            return chr(int(x[1:], 16))
        if x[0].isdigit():
            return chr(int(x, 8))
        if x not in simple:
            raise ParseError(f"unknown escape \\{x}")
        return simple[x]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", turn, text[1:-1], flags=re.S)


class Parser:
    """``clock``: start, end and step of the query (ms), for duration expressions."""

    def __init__(self, text: str, clock: dict[str, int] | None = None):
        if len(text.encode()) > MAX_TEXT:
            raise ParseError("the query is too long")
        self.tokens: list[tuple[str, str]] = []
        at = depth = 0
        while at < len(text):
            if depth and text[at] == ":":  # inside [ ] a colon is no part of a name
                self.tokens.append(("op", ":"))
                at += 1
                continue
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected character at {at}: {text[at]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            depth += (m[0] == "[") - (m[0] == "]")
            at = m.end()
        self.at, self.clock = 0, clock or {"start": 0, "end": 0, "step": 0}

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def take(self, text: str) -> bool:
        if self.peek()[0] in ("op", "word") and self.peek()[1].lower() == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ParseError(f"expected {text!r}, found {self.peek()[1]!r}")

    def parse(self):
        found = self.expression(0)
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r}")
        return found

    def expression(self, level: int):
        if level == len(_LEVELS):
            return self.unary()
        if _LEVELS[level] == ("^",):
            left = self.unary()
            if self.take("^"):
                return self.binary("^", left, lambda: self.expression(level))
            return left
        left = self.expression(level + 1)
        while self.peek()[0] in ("op", "word") and self.peek()[1].lower() in _LEVELS[level]:
            op = self.next()[1].lower()
            if op in "<>" and self.peek() == ("op", "/"):  # trims
                self.next()
                op += "/"
            left = self.binary(op, left, lambda: self.expression(level + 1))
        return left

    def binary(self, op: str, left, right):
        node = Binary(op, left, None)
        node.bool_ = self.take("bool")
        if node.bool_ and op not in COMPARISONS:
            raise ParseError("bool is only for comparisons")
        for word, on in (("on", True), ("ignoring", False)):
            if self.take(word):
                node.on, node.labels = on, self.names()
        for side in ("left", "right"):
            if self.take(f"group_{side}"):
                if op in SETS:
                    raise ParseError("set operators take no grouping")
                node.group = side
                node.include = self.names() if self.peek() == ("op", "(") else []
        for word, sides in (("fill", ("left", "right")), ("fill_left", ("left",)), ("fill_right", ("right",))):
            if self.take(word):
                self.need("(")
                value = self.signed()
                self.need(")")
                node.fill |= {side: value for side in sides}
        node.right = right()
        return node

    def signed(self) -> float:
        sign = -1.0 if self.take("-") else 1.0
        return sign * float(self.next()[1])

    def names(self) -> list[str]:
        self.need("(")
        found = []
        while not self.take(")"):
            kind, text = self.next()
            if kind not in ("word", "string", "duration", "number"):
                raise ParseError(f"expected a label, found {text!r}")
            found.append(_unquote(text) if kind == "string" else text)
            if not self.take(","):
                self.need(")")
                break
        return found

    def unary(self):
        if self.take("-"):
            inner = self.expression(len(_LEVELS) - 1)
            return Number(-inner.value) if isinstance(inner, Number) else Negate(inner)
        if self.take("+"):
            return self.expression(len(_LEVELS) - 1)
        return self.postfix(self.primary())

    def postfix(self, node):
        while True:
            if self.peek() == ("op", "["):
                self.next()
                span = self.duration()
                if self.take(":"):
                    step = None if self.peek() == ("op", "]") else self.duration()
                    self.need("]")
                    node = Subquery(node, span, step)
                else:
                    self.need("]")
                    if not isinstance(node, Selector) or node.range_ms is not None:
                        raise ParseError("ranges are only allowed for vector selectors")
                    node.range_ms = span
            elif self.take("offset"):
                if not isinstance(node, (Selector, Subquery)):
                    raise ParseError("offset needs a selector or subquery")
                node.offset_ms = self.duration(signed=True)
            elif self.take("@"):
                if not isinstance(node, (Selector, Subquery)):
                    raise ParseError("@ needs a selector or subquery")
                if self.peek()[1] in ("start", "end"):
                    node.at = self.next()[1]
                    self.need("(")
                    self.need(")")
                else:
                    node.at = round(self.signed() * 1000)
            elif isinstance(node, Selector) and self.peek()[1] in ("anchored", "smoothed"):
                node.modifier = self.next()[1]
            else:
                return node

    def duration(self, signed: bool = False) -> int:
        """A duration literal, or an expression over durations, numbers (seconds) and the
        query's own step(), range(), start(), end()."""

        def atom() -> float:
            if self.take("-"):
                return -atom()
            if self.take("+"):
                return atom()
            if self.take("("):
                x = add()
                self.need(")")
                return x
            kind, text = self.next()
            if kind == "duration":
                return duration_ms(text)
            if kind == "number":
                return float(text) * 1000
            if kind == "word" and text in ("step", "range", "start", "end", "min", "max", "min_of", "max_of"):
                self.need("(")
                if text.startswith(("min", "max")):
                    a = add()
                    self.need(",")
                    b = add()
                    self.need(")")
                    return min(a, b) if text.startswith("min") else max(a, b)
                self.need(")")
                return self.clock["end"] - self.clock["start"] if text == "range" else self.clock[text]
            raise ParseError(f"bad duration {text!r}")

        def power() -> float:
            x = atom()
            if self.take("^"):
                return (x / 1000) ** (power() / 1000) * 1000
            return x

        def times() -> float:
            x = power()
            while self.peek()[1] in ("*", "/", "%"):
                op, y = self.next()[1], power()
                if op != "*" and y == 0:
                    raise ParseError("division by zero in a duration")
                x = x * y / 1000 if op == "*" else x / y * 1000 if op == "/" else x % y
            return x

        def add() -> float:
            x = times()
            while self.peek()[1] in ("+", "-"):
                x = x + times() if self.next()[1] == "+" else x - times()
            return x

        # an offset binds one operand only: a + after it belongs to the query
        value = round(atom() if signed else add())
        if not signed and value <= 0:
            raise ParseError("a duration must be positive")
        return value

    def primary(self):
        kind, text = self.next()
        low = text.lower()
        if kind == "op" and text == "(":
            inner = self.expression(0)
            self.need(")")
            return inner
        if kind == "op" and text == "{":
            self.at -= 1
            return self.selector(None)
        if kind == "number":
            return Number(float(int(text, 16)) if low.startswith("0x") else float(text))
        if kind == "duration":
            return Number(duration_ms(text) / 1000)
        if kind == "string":
            return Text(_unquote(text))
        if kind != "word":
            raise ParseError(f"unexpected {text or 'end of query'!r}")
        if low in AGGREGATES and (self.peek() == ("op", "(") or self.peek()[1].lower() in ("by", "without")):
            return self.aggregate(low)
        if self.peek() == ("op", "("):
            self.next()
            args = []
            while not self.take(")"):
                args.append(self.expression(0))
                if not self.take(","):
                    self.need(")")
                    break
            return Call(text, args)
        return self.selector(text)

    def aggregate(self, op: str):
        node = Aggregate(op, None)

        def grouping() -> None:
            for word in ("by", "without"):
                if self.take(word):
                    node.without, node.labels = word == "without", self.names()

        grouping()
        self.need("(")
        args = [self.expression(0)]
        while self.take(","):
            args.append(self.expression(0))
        self.need(")")
        if node.labels is None:
            grouping()
        if len(args) != 1 + (op in WITH_PARAM):
            raise ParseError(f"{op} takes {1 + (op in WITH_PARAM)} argument(s)")
        node.expr = args[-1]
        node.param = args[0] if op in WITH_PARAM else None
        return node

    def selector(self, name: str | None) -> Selector:
        matchers: list[tuple[str, str, str]] = []
        if self.take("{"):
            while not self.take("}"):
                kind, text = self.next()
                if kind == "string" and self.peek()[1] in (",", "}"):
                    name = _unquote(text)
                else:
                    label = _unquote(text) if kind == "string" else text
                    op = self.next()[1]
                    if op not in ("=", "!=", "=~", "!~"):
                        raise ParseError(f"bad matcher {op!r}")
                    kind, value = self.next()
                    if kind != "string":
                        raise ParseError("a matcher needs a string")
                    matchers.append((label, op, _unquote(value)))
                if not self.take(","):
                    self.need("}")
                    break
        named = [m for m in matchers if m[0] == "__name__"]
        if name is not None and named:
            raise ParseError("metric name must not be set twice")
        if name is None and not any(
            (op == "=" and v) or (op == "!=" and not v) or (op == "=~" and not re.fullmatch(v, "")) or (op == "!~" and re.fullmatch(v, ""))
            for _, op, v in matchers
        ):
            raise ParseError("a selector needs a matcher that does not match the empty string")
        return Selector(name, matchers)


def parse(text: str, clock: dict[str, int] | None = None):
    return Parser(text, clock).parse()
