"""Go text templates over a log line's labels.

Templates of plain fields compile to Columns (``compile_columns``); the rest runs in an
interpreter, Arrow-batched.  ``Template(text).run(dot, line, ts_ns)`` gives the text and
raises ``TemplateError`` where Go would.
"""

from __future__ import annotations

import base64
import html
import json
import math
import re
import urllib.parse
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    pass


_WORD = re.compile(r'\s*(?:(?P<str>"(?:\\.|[^"\\])*"|`[^`]*`)|(?P<num>[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?(?![\w]))|(?P<sym>:=|=|[(),|])|(?P<field>\$\w*(?:\.\w+)*|\.\w+(?:\.\w+)*|\.)|(?P<word>\w+))')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m or m.end() == at:
            raise TemplateError(f"unexpected {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _string(token: str) -> str:
    if token[0] == "`":
        return token[1:-1]
    try:
        return json.loads(token)
    except ValueError as e:
        raise TemplateError(f"bad string {token}") from e


# -- values ------------------------------------------------------------------------------


def _text(x) -> str:
    if x is None:
        return "<no value>"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        if math.isnan(x):
            return "NaN"
        if math.isinf(x):
            return "+Inf" if x > 0 else "-Inf"
        e = math.floor(math.log10(abs(x))) if x else 0
        if e < -4 or e >= 21:
            mantissa, exp = repr(x).split("e") if "e" in repr(x) else f"{x:e}".split("e")
            if "e" not in repr(x):
                mantissa = mantissa.rstrip("0").rstrip(".")
            return f"{mantissa.removesuffix('.0')}e{exp[0] if exp[0] in '+-' else '+'}{exp.lstrip('+-').zfill(2)}"
        return repr(x).removesuffix(".0") if "e" not in repr(x) else f"{x:.0f}"
    if isinstance(x, datetime):
        return x.strftime("%Y-%m-%d %H:%M:%S %z %Z")
    if isinstance(x, (list, tuple)):
        return "[" + " ".join(map(_text, x)) + "]"
    if isinstance(x, dict):
        return "map[" + " ".join(f"{k}:{_text(v)}" for k, v in sorted(x.items())) + "]"
    return str(x)


def _truth(x) -> bool:
    return bool(x) if not isinstance(x, float) else x != 0


def _int(x) -> int:
    if isinstance(x, (bool, int)):
        return int(x)
    if isinstance(x, float):
        return int(x)
    try:
        return int(str(x), 0)
    except ValueError:
        try:
            return int(float(x))
        except (ValueError, OverflowError, TypeError):
            return 0


def _float(x) -> float:
    try:
        return float(x)
    except (ValueError, TypeError):
        return 0.0


def _duration(x) -> float:
    from ..plans.logql_parser import duration_ns

    if not re.fullmatch(r"[-+]?(?:\d+(?:\.\d+)?(?:ns|us|µs|μs|ms|s|m|h|d|w))+|0", str(x)):
        raise TemplateError(f"invalid duration {x!r}")
    return (-1 if str(x).startswith("-") else 1) * duration_ns(str(x)) / 1e9


def _bytes(x) -> float:
    from ..plans.logql_parser import BYTES

    m = re.fullmatch(r"\s*([\d.]+)\s*([a-zA-Z]*)\s*", str(x))
    unit = (m[2].lower() if m else "?") or "b"
    unit = unit if unit.endswith("b") else unit + "b"
    if unit not in BYTES:
        raise TemplateError(f"invalid bytes {x!r}")
    return float(m[1]) * BYTES[unit]


def _guard(f):
    def run(*args):
        try:
            return f(*args)
        except ZeroDivisionError as e:
            raise TemplateError("division by zero") from e

    return run


def _quotient(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _fold(f, kind):
    def run(*args):
        out = kind(args[0])
        for x in args[1:]:
            out = f(out, kind(x))
        return out

    return _guard(run)


# fixed values: elements of Go's reference time
_LAYOUT = [
    ("2006", "%Y"), ("January", "%B"), ("Jan", "%b"), ("Monday", "%A"), ("Mon", "%a"), ("MST", "%Z"), ("-07:00", "{colon}"),
    ("Z07:00", "{zulu}"), ("-0700", "%z"), (".000000000", "{ns}"), (".000000", "{us}"), (".000", "{ms}"), ("01", "%m"),
    ("02", "%d"), ("15", "%H"), ("03", "%I"), ("04", "%M"), ("05", "%S"), ("06", "%y"), ("PM", "%p"), ("pm", "{pm}"),
    ("_2", "{_d}"), ("1", "{m}"), ("2", "{d}"), ("3", "{h}"), ("4", "{mi}"), ("5", "{s}"),
]
_LAYOUT_RE = re.compile("|".join(re.escape(a) for a, _ in _LAYOUT))
_LAYOUT_OF = dict(_LAYOUT)


def go_date(layout: str, t: datetime, ns: int = 0) -> str:
    zone = t.strftime("%z") or "+0000"
    colon = zone[:3] + ":" + zone[3:5]
    special = {
        "{colon}": colon, "{zulu}": "Z" if zone == "+0000" else colon, "{ns}": f".{t.microsecond * 1000 + ns:09d}",
        "{us}": f".{t.microsecond:06d}", "{ms}": f".{t.microsecond // 1000:03d}", "{pm}": t.strftime("%p").lower(),
        "{_d}": f"{t.day:2d}", "{m}": str(t.month), "{d}": str(t.day), "{h}": str((t.hour - 1) % 12 + 1), "{mi}": str(t.minute), "{s}": str(t.second),
    }
    return _LAYOUT_RE.sub(lambda m: special[_LAYOUT_OF[m[0]]] if _LAYOUT_OF[m[0]][0] == "{" else t.strftime(_LAYOUT_OF[m[0]]), layout)


def _to_date(layout: str, text: str, zone: str = "UTC") -> datetime:
    plain = {"{m}": "%m", "{d}": "%d", "{h}": "%I", "{mi}": "%M", "{s}": "%S", "{colon}": "%z", "{zulu}": "%z", "{us}": ".%f", "{ms}": ".%f", "{ns}": ".%f", "{_d}": "%d", "{pm}": "%p"}
    pattern = _LAYOUT_RE.sub(lambda m: plain.get(_LAYOUT_OF[m[0]], _LAYOUT_OF[m[0]]), layout)
    try:
        t = datetime.strptime(text, pattern)
    except ValueError:
        return datetime(1, 1, 1, tzinfo=UTC)
    return t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone))


def _unix_to_time(x) -> datetime:
    text = str(x)
    scale = {5: 1 / 86400, 10: 1, 13: 1e3, 16: 1e6, 19: 1e9}.get(len(text))
    if scale is None:
        raise TemplateError(f"unable to parse time {text!r}")
    return datetime.fromtimestamp(int(text) / scale, UTC)


def _epoch_ns(t: datetime) -> int:
    d = t - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 10**9 + d.microseconds * 1000


def _substr(start, end, s) -> str:
    start, end, s = _int(start), _int(end), _text(s)
    if start < 0:
        return s[:end]
    return s[start:] if end < 0 or end > len(s) else s[start:end]


def _trunc(n, s) -> str:
    n, s = _int(n), _text(s)
    return s[n:] if n < 0 and len(s) + n > 0 else s[:n] if 0 <= n < len(s) else s


def _align(n, s, left: bool) -> str:
    n, s = _int(n), _text(s)
    if n < 0:
        return s
    return s[:n].ljust(n) if left else (s[-n:] if n else "").rjust(n)


def _compare(op, *args) -> bool:
    a, *rest = args
    if op == "eq":
        return any(type(a) is type(b) and a == b for b in rest)
    b = rest[0]
    if isinstance(a, str) != isinstance(b, str) or isinstance(a, bool) != isinstance(b, bool):
        raise TemplateError("incompatible types for comparison")
    return {"ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]


def _index(x, *keys):
    for k in keys:
        if isinstance(x, dict):
            x = x.get(_text(k), "")
        else:
            if not 0 <= _int(k) < len(x):
                raise TemplateError("index out of range")
            x = ord(x[_int(k)]) if isinstance(x, str) else x[_int(k)]
    return x


def _printf(form, *args) -> str:
    rest = list(args)

    def put(m: re.Match) -> str:
        flags, verb = m[1], m[2]
        if verb == "%":
            return "%"
        if not rest:
            return f"%!{verb}(MISSING)"
        x = rest.pop(0)
        try:
            if verb in "dxXobc":
                return f"%{flags}{verb}" % (x if isinstance(x, int) else _bad(verb, x))
            if verb in "feEgG":
                return f"%{flags}{verb}" % (x if isinstance(x, (int, float)) else _bad(verb, x))
            if verb == "q":
                return json.dumps(_text(x), ensure_ascii=False)
            if verb == "t":
                return _text(bool(x))
            if verb == "T":
                return {str: "string", int: "int", float: "float64", bool: "bool"}.get(type(x), "interface {}")
            return f"%{flags}s" % _text(x)
        except TypeError:
            return f"%!{verb}({_text(x)})"

    return re.sub(r"%([-+ #0]*\d*(?:\.\d+)?)([a-zA-Z%])", put, _text(form))


def _bad(verb, x):
    raise TypeError(verb)


def _go_replacement(text: str) -> str:
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: rf"\g<{m[1] or m[2]}>", text.replace("\\", "\\\\"))


FUNCTIONS = {
    "not": lambda x: not _truth(x), "len": lambda x: len(x), "index": _index,
    "slice": lambda x, *i: x[_int(i[0]) if i else 0 : _int(i[1]) if len(i) > 1 else None],
    "print": lambda *a: "".join(map(_text, a)), "println": lambda *a: " ".join(map(_text, a)) + "\n", "printf": _printf,
    "html": lambda *a: html.escape("".join(map(_text, a))).replace("&#x27;", "&#39;").replace("&quot;", "&#34;"),
    "js": lambda *a: "".join(map(_text, a)).replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"').replace("<", "\\u003C").replace(">", "\\u003E").replace("&", "\\u0026").replace("=", "\\u003D").replace("\n", "\\u000A"),
    "urlquery": lambda *a: urllib.parse.quote_plus("".join(map(_text, a))),
    **{op: (lambda op: lambda *a: _compare(op, *a))(op) for op in ("eq", "ne", "lt", "le", "gt", "ge")},
    "ToLower": lambda s: _text(s).lower(), "ToUpper": lambda s: _text(s).upper(), "lower": lambda s: _text(s).lower(), "upper": lambda s: _text(s).upper(),
    "Replace": lambda s, a, b, n: _text(s).replace(a, b, _int(n)), "replace": lambda a, b, s: _text(s).replace(a, b),
    "Trim": lambda s, c: _text(s).strip(c), "TrimLeft": lambda s, c: _text(s).lstrip(c), "TrimRight": lambda s, c: _text(s).rstrip(c),
    "TrimPrefix": lambda s, p: _text(s).removeprefix(p), "TrimSuffix": lambda s, p: _text(s).removesuffix(p), "TrimSpace": lambda s: _text(s).strip(),
    "trim": lambda s: _text(s).strip(), "trimAll": lambda c, s: _text(s).strip(c), "trimPrefix": lambda p, s: _text(s).removeprefix(p), "trimSuffix": lambda p, s: _text(s).removesuffix(p),
    "title": lambda s: re.sub(r"(?<![\w'])\w", lambda m: m[0].upper(), _text(s)), "trunc": _trunc, "substr": _substr,
    "contains": lambda a, s: a in _text(s), "hasPrefix": lambda a, s: _text(s).startswith(a), "hasSuffix": lambda a, s: _text(s).endswith(a),
    "indent": lambda n, s: " " * _int(n) + _text(s).replace("\n", "\n" + " " * _int(n)), "nindent": lambda n, s: "\n" + " " * _int(n) + _text(s).replace("\n", "\n" + " " * _int(n)),
    "repeat": lambda n, s: _text(s) * max(0, _int(n)), "alignLeft": lambda n, s: _align(n, s, True), "alignRight": lambda n, s: _align(n, s, False),
    "count": lambda p, s: len(re.findall(p, _text(s))), "urlencode": lambda s: urllib.parse.quote_plus(_text(s)), "urldecode": lambda s: urllib.parse.unquote_plus(_text(s)),
    "regexReplaceAll": lambda p, s, r: re.sub(p, _go_replacement(r), _text(s)), "regexReplaceAllLiteral": lambda p, s, r: re.sub(p, lambda m: r, _text(s)),
    "b64enc": lambda s: base64.b64encode(_text(s).encode()).decode(), "b64dec": lambda s: base64.b64decode(_text(s), validate=True).decode("utf-8", "replace"),
    "default": lambda d, s=None: s if _truth(s) else d,
    "int": _int, "float64": _float, "add": _fold(lambda a, b: a + b, _int), "sub": _fold(lambda a, b: a - b, _int), "mul": _fold(lambda a, b: a * b, _int),
    "div": _fold(_quotient, _int), "mod": _fold(lambda a, b: a - b * _quotient(a, b), _int),
    "addf": _fold(lambda a, b: a + b, _float), "subf": _fold(lambda a, b: a - b, _float), "mulf": _fold(lambda a, b: a * b, _float), "divf": _fold(lambda a, b: a / b, _float),
    "max": lambda *a: max(map(_int, a)), "min": lambda *a: min(map(_int, a)), "maxf": lambda *a: max(map(_float, a)), "minf": lambda *a: min(map(_float, a)),
    "ceil": lambda x: float(math.ceil(_float(x))), "floor": lambda x: float(math.floor(_float(x))),
    "round": lambda x, p=0: math.floor(_float(x) * 10 ** _int(p) + 0.5) / 10 ** _int(p),
    "bytes": _bytes, "duration": _duration, "duration_seconds": _duration,
    "unixEpoch": lambda t: str(_epoch_ns(t) // 10**9), "unixEpochMillis": lambda t: str(_epoch_ns(t) // 10**6), "unixEpochNanos": lambda t: str(_epoch_ns(t)),
    "unixToTime": _unix_to_time, "toDate": _to_date, "toDateInZone": lambda f, z, s: _to_date(f, s, z), "date": lambda f, t: go_date(f, t),
    "fromJson": lambda s: json.loads(_text(s)), "call": lambda f, *a: f(*a),
}


class Template:
    def __init__(self, text: str):
        parts = re.split(r"\{\{(-\s)?(.*?)(\s-)?\}\}", text, flags=re.S)
        nodes: list[tuple[str, str]] = []
        strip_next = False
        for i in range(0, len(parts), 4):
            raw = parts[i]
            if strip_next:
                raw = raw.lstrip()
            if i + 1 < len(parts) and parts[i + 1]:
                raw = raw.rstrip()
            if raw:
                nodes.append(("text", raw))
            if i + 2 < len(parts):
                action = parts[i + 2].strip()
                strip_next = bool(parts[i + 3])
                if not action.startswith("/*"):
                    nodes.append(("action", action))
        if "{{" in "".join(n for k, n in nodes if k == "text"):
            raise TemplateError("unclosed action")
        self.defined: dict[str, list] = {}
        self.at, self.nodes = 0, nodes
        self.body, end = self._block(set())
        if end:
            raise TemplateError(f"unexpected {{{{{end}}}}}")

    def _block(self, ends: set[str]) -> tuple[list, str]:
        out: list = []
        while self.at < len(self.nodes):
            kind, text = self.nodes[self.at]
            self.at += 1
            if kind == "text":
                out.append(("text", text))
                continue
            word = text.split(None, 1)[0] if text else ""
            rest = text[len(word) :].strip()
            if word in ("end", "else"):
                if word not in ends:
                    raise TemplateError(f"unexpected {word}")
                return out, text
            if word in ("if", "with", "range"):
                out.append(self._branch(word, rest))
            elif word in ("define", "block"):
                name = _string(_tokens(rest)[0][1])
                self.defined[name], _ = self._block({"end"})
                if word == "block":
                    out.append(("template", name, self._pipeline(rest.split(None, 1)[1])))
            elif word == "template":
                tokens = rest.split(None, 1)
                out.append(("template", _string(tokens[0]), self._pipeline(tokens[1]) if len(tokens) > 1 else None))
            elif word in ("break", "continue"):
                out.append((word,))
            else:
                out.append(("pipe", self._pipeline(text)))
        if ends:
            raise TemplateError("missing end")
        return out, ""

    def _branch(self, word: str, rest: str):
        cond = self._pipeline(rest)
        body, end = self._block({"end", "else"})
        other: list = []
        if end.startswith("else"):
            tail = end[4:].strip()
            if tail:
                kind = tail.split(None, 1)[0]
                other = [self._branch(kind, tail[len(kind) :].strip())]
            else:
                other, _ = self._block({"end"})
        return (word, cond, body, other)

    def _pipeline(self, text: str):
        tokens = _tokens(text)
        names = []
        while tokens and tokens[0][0] == "field" and tokens[0][1].startswith("$") and len(tokens) > 1 and tokens[1][1] in (":=", "=", ","):
            names.append(tokens[0][1])
            mark = tokens[1][1]
            tokens = tokens[2:]
            if mark != ",":
                break
        commands, at = self._commands(tokens, 0)
        if at != len(tokens):
            raise TemplateError("unexpected )")
        return names, commands

    def _commands(self, tokens, at):
        commands, now = [], []
        while at < len(tokens):
            kind, text = tokens[at]
            if text == ")" and kind == "sym":
                break
            at += 1
            if kind == "sym" and text == "(":
                inner, at = self._commands(tokens, at)
                if at >= len(tokens):
                    raise TemplateError("unclosed (")
                at += 1
                now.append(("pipe", inner))
            elif kind == "sym" and text == "|":
                commands.append(now)
                now = []
            elif kind == "str":
                now.append(("value", _string(text)))
            elif kind == "num":
                now.append(("value", int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)))
            elif kind == "field":
                now.append(("field", text))
            elif text in ("true", "false", "nil"):
                now.append(("value", {"true": True, "false": False, "nil": None}[text]))
            else:
                if text not in FUNCTIONS and text not in ("and", "or", "now", "__line__", "__timestamp__"):
                    raise TemplateError(f"function {text!r} not defined")
                now.append(("func", text))
        commands.append(now)
        if any(not c for c in commands):
            raise TemplateError("missing value for command")
        return commands, at

    def run(self, dot: dict, line: str = "", ts_ns: int = 0) -> str:
        out: list[str] = []
        env = {"line": line, "ts": ts_ns, "steps": 0}
        try:
            self._exec(self.body, dot, {"$": dot}, out, env)
        except TemplateError:
            raise
        except _Loop as e:
            raise TemplateError("break or continue outside range") from e
        except Exception as e:
            raise TemplateError(str(e)) from e
        return "".join(out)

    def _exec(self, nodes, dot, names, out, env) -> None:
        for node in nodes:
            env["steps"] += 1
            if env["steps"] > 100_000:
                raise TemplateError("the template runs too long")
            match node:
                case ("text", text):
                    out.append(text)
                case ("pipe", pipe):
                    value = self._assign(pipe, dot, names, env)
                    if not pipe[0]:
                        out.append(_text(value))
                case ("template", name, pipe):
                    if name not in self.defined:
                        raise TemplateError(f"template {name!r} not defined")
                    new = self._assign(pipe, dot, names, env) if pipe else None
                    self._exec(self.defined[name], new, {"$": new}, out, env)
                case ("if", pipe, body, other):
                    inner = dict(names)
                    self._exec(body if _truth(self._assign(pipe, dot, inner, env)) else other, dot, inner, out, env)
                case ("with", pipe, body, other):
                    inner = dict(names)
                    value = self._assign(pipe, dot, inner, env)
                    self._exec(body if _truth(value) else other, value if _truth(value) else dot, inner, out, env)
                case ("range", pipe, body, other):
                    value = self._value(pipe[1], dot, names, env)
                    if isinstance(value, int):
                        value = range(value)
                    items = sorted(value.items()) if isinstance(value, dict) else list(enumerate(value or ()))
                    for k, v in items:
                        inner = dict(names)
                        if len(pipe[0]) == 1:
                            inner[pipe[0][0]] = v
                        elif pipe[0]:
                            inner[pipe[0][0]], inner[pipe[0][1]] = k, v
                        try:
                            self._exec(body, v, inner, out, env)
                        except _Loop as e:
                            if e.args[0] == "break":
                                break
                    if not items:
                        self._exec(other, dot, names, out, env)
                case (("break" | "continue") as word,):
                    raise _Loop(word)

    def _assign(self, pipe, dot, names, env):
        value = self._value(pipe[1], dot, names, env)
        for n in pipe[0]:
            names[n] = value
        return value

    def _value(self, commands, dot, names, env):
        value, has = None, False
        for words in commands:
            head, args = words[0], words[1:]
            if head[0] == "func":
                value = self._apply(head[1], args, (value,) if has else (), dot, names, env)
            else:
                value = self._operand(head, dot, names, env)
                if args or has:
                    raise TemplateError("can't give argument to non-function")
            has = True
        return value

    def _apply(self, name, args, piped, dot, names, env):
        if name in ("and", "or"):
            value = None
            for a in args:
                value = self._operand(a, dot, names, env)
                if _truth(value) == (name == "or"):
                    return value
            return piped[0] if piped else value
        if name == "__line__":
            return env["line"]
        if name == "__timestamp__":
            return datetime.fromtimestamp(env["ts"] // 10**9, UTC).replace(microsecond=env["ts"] % 10**9 // 1000)
        if name == "now":
            return datetime.now(UTC)
        return FUNCTIONS[name](*[self._operand(a, dot, names, env) for a in args], *piped)

    def _operand(self, word, dot, names, env):
        kind, x = word
        if kind == "value":
            return x
        if kind == "pipe":
            return self._value(x, dot, names, env)
        if kind == "func":
            return self._apply(x, [], (), dot, names, env)
        if x == ".":
            return dot
        base, *path = x.split(".")
        value = dot if not base else names.get(base)
        for p in path:
            value = value.get(p, "") if isinstance(value, dict) else ""
        return value


class _Loop(Exception):
    pass


_PIPED = {"ToLower": F.lower, "ToUpper": F.upper, "lower": F.lower, "upper": F.upper}


def compile_columns(text: str, labels: Column, line: Column) -> Column | None:
    """The template as a Column, if it only has fields, ``__line__`` and case functions."""
    parts = re.split(r"(\{\{.*?\}\})", text)
    out = []
    for p in parts:
        if not p.startswith("{{"):
            if "{{" in p:
                return None
            out.append(F.lit(p))
            continue
        m = re.fullmatch(r"\{\{\s*(?:\.(\w+)|__line__)\s*(?:\|\s*(\w+)\s*)?\}\}", p)
        if not m or (m[2] and m[2] not in _PIPED):
            return None
        value = F.coalesce(F.element_at(labels, F.lit(m[1])), F.lit("")) if m[1] else line
        out.append(_PIPED[m[2]](value) if m[2] else value)
    return F.concat(*out) if out else F.lit("")
