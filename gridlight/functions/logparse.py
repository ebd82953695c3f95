"""Line parsers: native where a Column can say it, Arrow-batched Python for JSON
flattening, logfmt and IP ranges."""

from __future__ import annotations

import ipaddress
import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BAD_NAME = re.compile(r"[^a-zA-Z0-9_]")


@lru_cache(65_536)
def sanitize(name: str) -> str:
    name = _BAD_NAME.sub("_", name.strip())
    return "_" + name if name[:1].isdigit() else name


def _scalar(value) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    return None if value is None or isinstance(value, list) else str(value)


class _Raw(str):
    """A number as it is written."""


def _loads(line: str):
    return json.loads(line, parse_float=_Raw, parse_int=_Raw)


def flatten(line: str | None) -> str | None:
    """JSON object -> flat JSON object of strings; None when the line is no object."""
    try:
        value = _loads(line or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    flat: dict[str, str] = {}

    def walk(prefix: str, node: dict) -> None:
        for k, v in node.items():
            name = sanitize(f"{prefix}_{k}" if prefix else k)
            if isinstance(v, dict):
                walk(name, v)
            elif (text := _scalar(v)) is not None and name:
                flat.setdefault(name, text)

    walk("", value)
    return json.dumps(flat)


#: One step over a line: a key with its value (quoted, open-quoted or plain), a key that a
#: quote ends, or a stray character.
_PAIR = re.compile(
    r"""[\x00-\x20]*(?:([^\x00-\x20="]+)(?:=(?:("(?:[^"\\]|\\.)*")|(")|([^\x00-\x20]*))|(")|)|(["=]))""", re.DOTALL
)


def logfmt(line: str | None, strict: bool = False, keep_empty: bool = False) -> str | None:
    """logfmt pairs -> flat JSON object of strings; None for a bad line when strict."""
    flat: dict[str, str] = {}
    for key, quoted, open_, plain, cut, stray in _PAIR.findall(line or ""):
        if cut or stray or open_:
            if strict:
                return None
            if open_:
                break
            continue
        if quoted:
            try:
                plain = json.loads(quoted)
            except ValueError:
                plain = quoted[1:-1]
        if plain or keep_empty:
            flat.setdefault(sanitize(key), plain)
    return json.dumps(flat)


def _udf(f):
    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(f)

    return run


def flatten_column(line: Column) -> Column:
    return _udf(flatten)(line)


def logfmt_column(line: Column, strict: bool, keep_empty: bool) -> Column:
    return _udf(lambda x: logfmt(x, strict, keep_empty))(line)


def pattern_regex(pattern: str) -> tuple[str, list[str]]:
    """``<name> literal <_>`` as an anchored regex with one group per named capture."""
    parts = re.split(r"(<\w+>)", pattern)
    names, out = [], []
    if not any(p.startswith("<") for p in parts if p):
        raise ValueError("a pattern needs a capture")
    for i, p in enumerate(parts):
        if not re.fullmatch(r"<\w+>", p or ""):
            out.append("" if not p else "\\Q" + p + "\\E")
            continue
        if i >= 2 and not parts[i - 1] and re.fullmatch(r"<\w+>", parts[i - 2]):
            raise ValueError("captures need a literal between them")
        last = i == len(parts) - 2 and not parts[-1]
        body = ".*" if last else ".*?"
        if p == "<_>":
            out.append(f"(?:{body})")
        else:
            names.append(p[1:-1])
            out.append(f"({body})")
    head = "^" if not parts[0] else "^.*?"
    return "(?s)" + head + "".join(out), names


_IP = re.compile(r"(?<![\w.:])(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f.]*|[0-9A-Fa-f:]*::[0-9A-Fa-f:.]*)(?![\w:])")


def ip_range(text: str) -> tuple[int, int, int]:
    """(version, first, last) of an address, ``a-b`` range or CIDR block."""
    if "-" in text:
        a, b = (ipaddress.ip_address(x.strip()) for x in text.split("-"))
        return a.version, int(a), int(b)
    net = ipaddress.ip_network(text, strict=False)
    return net.version, int(net[0]), int(net[-1])


def ip_column(line: Column, pattern: str, whole: bool = False) -> Column:
    """Whether any address in the text (or the text itself) lies in the range; what is no
    address does not."""
    version, low, high = ip_range(pattern)
    if version == 4 and not whole:
        found = F.regexp_extract_all(line, F.lit(r"(?<![\d.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\d.])"), F.lit(1))
        number = lambda x: F.aggregate(F.split(x, r"\."), F.lit(0).cast("long"), lambda s, p: s * 256 + p.cast("long"))
        valid = lambda x: F.forall(F.split(x, r"\."), lambda p: p.cast("long") <= 255)
        return F.exists(found, lambda x: valid(x) & number(x).between(low, high))

    @F.pandas_udf("boolean")
    def run(lines: pd.Series) -> pd.Series:
        def hit(text: str | None) -> bool:
            for token in [text or ""] if whole else _IP.findall(text or ""):
                try:
                    a = ipaddress.ip_address(token)
                except ValueError:
                    continue
                if a.version == version and low <= int(a) <= high:
                    return True
            return False

        return lines.map(hit)

    return run(line)


_D = r"(\d+(?:\.\d+)?)(ns|us|µs|μs|ms|s|m|h|d|w)"


def duration_seconds(text: Column) -> Column:
    """Go duration as seconds; null when it is none."""
    valid = text.rlike(rf"^[-+]?(?:{_D})+$")
    numbers, units = F.regexp_extract_all(text, F.lit(_D), F.lit(1)), F.regexp_extract_all(text, F.lit(_D), F.lit(2))
    scale = F.create_map(*[F.lit(x) for kv in (("ns", 1e-9), ("us", 1e-6), ("µs", 1e-6), ("μs", 1e-6), ("ms", 1e-3), ("s", 1.0), ("m", 60.0), ("h", 3600.0), ("d", 86400.0), ("w", 604800.0)) for x in kv])
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.element_at(scale, u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(text == "0", 0.0).when(valid, F.when(text.startswith("-"), -total).otherwise(total))


def byte_count(text: Column) -> Column:
    """Byte quantity such as ``5 KiB``; null when it is none."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(low, r"^[0-9.]+\s*([kmgtpe]?i?b?)$", 1)
    power = F.instr(F.lit("kmgtpe"), F.substring(unit, 1, 1))
    base = F.when(unit.contains("i"), 1024.0).otherwise(1000.0)
    scale = F.when(unit.isin("", "b"), 1.0).otherwise(F.pow(base, power))
    return F.when(low.rlike(r"^[0-9]+(?:\.[0-9]+)?\s*(?:[kmgtpe]i?)?b?$"), number * scale)
