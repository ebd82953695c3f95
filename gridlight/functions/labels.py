"""Label sets: maps for access, canonical JSON strings as join and group keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_key(labels: Column) -> Column:
    """Canonical text of a label map (maps themselves can be neither joined nor sorted)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def of_key(key: Column) -> Column:
    """The label map of a canonical text.  Aggregates group by the text and read the map
    off it afterwards: a map among the aggregates would rule out hash aggregation."""
    return F.from_json(key, "map<string,string>")


def _names(names) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def keep(labels: Column, names) -> Column:
    if not names:
        return no_labels()
    return F.map_filter(labels, lambda k, v: F.array_contains(_names(names), k))


def remove(labels: Column, names) -> Column:
    if not names:
        return labels
    return F.map_filter(labels, lambda k, v: ~F.array_contains(_names(names), k))


def no_labels() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv]) if pairs else no_labels()


def put(labels: Column, name: str, value: Column) -> Column:
    """Set a label; an empty or null value deletes it."""
    rest = remove(labels, [name])
    return F.when(F.coalesce(value, F.lit("")) == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), F.coalesce(value, F.lit("")))))


def get(labels: Column, name: str) -> Column:
    """An absent label is the empty string."""
    return F.coalesce(F.element_at(labels, F.lit(name)), F.lit(""))


_FORBIDDEN = re.compile(r"\(\?[=!]|\(\?<[=!]|\\[1-9]|[*+?}]\+|\(\?>")


def java_regex(pattern: str) -> str:
    """RE2 syntax as Java's; what RE2 cannot express is refused."""
    if _FORBIDDEN.search(pattern):
        raise ValueError(f"regular expression not supported: {pattern}")
    return pattern.replace("(?P<", "(?<").replace("\\z", "\\z").replace("(?s)", "(?s)")


def anchored(pattern: str, dot_all: bool = False) -> str:
    return f"{'(?s)' if dot_all else ''}^(?:{java_regex(pattern)})\\z"


def matches(value: Column, op: str, text: str) -> Column:
    """``=``, ``!=``, ``=~``, ``!~`` on a label value."""
    if op == "=":
        return value == text
    if op == "!=":
        return value != text
    hit = value.rlike(anchored(text))
    return hit if op == "=~" else ~hit


def java_replacement(text: str) -> str:
    """``$1``, ``${1}``, ``$name``, ``${name}``, ``$$`` in Java's replacement syntax."""

    def turn(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() else f"${{{name}}}"

    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)", turn, text.replace("\\", "\\\\"))
