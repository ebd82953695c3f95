"""Catalogue and drill-down: labels, series, volumes, patterns, detected fields, tags."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import labels as L
from ..functions import logparse as LP

DAY_NS = 86_400 * 10**9


def label_names(rows: DataFrame) -> DataFrame:
    return rows.select("key", "labels").dropDuplicates(["key"]).select(F.explode(F.map_keys("labels")).alias("name")).distinct()


def label_values(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.element_at("labels", F.lit(name)).alias("value")).where(F.col("value").isNotNull()).distinct()


def series(rows: DataFrame) -> DataFrame:
    keys = [c for c in ("metric", "key") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.first("labels").alias("labels"))


def series_table(rows: DataFrame) -> DataFrame:
    """A row per series with its first and last time: what label and matcher calls read."""
    keys = [c for c in ("metric", "key") if c in rows.columns]
    found = rows.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.withColumn("labels", L.of_key(F.col("key")))


def rollup_ends(lines: DataFrame, width: int) -> DataFrame:
    """key, labels, ts, count, bytes of the lines in (ts - width, ts]."""
    end = (F.col("ts") + F.pmod(-F.col("ts"), F.lit(width))).alias("ts")
    sums = lines.select("key", end, "line").groupBy("key", "ts").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("line")).cast("long").alias("bytes"))
    return sums.withColumn("labels", L.of_key(F.col("key")))


def selectivity(series_rows: DataFrame, matchers: list[tuple[str, str, str]], cap: int) -> DataFrame:
    """matched (at most cap + 1) and whether it is ``over`` the cap: a probe before a wide scan."""
    df = series_rows
    for name, op, value in matchers:
        df = df.where(L.matches(L.get(F.col("labels"), name), op, value))
    few = df.select("key").distinct().limit(cap + 1)
    return few.agg(F.count(F.lit(1)).alias("matched")).withColumn("over", F.col("matched") > cap)


def active_streams(lines: DataFrame, start: int, end: int) -> DataFrame:
    return series(lines.where((F.col("ts") > start) & (F.col("ts") <= end)))


def stats(lines: DataFrame) -> DataFrame:
    """streams, chunks (days of a stream), entries, bytes."""
    per = lines.groupBy("key", (F.col("ts") - F.pmod("ts", F.lit(DAY_NS))).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("b")
    )
    return per.agg(
        F.countDistinct("key").alias("streams"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")
    )


def rollup(lines: DataFrame, step: int) -> DataFrame:
    """key, bucket, count, bytes per step."""
    bucket = (F.col("ts") - F.pmod("ts", F.lit(step))).alias("bucket")
    return lines.groupBy("key", bucket).agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("line")).cast("long").alias("bytes"))


def volume(lines: DataFrame, by: list[str] | None = None, limit: int = 100, mode: str = "series") -> DataFrame:
    """Bytes per label set (restricted to ``by``) or, in mode "labels", per label name."""
    size = F.sum(F.octet_length("line")).alias("bytes")
    if mode == "labels":
        names = F.map_keys(F.col("labels")) if not by else F.map_keys(L.keep(F.col("labels"), by))
        out = lines.select(F.explode(names).alias("name"), "line").groupBy("name").agg(size)
    else:
        labels = F.col("labels") if not by else L.keep(F.col("labels"), by)
        out = lines.select(L.series_key(labels).alias("name"), "line").groupBy("name").agg(size)
    return out.orderBy(F.col("bytes").desc(), "name").limit(limit)


# -- patterns ----------------------------------------------------------------------------


_WRAPPED = re.compile(r"""([\[\](){}<>"',;:.!?]*)(.*?)([\[\](){}<>"',;:.!?]*)""", re.DOTALL)
_KEYED = re.compile(r"([^=:]+[=:])(.+)", re.DOTALL)
_DIGIT, _BLANK = re.compile(r"[0-9]"), re.compile(r"[ \t\n\x0b\f\r]+")


def _cut(text: str, most: int) -> str:
    """At most ``most`` bytes, whole characters."""
    return text if len(text) * 4 <= most else text.encode()[:most].decode(errors="ignore")


def _fragment(x: str) -> str:
    return "<_>" if x and (_DIGIT.search(x) or len(x.encode()) > 64) else x


@lru_cache(65_536)
def _token(t: str) -> str:
    lead, body, tail = _WRAPPED.fullmatch(t).groups()
    keyed = _KEYED.fullmatch(body)
    if keyed and not _DIGIT.search(keyed[1]):
        before, value, after = _WRAPPED.fullmatch(keyed[2]).groups()
        return f"{lead}{keyed[1]}{before}{_fragment(value)}{after}{tail}"
    return lead + _fragment(body) + tail


def template(line: str | None) -> str:
    """Template of a line: of the first KiB's white-space tokens, fragments that hold a digit
    or are longer than 64 bytes become ``<_>``; wrapping punctuation and keys stay."""
    tokens = [t for t in _BLANK.split(_cut(line or "", 1024)) if t]
    return _cut(" ".join(map(_token, tokens[:64])), 512)


@F.pandas_udf(StringType())
def pattern(line: pd.Series) -> pd.Series:
    return line.map(template)


def patterns(lines: DataFrame, step: int, limit: int = 1000) -> DataFrame:
    """pattern, total and its buckets (bucket, count) in time order, most frequent first."""
    bucket = (F.col("ts") - F.pmod("ts", F.lit(step))).alias("bucket")
    counted = lines.select(pattern(F.col("line")).alias("pattern"), bucket).groupBy("pattern", "bucket").agg(F.count(F.lit(1)).alias("count"))
    grouped = counted.groupBy("pattern").agg(F.sum("count").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "count"))).alias("buckets"))
    return grouped.where("pattern <> ''").orderBy(F.col("total").desc(), "pattern").limit(limit)


# -- detection -----------------------------------------------------------------------------

# fixed values: labels that are always shown
STATIC_LABELS = ("cluster", "namespace", "instance", "pod")


def detected_labels(lines: DataFrame) -> DataFrame:
    """label and cardinality; labels of only numbers or UUIDs are left out unless static."""
    values = lines.select("key", "labels").dropDuplicates(["key"]).select(F.explode("labels").alias("label", "value")).distinct()
    plain = values["value"].try_cast("double").isNull() & ~values["value"].rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    out = values.groupBy("label").agg(F.count(F.lit(1)).alias("cardinality"), F.count_if(plain).alias("plain"))
    return out.where((F.col("plain") > 0) | F.col("label").isin(*STATIC_LABELS)).select("label", "cardinality")


def value_type(v: Column) -> Column:
    return (
        F.when(v.rlike(r"^[-+]?\d{1,18}$"), "int").when(v.try_cast("double").isNotNull(), "float")
        .when(F.lower(v).isin("true", "false"), "boolean").when(LP.duration_seconds(v).isNotNull(), "duration")
        .when(LP.byte_count(v).isNotNull(), "bytes").otherwise("string")
    )


def detected_fields(lines: DataFrame, line_limit: int | None = None) -> DataFrame:
    """field, type (of its first value in order), cardinality, parser (json or logfmt)."""
    if line_limit is not None:  # a preview of the newest lines, as the endpoint has it
        lines = lines.orderBy(F.col("ts").desc(), "key", "line").limit(line_limit)
    parsed = lines.select(LP.flatten_column(F.col("line")).alias("j"), LP.logfmt_column(F.col("line"), False, False).alias("l"))
    flat = parsed.select(F.coalesce("j", "l").alias("flat"), F.when(F.col("j").isNotNull(), "json").otherwise("logfmt").alias("parser"))
    each = flat.select("parser", F.explode(F.from_json("flat", "map<string,string>")).alias("field", "value"))
    return each.groupBy("field", "parser").agg(value_type(F.min("value")).alias("type"), F.countDistinct("value").alias("cardinality"))


# -- metrics and traces ---------------------------------------------------------------------


def cardinality(samples: DataFrame, limit: int = 10) -> DataFrame:
    """Top counts: series per metric, values per label, series per label pair."""
    s = samples.select("metric", "key", "labels").dropDuplicates(["metric", "key"])
    pairs = s.select("key", F.explode("labels").alias("name", "value"))
    tops = [
        ("seriesCountByMetricName", s.groupBy(F.col("metric").alias("name")).agg(F.count(F.lit(1)).alias("n"))),
        ("labelValueCountByLabelName", pairs.groupBy("name").agg(F.countDistinct("value").alias("n"))),
        ("seriesCountByLabelValuePair", pairs.groupBy(F.concat_ws("=", "name", "value").alias("name")).agg(F.count(F.lit(1)).alias("n"))),
    ]
    out = None
    for kind, df in tops:
        part = df.orderBy(F.col("n").desc(), "name").limit(limit).select(F.lit(kind).alias("kind"), "name", "n")
        out = part if out is None else out.unionByName(part)
    return out


def latest_metadata(rows: DataFrame) -> DataFrame:
    """Newest type, help and unit of each metric."""
    return rows.groupBy("metric").agg(F.max_by(F.struct("type", "help", "unit"), "updated_ns").alias("m")).select("metric", "m.*")


def tag_names(attrs: DataFrame, scope: str | None = None) -> DataFrame:
    rows = attrs if scope is None else attrs.where(F.col("scope") == scope)
    return rows.select("scope", "key").distinct()


def tag_values(attrs: DataFrame, key: str, scope: str | None = None) -> DataFrame:
    rows = attrs.where(F.col("key") == key)
    return (rows if scope is None else rows.where(F.col("scope") == scope)).select("val").distinct()


def histogram_wins(floats: DataFrame, hists: DataFrame) -> DataFrame:
    """Samples without those that a histogram of the same series and time replaces."""
    return floats.join(hists.select("metric", "key", "ts").distinct(), ["metric", "key", "ts"], "left_anti")
