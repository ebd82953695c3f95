"""Metric, log and trace views over the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.histograms import TYPE
from ..functions.numeric import whole_div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is smaller than one split, dealt to all cores; a larger table is
    read as it lies.  At most ``spark.sql.files.maxPartitionBytes`` are shuffled."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cores == 1 or size > min(conf.filesMaxPartitionBytes(), cores * conf.filesOpenCostInBytes()):
        return df
    return df.repartition(cores)


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session's zone is."""
    utc = F.to_utc_timestamp(ts.cast("timestamp"), "UTC")
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")
    return day * 86_400_000_000 + second * 1_000_000 + F.pmod(F.unix_micros(utc), F.lit(1_000_000))


def millis(ts: Column) -> Column:
    return whole_div(micros(ts), 1000)


def _series(df: DataFrame, metric: str, labels: dict[str, Column], ts: Column, value: Column, *more: Column) -> DataFrame:
    m = F.create_map(*[x for k, v in sorted(labels.items()) for x in (F.lit(k), v.cast("string"))])
    out = df.select(F.lit(metric).alias("metric"), m.alias("labels"), ts.cast("long").alias("ts"), value.cast("double").alias("value"), *more)
    return out.withColumn("key", L.series_key(F.col("labels"))).withColumn("stale", F.lit(False))


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_value{event_type, user_id}``."""
    e = table(spark, sf_dir, "events")
    return _series(e, "event_value", {"event_type": e["event_type"], "user_id": e["user_id"]}, millis(e["ts"]), e["value"])


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``typed_value{event_type}``: all users in one series per type."""
    e = table(spark, sf_dir, "events")
    return _series(e, "typed_value", {"event_type": e["event_type"]}, millis(e["ts"]), e["value"])


def counter(spark: SparkSession, sf_dir: str, wrap: int = 0) -> DataFrame:
    """``events_total{event_type}``, or ``events_wrapped_total`` that resets every ``wrap``;
    ``seq`` orders samples of one millisecond."""
    e = table(spark, sf_dir, "events")
    n = F.count(F.lit(1)).over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    name = "events_wrapped_total" if wrap else "events_total"
    e = e.withColumn("n", n)
    value = F.pmod(F.col("n"), F.lit(wrap)) if wrap else F.col("n")
    return _series(e, name, {"event_type": e["event_type"]}, millis(e["ts"]), value, F.col("n").alias("seq"))


BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, float("inf"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_size_bucket{event_type, le}``: cumulative counts per day, at the day's start."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    le = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("l")) for b in BOUNDS]))
    rows = e.select("event_type", "value", day.alias("day"), le.alias("le"))
    counts = rows.groupBy("event_type", "day", F.col("le.l").alias("le")).agg(F.count_if(F.col("value") <= F.col("le.b")).alias("n"))
    return _series(counts, "event_size_bucket", {"event_type": counts["event_type"], "le": counts["le"]}, counts["day"], counts["n"])


def native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_native{event_type}``: a histogram counter per type, sampled at each day's end.
    Values up to 1 are its zero bucket; beyond, bucket i holds (2**(i-1), 2**i]."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    at = F.when(F.col("value") > 1, F.ceil(F.log2("value")).cast("int"))
    per = e.groupBy("event_type", day.alias("day"), at.alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    last = e.agg(F.max(day).alias("last"))
    grown = per.join(F.broadcast(last)).select("event_type", "i", "n", "s", F.explode(F.sequence("day", "last")).alias("day"))  # one row
    kept = grown.groupBy("event_type", "day", "i").agg(F.sum("n").cast("double").alias("n"), F.sum("s").alias("s"))
    buckets_ = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n"))))
    h = kept.groupBy("event_type", "day").agg(
        F.sum("n").alias("count"), F.sum("s").alias("sum"), F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("n"))), F.lit(0.0)).alias("zero"), buckets_.alias("pos")
    )
    hist = F.struct(
        F.lit(0).alias("schema"), F.lit(1.0).alias("zero_threshold"), F.col("zero").alias("zero_count"), "count", "sum", "pos", F.array().alias("neg")
    ).cast(TYPE)
    return h.select(
        F.lit("event_native").alias("metric"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"),
        ((F.col("day") + 1) * 86_400_000).alias("ts"), hist.alias("hist"),
    ).withColumn("key", L.series_key(F.col("labels"))).withColumn("stale", F.lit(False))


def infos(spark: SparkSession, sf_dir: str, at_ms: int) -> DataFrame:
    """``user_activity{instance, job}`` and ``target_info{instance, job, segment}`` at one time."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    segment = F.concat(F.lit("s"), F.pmod("user_id", F.lit(3)).cast("string"))
    a = _series(per, "user_activity", {"instance": name, "job": F.lit("web")}, F.lit(at_ms), F.col("n"))
    b = _series(per, "target_info", {"instance": name, "job": F.lit("web"), "segment": segment}, F.lit(at_ms), F.lit(1))
    return a.unionByName(b)


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ``event_type=<t> user=<u> value=<v> {"k": n}`` in streams per event type."""
    e = spread(table(spark, sf_dir, "events"))
    cents = F.floor(F.col("value") * 100).cast("long")
    line = F.concat(F.lit("event_type="), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), cents.cast("string"), F.lit(" "), "props")
    df = e.select(F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), (micros(e["ts"]) * 1000).alias("ts"), line.alias("line"))
    return df.withColumn("key", L.series_key(F.col("labels")))


def log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as nested JSON lines."""
    e = spread(table(spark, sf_dir, "events"))
    cents = F.floor(F.col("value") * 100).cast("long")
    line = F.concat(
        F.lit('{"user":{"id":'), F.col("user_id").cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"},"took":"'),
        cents.cast("string"), F.lit('ms","size":"'), F.col("user_id").cast("string"), F.lit('KB","props":'), F.col("props"), F.lit("}"),
    )
    df = e.select(F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), (micros(e["ts"]) * 1000).alias("ts"), line.alias("line"))
    return df.withColumn("key", L.series_key(F.col("labels")))


def log_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines in streams per language and source; time is doc_id seconds."""
    d = table(spark, sf_dir, "documents")
    df = d.select(
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("labels"),
        (F.col("doc_id") * 1_000_000_000).alias("ts"), F.explode(F.split("text", "\n")).alias("line"),
    )
    return df.withColumn("key", L.series_key(F.col("labels")))


#: The attributes beside the order spans: text and number column by (scope, key).
SPAN_COLUMNS = {("span", "qty"): ("qty", "qty_num"), ("span", "flag"): ("flag", "flag_num"), ("resource", "priority"): ("priority", "priority_num")}


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root span per order (server) and a client span per line item, with their attributes
    in the columns of ``SPAN_COLUMNS``."""
    o, l = (spread(table(spark, sf_dir, t)) for t in ("orders", "lineitem"))  # noqa: E741
    text, number, qty = F.lit(None).cast("string"), F.lit(None).cast("double"), F.col("l_quantity").cast("long")
    root = o.select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trace_id"), F.lit("root").alias("span_id"), F.lit("").alias("parent_id"),
        F.concat(F.lit("order-"), "o_orderstatus").alias("name"), F.col("o_orderpriority").alias("service"),
        (micros(o["o_orderdate"]) * 1000).alias("ts_ns"), (F.floor(F.col("o_totalprice")) * 1_000_000).cast("long").alias("duration_ns"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("status"), F.lit(2).alias("kind"),
        text.alias("qty"), number.alias("qty_num"), text.alias("flag"), number.alias("flag_num"), F.col("o_orderpriority").alias("priority"), number.alias("priority_num"),
    )
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("string")
    child = l.select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("trace_id"),
        F.concat_ws("-", F.lit("c"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), day).alias("span_id"),
        F.lit("root").alias("parent_id"), F.concat(F.lit("item-"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("service"),
        (micros(l["l_shipdate"]) * 1000).alias("ts_ns"), (F.col("l_quantity") * 1_000_000).cast("long").alias("duration_ns"),
        F.when(F.col("l_linestatus") == "F", 2).otherwise(1).alias("status"), F.lit(3).alias("kind"),
        qty.cast("string").alias("qty"), qty.cast("double").alias("qty_num"), F.col("l_returnflag").alias("flag"), number.alias("flag_num"), text.alias("priority"), number.alias("priority_num"),
    )
    both = root.unionByName(child)
    none = F.lit("")
    return both.select("*", none.alias("status_message"), F.lit("tpch").alias("scope_name"), F.lit("1").alias("scope_version"))


def chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span per conversation turn; a turn's parent is the turn before."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    turn = F.col("turn").cast("string")
    return c.select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("trace_id"), F.concat(F.lit("s"), turn).alias("span_id"),
        F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit("s"), (F.col("turn") - 1).cast("string"))).alias("parent_id"),
        F.col("role").alias("name"), F.col("role").alias("service"), (F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("ts_ns"),
        F.length("text").cast("long").alias("duration_ns"), F.lit(0).alias("status"),
        F.when(F.pmod("turn", F.lit(2)) == 0, 3).otherwise(2).alias("kind"), F.lit("").alias("status_message"), F.lit("").alias("scope_name"), F.lit("").alias("scope_version"),
    )


def attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """span.qty, span.flag and resource.priority of the order spans."""
    o, l = (spread(table(spark, sf_dir, t)) for t in ("orders", "lineitem"))  # noqa: E741
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("string")
    sid = F.concat_ws("-", F.lit("c"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), day)
    qty = F.col("l_quantity").cast("long")
    child = l.select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("trace_id"), sid.alias("span_id"),
        F.explode(F.array(
            F.struct(F.lit("span").alias("scope"), F.lit("qty").alias("key"), qty.cast("string").alias("val"), qty.cast("double").alias("val_num")),
            F.struct(F.lit("span").alias("scope"), F.lit("flag").alias("key"), F.col("l_returnflag").alias("val"), F.lit(None).cast("double").alias("val_num")),
        )).alias("a"),
    )
    root = o.select(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trace_id"), F.lit("root").alias("span_id"),
        F.struct(F.lit("resource").alias("scope"), F.lit("priority").alias("key"), F.col("o_orderpriority").alias("val"), F.lit(None).cast("double").alias("val_num")).alias("a"),
    )
    return child.unionByName(root).select("trace_id", "span_id", "a.*")


def chat_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and a link of the conversation spans: each turn has an event ``said`` (with its
    size) and, after turn 2, one ``late``; a turn links to the conversation before its own."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    row = lambda scope, key, val, num=None, when=None: F.when(F.lit(True) if when is None else when, F.struct(
        F.lit(scope).alias("scope"), F.lit(key).alias("key"), val.cast("string").alias("val"), (F.lit(None) if num is None else num).cast("double").alias("val_num")))
    size, late = F.length("text"), F.col("turn") > 2
    values = F.filter(F.array(
        row("event", "event:name", F.lit("said")), row("event", "event:name", F.lit("late"), when=late), row("event", "size", size, size),
        row("event", "event:timeSinceStart", F.col("turn"), F.col("turn")),
        row("link", "link:traceID", F.concat(F.lit("v"), F.col("conv_id") - 1)), row("link", "kind", F.col("role")),
    ), lambda x: x.isNotNull())
    ids = [F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("trace_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("span_id")]
    return c.select(*ids, F.explode(values).alias("a")).select("trace_id", "span_id", "a.*")
