"""Structured Streaming: live tail and incremental roll-ups.

The batch form of every roll-up is the truth; late rows beyond the watermark are only in
that.  Sinks are append-only Parquet with a checkpoint, so a restarted job goes on where
it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import whole_div
from ..operators import catalog
from ..plans import logql_parser as Q
from ..plans.logql import LogEngine
from ..plans.traceql import edges


def lines_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Log rows (labels, key, ts, line) as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tail(stream: DataFrame, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A log query over the stream; ``sink`` gets each batch (ts, labels, key, line)."""
    query = Q.parse(text)
    if not isinstance(query, Q.Query):
        raise ValueError("tail takes a log query")

    def run(batch: DataFrame, epoch: int) -> None:
        engine = LogEngine(batch.sparkSession, batch)
        rows = engine.pipeline(query, engine._scan(query))
        sink(rows.select("ts", "labels", "line").orderBy("ts"), epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tumbling(stream: DataFrame, every: str, late: str) -> tuple[DataFrame, object]:
    timed = stream.withColumn("at", F.timestamp_micros(whole_div(F.col("ts"), 1000))).withWatermark("at", late)
    return timed, F.window("at", every)


def log_rollup(stream: DataFrame, path: str, checkpoint: str, every: str = "1 minute", late: str = "10 minutes") -> StreamingQuery:
    """Lines and bytes per stream and window."""
    timed, window = _tumbling(stream, every, late)
    out = timed.groupBy("key", window.alias("w")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("line")).alias("bytes"))
    out = out.select("key", (F.unix_micros("w.start") * 1000).alias("bucket"), "count", "bytes")
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pattern_rollup(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", late: str = "10 minutes") -> StreamingQuery:
    """Counts per stream, line pattern and window."""
    timed, window = _tumbling(stream, every, late)
    out = timed.groupBy("key", catalog.pattern(F.col("line")).alias("pattern"), window.alias("w")).agg(F.count(F.lit(1)).alias("count"))
    out = out.select("key", "pattern", (F.unix_micros("w.start") * 1000).alias("bucket"), "count")
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_index(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Inverted index (name, value, key): a row per new pair of a batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        pairs = batch.dropDuplicates(["key"]).select("key", F.explode("labels").alias("name", "value"))
        pairs.distinct().write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_stream(spans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Service-graph halves as spans arrive (stateless)."""
    return edges(spans).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
