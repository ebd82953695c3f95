from pyspark.sql import functions as F

from gridlight.operators import catalog
from gridlight.plans.traceql import edges
from gridlight.sources import otlp, views
from gridlight.streaming import jobs


def test_tail_and_rollup(spark, sf_dir, tmp_path):
    lines = views.log_events(spark, sf_dir)
    source = f"{tmp_path}/lines"
    lines.repartition(3).write.parquet(source)
    got = []
    stream = lambda: jobs.lines_stream(spark, source, lines.schema, max_files=1)
    jobs.tail(stream(), '{event_type="error"} |= "user=1"', lambda df, epoch: got.extend(df.collect()), f"{tmp_path}/c1").awaitTermination()
    want = lines.where("labels['event_type'] = 'error' AND contains(line, 'user=1')").count()
    assert len(got) == want > 0
    jobs.log_rollup(stream(), f"{tmp_path}/r", f"{tmp_path}/c2", every="1 hour", late="60 days").awaitTermination()
    jobs.label_index(stream(), f"{tmp_path}/i", f"{tmp_path}/c3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/i").select("name", "value").distinct().count() == lines.select("key").distinct().count()


def test_rollup_is_the_batch_result(spark, sf_dir, tmp_path):
    lines = views.log_events(spark, sf_dir)
    hour = 3600 * 10**9
    last = lines.agg(F.max("ts")).first()[0]
    source = f"{tmp_path}/lines"
    lines.coalesce(1).write.parquet(f"{source}/a")
    lines.limit(1).withColumn("ts", F.lit(last + 100 * hour)).coalesce(1).write.parquet(f"{source}/b")  # pushes the watermark
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    jobs.log_rollup(stream, f"{tmp_path}/r", f"{tmp_path}/c", every="1 hour", late="1 hour").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/r").where(F.col("bucket") <= last)
    assert {tuple(r) for r in got.select("key", "bucket", "count", "bytes").collect()} == {tuple(r) for r in catalog.rollup(lines, hour).collect()}


def _pushed(spark, rows, last, root):
    """A stream of ``rows`` in one file and, in the next, one row far after ``last``."""
    rows.coalesce(1).write.parquet(f"{root}/a")
    rows.limit(1).withColumn("ts", F.lit(last + 100 * 3600 * 10**9)).coalesce(1).write.parquet(f"{root}/b")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(root)


def test_pattern_rollup_is_the_batch_result(spark, sf_dir, tmp_path):
    lines, hour = views.log_events(spark, sf_dir), 3600 * 10**9
    last = lines.agg(F.max("ts")).first()[0]
    jobs.pattern_rollup(_pushed(spark, lines, last, f"{tmp_path}/lines"), f"{tmp_path}/r", f"{tmp_path}/c", every="1 hour", late="1 hour").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/r").where(F.col("bucket") <= last).groupBy("pattern").agg(F.sum("count")).collect()
    want = catalog.patterns(lines, hour).select("pattern", "total").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) != []


def test_edge_stream_is_the_batch_result(spark, sf_dir, tmp_path):
    spans = views.chat_spans(spark, sf_dir)
    spans.repartition(3).write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    jobs.edge_stream(stream, f"{tmp_path}/e", f"{tmp_path}/c").awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/e"), edges(spans)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_rows_are_written_by_day(spark, sf_dir, tmp_path):
    rows = views.gauge(spark, sf_dir).select("metric", "key", "ts", "value")
    early = rows.where("ts % 2 = 0")
    for part in (early, rows.exceptAll(early)):
        otlp.write_by_day(part, f"{tmp_path}/d", "ts", 1000, ["key", "ts"])
    got = spark.read.parquet(f"{tmp_path}/d")
    assert got.where(F.col("day") != F.to_date(F.timestamp_millis("ts"))).count() == 0
    assert sorted(map(tuple, got.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
