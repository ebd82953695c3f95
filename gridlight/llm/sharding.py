"""Two-pass external shuffle into shards (native).

Pass 1 scatters records into memory-sized buckets by a seeded hash; pass 2 brings
each bucket into one array, puts it in a canonical order, applies Spark's seeded
Fisher-Yates ``shuffle`` to it and numbers the rows.  Bucket sizes, summed before
their bucket, turn these numbers into positions of one random permutation of the
corpus, and shard s takes positions ceil(s*N/K) .. ceil((s+1)*N/K)-1: the ``rows``
law (counts differ by one at most), slots without gaps.  The query shards whole
records, writes the shards and takes its result from what it reads back from them.

A bucket is bounded by ``bucket_bytes``/``bucket_rows`` on average; the hash is over
id, size and checksum, so copies with ids of their own spread evenly, whatever the
size of their group.

Defined results: null text has size 16 and checksum 0; null ids are scattered by
size and checksum; repeated rows get slots of their own; an empty table gives no
rows; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import body, scratch, staged, table

N_SHARDS = 40
SEED = 20_240_607
#: Pass 2 holds one bucket in memory.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 100_000
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _facts(records: DataFrame):
    text = body(records)
    return (
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )


def shard(
    records: DataFrame,
    n_shards: int = N_SHARDS,
    seed: int = SEED,
    payload: tuple[str, ...] = ("doc_id",),
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``payload`` columns of each record with size, text_crc32, law, shard, slot and
    grown_shard (null under this law)."""
    payload = tuple(c for c in payload if c.lower() not in OUT)
    size, crc = _facts(records)
    ids = staged(records.select(records["doc_id"], size, crc), "shard-ids")
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    heavy = any(c != "doc_id" for c in payload)
    n, n_buckets = total["n"], max(1, math.ceil(total["n"] / bucket_rows))
    if heavy:
        n_buckets = max(n_buckets, math.ceil(total["bytes"] / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"), F.lit(n_buckets)).alias("bucket")

    # bucket -> its first position; as many rows as buckets
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ids.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )

    if heavy:
        source = records.select(records["doc_id"], size, crc, F.struct(*[records[c] for c in payload]).alias("rec"))
    else:
        source = ids.withColumn("rec", F.struct(*[F.col(c) for c in payload]))
    mixed = F.xxhash64(F.lit(seed + 1), "doc_id", "size", "text_crc32")
    row = F.struct(mixed.alias("h"), "size", "text_crc32", "rec")
    arrays = (
        source.select(bucket, row.alias("row"))
        .repartition(n_buckets, "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
    )
    placed = (
        arrays.join(starts, F.col("bucket") == F.col("b"))
        .sortWithinPartitions("bucket")
        .select("start", F.shuffle("rows", seed).alias("rows"))
        .select("start", F.posexplode("rows").alias("at", "row"))
    )
    k = F.lit(n_shards).cast("long")
    pos = F.col("start") + F.col("at")
    return (
        placed.select(F.col("row.*"), pos.alias("pos"))
        .withColumn("shard", F.expr(f"CAST((pos * {n_shards}L) DIV {max(n, 1)}L AS INT)"))
        .select(
            *[F.col("rec")[c].alias(c) for c in payload],
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("pos") - F.expr(f"(shard * {n}L + {n_shards - 1}L) DIV {n_shards}L")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write placed records as Parquet, one folder per shard, in slot order inside files.

    Pass 2 leaves each task whole runs of positions, so no further shuffle is needed.
    """
    (
        placed.sortWithinPartitions("shard", "slot")
        .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    )


def stored(records: DataFrame, **sizes: int) -> DataFrame:
    """Shard whole records, write the shards and describe each record as read back."""
    spark = records.sparkSession
    payload = tuple(c for c in records.columns if c.lower() not in OUT)
    placed = shard(records, payload=payload, **sizes).select(*payload, "shard", "slot")
    path, schema = scratch(spark, "shards"), placed.schema
    write_shards(placed, path)
    found = spark.read.schema(schema).parquet(path)
    return found.select(
        "doc_id", *_facts(found), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
