"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, as a Java regex class body.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a temporary folder is chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/gridlight/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the
    rows survive lost executors."""
    spark = df.sparkSession
    path, schema = scratch(spark, name), df.schema
    df.write.parquet(path)
    del df
    # shuffle files go when the driver's JVM finds that nothing refers to them; a long
    # chain of stages would otherwise keep all of them on the executors' disks
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


#: Keys that may be broadcast, at most: 16 MB of longs.
BROADCAST_KEYS = 2_000_000


def having(df: DataFrame, on: Column, keys: DataFrame, key: str, anti: bool = False) -> DataFrame | None:
    """Rows of ``df`` whose ``on`` is (or is not) among the distinct ``keys``, without a
    shuffle of ``df``; None when there are too many keys to broadcast them."""
    if keys.count() > BROADCAST_KEYS:
        return None
    return df.join(F.broadcast(keys.select(F.col(key).alias("_key"))), on == F.col("_key"), "left_anti" if anti else "left_semi")


#: A key is hot when it holds more than one in ``HOT_SHARE`` of all rows, so there are
#: fewer hot keys than that, whatever the data.
HOT_SHARE = 2_000


def join_keys(df: DataFrame, keys: DataFrame, on: dict[str, str], n: str = "n", how: str = "inner") -> DataFrame:
    """``df`` joined with ``keys``, one row per key, by ``on`` (column of df -> column of keys).

    ``keys`` (staged) has each key's number of rows of ``df`` in column ``n``.  The rows of hot keys meet
    a broadcast of fewer than ``HOT_SHARE`` keys where they are, so no key fills a task;
    the others are shuffled."""
    total = keys.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    least = max(total // HOT_SHARE, 1)
    hot, cold = keys.where(F.col(n) > least), keys.where(F.col(n) <= least)
    same = lambda side: reduce(Column.__and__, [F.col(a) == side[b] for a, b in on.items()])
    if not hot.take(1):
        return df.join(cold, same(cold), how)
    mark = hot.select(*on.values())
    rest = df.join(F.broadcast(mark), same(mark), "left_anti")
    return df.join(F.broadcast(hot), same(hot), how).unionByName(rest.join(cold, same(cold), how))


@atexit.register
def release() -> None:
    """Delete what ``scratch`` handed out (best effort)."""
    while _staged:
        spark, path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; the files are scratch
            pass


def body(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col], F.lit(""))


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a row's id and text.  Rows that agree in both share it and get
    the same results; together with the id it separates any other two rows."""
    return F.xxhash64(df[id_col], df[text_col])
