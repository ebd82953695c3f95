"""From raw documents to shuffled training shards: five operators in a row.

Each stage reads what its predecessor wrote and works on all of it; every stage but
the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlight.llm.common import row_key, staged, table
from gridlight.llm.decontaminate import decontaminate
from gridlight.llm.near_dedup import near_duplicates
from gridlight.llm.quality_model import classify
from gridlight.llm.sharding import shard
from gridlight.llm.source_mix import mixed_documents


def _record(docs: DataFrame) -> Column:
    """All columns in one, so that their names meet no other."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("rec")


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, rid) is in ``verdicts``.  Equal rows share a verdict."""
    kept = verdicts.select(F.col("doc_id").alias("k_id"), F.col("rid").alias("k_rid"))
    rows = docs.select(_record(docs), docs["doc_id"].cast("long").alias("id"), row_key(docs).alias("rid"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("rid") == F.col("k_rid")), "left_semi").select("rec.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = classify(docs, table(spark, sf_dir, "labels"))
    return _keep(docs, scored.where("predicted = 1"))


def _odd_keys(docs: DataFrame) -> DataFrame | None:
    """o_id, o_rid, o_node: a node of its own, no document's id, for each (id, text) that an
    id does not name: rows without id, and ids that several texts share.  None: there are none."""
    keys = staged(docs.select(docs["doc_id"].cast("long").alias("o_id"), row_key(docs).alias("o_rid")).distinct(), "pipeline-keys")
    shared = keys.where("o_id IS NOT NULL").groupBy("o_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("o_id").alias("s_id"))
    odd = keys.join(shared, F.col("o_id") == F.col("s_id"), "left_semi").unionByName(keys.where("o_id IS NULL"))
    odd = staged(odd, "pipeline-odd")
    n = odd.count()
    if not n:
        return None
    least, most = keys.agg(F.coalesce(F.min("o_id"), F.lit(0)), F.coalesce(F.max("o_id"), F.lit(0))).first()
    first = most + 1 if most + n < 1 << 63 else least - n
    if first < -(1 << 63):
        raise ValueError("no numbers are left beside the ids")
    numbered = odd.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], first + x[1]))
    return staged(docs.sparkSession.createDataFrame(numbered, "o_id long, o_rid long, o_node long"), "pipeline-odd-nodes")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, any id
    before none.  Of equal rows (id and text) one is kept, of different texts with one
    id each is judged by itself."""
    odd, node = _odd_keys(docs), docs["doc_id"].cast("long")
    if odd is None:
        rows = docs.select(_record(docs), node.alias("node"))
    else:
        rows = docs.select(_record(docs), node.alias("id"), row_key(docs).alias("rid"))
        same = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("rid") == F.col("o_rid"))
        rows = staged(rows.join(odd, same, "left").select("rec", F.coalesce("o_node", "id").alias("node")), "pipeline-nodes")
    found = near_duplicates(rows.select(F.col("node").alias("doc_id"), F.col("rec")["text"].alias("text")))
    if odd is None:
        kept = found.where("kept").select(F.col("doc_id").alias("k")).distinct()
    else:
        named = found.join(odd, F.col("doc_id") == F.col("o_node"), "left")
        own = F.when(F.col("o_node").isNull(), F.col("doc_id")).otherwise(F.col("o_id"))
        best = F.min(F.struct(own.isNull().alias("unnamed"), own.alias("id"), F.col("doc_id").alias("node")))
        kept = named.groupBy("component_id").agg(best.alias("best")).select(F.col("best.node").alias("k"))
    twin = Window.partitionBy("node").orderBy(F.xxhash64("rec"))
    rows = rows.join(kept, F.col("node") == F.col("k"), "left_semi").withColumn("twin", F.row_number().over(twin))
    return rows.where("twin = 1").select("rec.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, however small its share of the
    text: a passage leaks its item from a long document too."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.where("n_hit = 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents with shard and slot."""
    return shard(docs, payload=tuple(docs.columns))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_free),
    ("source mixing", mix),
    ("sharding", shards),
]

#: MinHash, random features and seeded shuffles have no SQL twin; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
