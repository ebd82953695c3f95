"""Mixing sources to target weights by pivotal dependent rounding (native).

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; they share
150 % of all words, a source stops at twice its size and the excess is reshared by
weight.  That fixed point is the water level L of min(2*size, L*weight), found in
closed form over the per-source table.

Rounding: each document wants target/source_size copies; the whole part is given,
the fraction is its mass in words (exact integers of 2**-20 words).  A pair of
documents moves mass, in a random direction with the odds that keep each one's
expected mass, until one of the two is integral; that one is decided, the other
goes on.  A block of about ``BLOCK`` documents is one array, largest document first:
what a pair leaves over meets the next smaller document, so large ones are decided
among their like and a small one remains; it enters the next level of a reduction tree
of blocks.  A source's taken words differ from its target by less than the one document
that the root leaves to chance.

All randomness is hashed from seed and identity, so reruns agree.  Hot sources are
salted over blocks; a block is bounded on average by ``BLOCK`` rows.

Defined results: null or empty text has size 0 and is never taken; null sources form
one source, last in order; repeated rows are each decided; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, body, staged, table

SHARE, CAP = 1.5, 2
SEED, BLOCK = 77_003, 2048
#: Words are counted in units of 2**-20.
UNIT = 20


def source_targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, n_docs, source_size, target: one row per source."""
    per = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").cast("long").alias("source_size")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(3))
    weighed = per.withColumn("weight", F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), rank + 1))
    everything = Window.partitionBy()
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("room", F.col("limit") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything))
    )
    target = F.least("limit", F.coalesce(F.col("water") * F.col("weight"), F.col("limit")))
    return level.select("source", "n_docs", "source_size", target.alias("target"))


def _pivot(a: str, b: str, seed: int) -> str:
    """SQL: a struct (d: decided, r: left over) from two candidates."""
    full = lambda x: f"shiftleft({x}.size, {UNIT})"
    moved = (
        f"transform(array(named_struct('a', {a}, 'b', {b})), "
        f"p -> named_struct('a', p.a, 'b', p.b, "
        f"'x', least(p.a.m, {full('p.b')} - p.b.m), 'y', least(p.b.m, {full('p.a')} - p.a.m), "
        f"'u', pmod(xxhash64({seed}, p.a.h, p.b.h, p.a.m, p.b.m), 1048576) / 1048576D))"
    )
    to_b = f"transform({moved}, p -> IF(p.u * (p.x + p.y) < p.y, " \
        "named_struct('a', p.a, 'b', p.b, 'am', p.a.m - p.x, 'bm', p.b.m + p.x), " \
        "named_struct('a', p.a, 'b', p.b, 'am', p.a.m + p.y, 'bm', p.b.m - p.y)))"
    put = lambda x, m: f"named_struct('n', {x}.n, 'h', {x}.h, 'id', {x}.id, 'size', {x}.size, 'crc', {x}.crc, 'c', {x}.c, 'm', {m})"
    done = f"transform({to_b}, p -> IF(p.am = 0 OR p.am = {full('p.a')}, " \
        f"named_struct('d', {put('p.a', 'p.am')}, 'r', {put('p.b', 'p.bm')}), " \
        f"named_struct('d', {put('p.b', 'p.bm')}, 'r', {put('p.a', 'p.am')})))"
    return f"{done}[0]"


def _descent(seed: int) -> str:
    """SQL over ``items``, largest first: struct (done: decided items, rest: the one left over)."""
    kind = "array<struct<n: bigint, h: bigint, id: bigint, size: bigint, crc: bigint, c: bigint, m: bigint>>"
    return (
        f"aggregate(slice(items, 2, size(items)), named_struct('done', CAST(array() AS {kind}), 'rest', items[0]), "
        f"(s, x) -> transform(array({_pivot('s.rest', 'x', seed)}), "
        "p -> named_struct('done', concat(s.done, array(p.d)), 'rest', p.r))[0])"
    )


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, crc, source_size, target, copies, taken: a row per document."""
    text = body(docs)
    sizes = staged(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"],
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("crc"),
        ),
        "mix-sizes",
    )
    goals = staged(source_targets(sizes, share, cap), "mix-targets")
    largest = goals.agg(F.coalesce(F.max("n_docs"), F.lit(0)).alias("n")).first()["n"]

    g = goals.select(F.col("source").alias("g_source"), "n_docs", "source_size", "target")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("want").cast("long")
    mass = F.round((F.col("want") - whole) * F.shiftleft("size", UNIT)).cast("long")
    item = F.struct(
        (-F.col("size")).alias("n"), F.xxhash64(F.lit(seed), "doc_id", "size", "crc").alias("h"), F.col("doc_id").alias("id"), "size", "crc",
        whole.alias("c"), F.least(mass, F.shiftleft("size", UNIT)).alias("m"),
    )
    blocks = F.ceil(F.col("n_docs") / F.lit(block)).cast("long")
    rows = (
        sizes.join(g, sizes["source"].eqNullSafe(g["g_source"]))
        .withColumn("want", want)
        .select("source", item.alias("item"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "crc"), blocks).alias("block"))
    )
    decided, most, level = [], math.ceil(largest / block), 0
    while True:
        run = staged(
            rows.groupBy("source", "block")
            .agg(F.sort_array(F.collect_list("item")).alias("items"))
            .select("source", "block", F.expr(_descent(seed + 2 + level)).alias("s"))
            .select("source", "block", "s.done", "s.rest"),
            f"mix-level{level}",
        )
        decided.append(run.select("source", F.explode("done").alias("item")))
        if most <= 1:
            break
        rows = run.select("source", F.col("rest").alias("item"), F.expr(f"block DIV {block}L").alias("block"))
        most, level = math.ceil(most / block), level + 1
    # the root's last document: its remaining mass decides by chance
    u = F.pmod(F.xxhash64(F.lit(seed - 1), "rest.h"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    full = F.shiftleft("rest.size", UNIT)
    last = run.select(
        "source",
        F.struct("rest.n", "rest.h", "rest.id", "rest.size", "rest.crc", "rest.c", F.when(u * full < F.col("rest.m"), full).otherwise(F.lit(0).cast("long")).alias("m")).alias("item"),
    )
    out = reduce(DataFrame.unionByName, [*decided, last]).select("source", "item.*")
    copies = F.when(F.col("size") > 0, F.col("c") + F.when(F.col("m") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", copies)
    return out.join(g, out["source"].eqNullSafe(g["g_source"])).select(
        F.col("id").alias("doc_id"), "source", "size", "crc", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Decisions meet their rows on (id, words, checksum); rows that agree in all three
    are numbered on both sides, so each is served by one decision."""
    twin = Window.partitionBy("k_id", "k_size", "k_crc").orderBy("k_id")
    text = body(docs)
    left = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("rec"),
        docs["doc_id"].cast("long").alias("k_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("k_size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("k_crc"),
    ).withColumn("k_n", F.row_number().over(twin))
    right = (
        mix(docs, **options)
        .select(F.col("doc_id").alias("k_id"), F.col("size").alias("k_size"), F.col("crc").alias("k_crc"), "copies")
        .withColumn("k_n", F.row_number().over(twin))
    )
    same = [left[c].eqNullSafe(right[c]) for c in ("k_id", "k_size", "k_crc", "k_n")]
    return (
        left.join(right.where("copies > 0"), reduce(lambda x, y: x & y, same))
        .select("rec", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
        .select("rec.*")
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
