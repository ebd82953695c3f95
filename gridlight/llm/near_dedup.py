"""Near-duplicates by banded MinHash with odd sketches, confirmed on full sets.

1. One scan computes each document's set of word shingles, its size, a 256-bit digest
   of its word sequence, MinHash bands and an odd sketch: every MinHash sample flips one
   bit of a 512-bit map, so two sketches' XOR counts the samples in which they differ.
2. Documents with equal word sequences, hence equal sets, form a class; only class
   representatives go on.  Equal sets of different sequences are links like any other.
3. In each band bucket every member is paired with the bucket's smallest one (a star,
   linear in its rows).  Pairs whose sketches differ too much are dropped: at the
   threshold similarity a pair's XOR count stays below the limit but for one in 10^8.
4. The rest is confirmed exactly on the texts' full sets, star by star in salted
   chunks (one centre for each document first, others only while the two ends are in
   different components), and linked documents are joined into components.
5. What a star may have missed are links between members of one bucket that are still
   in different components.  Their sketches meet block by block; members that may be
   similar across components form clusters, whose pairs of different components are
   tested on full sets inside blocks.  Only links leave a block, never pairs.

No bucket is capped, and buckets or centres that hold many rows meet broadcast keys of a
bounded number.  Work is linear but for step 5, which compares the sketches of a bucket's
members outside its largest component with all its members: its cost grows with the
square of what stars leave unlinked in one bucket.  Banding (40 bands of 4) misses a pair at similarity 0.8 with
probability 7e-10.

Defined results: texts are read whole, whatever their length; ties go to the smallest
id; null or empty text and text without words has an empty set and is
linked with nothing (its own component); rows without id cannot be named, are linked
with nothing, have a null component and are kept; repeated rows share a component and
their ``kept``; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import having, join_keys, staged, table
from .components import components
from .wordhash import WordIds, finish, grams, space_words, texts

BANDS, ROWS, BITS = 40, 4, 512
SAMPLES = BANDS * ROWS
#: Members that one task compares with one star's centre.
CHUNK = 256

_SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def xor_limit(similarity: float, sigmas: float = 6.0) -> int:
    """Largest XOR count of two sketches that similar sets may show."""
    differ = SAMPLES * (1 - similarity) + sigmas * math.sqrt(SAMPLES * similarity * (1 - similarity))
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * min(differ, SAMPLES) / BITS)) + 4)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        mul = rng.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None] | np.uint32(1)
        add = rng.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None]
        sample = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
        ids = WordIds()
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for text in texts(batch.column(1)):
                words = space_words(text)
                sizes.append(0)
                if not words:
                    digests.append(b""), bands.append([]), sketches.append([])
                    continue
                found = np.unique(grams(ids.array(words), min(shingle, len(words))))
                sizes[-1] = len(found)
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=32).digest())
                low = (found >> np.uint64(32)).astype(np.uint32)
                least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(low), 2048):
                    np.minimum(least, (low[None, at : at + 2048] * mul + add).min(axis=1), out=least)
                values = finish(least.astype(np.uint64) | sample)
                folded = values.reshape(BANDS, ROWS)
                key = folded[:, 0].copy()
                for j in range(1, ROWS):
                    key = finish(key ^ (folded[:, j] + np.uint64(j)))
                bands.append(key.view(np.int64))
                parity = np.bincount((values % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                sketches.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, _SIGNATURE)


def _sketched(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    """Distinct pairs (u, v) whose sketches are close enough; u is in few of them, v may be
    in very many."""
    pairs = staged(pairs, "near-met")
    a = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    centres = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("v", "c")
    centres = staged(centres.join(b, F.col("c") == F.col("b")).select("b", "sb", "n"), "near-centres")
    differing = F.expr("aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return join_keys(pairs.join(a, F.col("u") == F.col("a")), centres, {"v": "b"}).where(differing <= limit).select("u", "v").distinct()


def _shingles(text: bytes, shingle: int) -> set:
    words = space_words(text)
    if len(words) < shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(shingle))))


def _similar(a: set, b: set, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return bool(a) and 100 * both >= percent * (len(a) + len(b) - both)


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """t_id and text; of the documents in ``ids`` only, where these can be broadcast, so
    that a join need not shuffle all texts."""
    read = docs.select(docs["doc_id"].cast("long").alias("t_id"), docs["text"].cast("string").alias("text"))
    few = having(read, F.col("t_id"), ids.distinct(), "id")
    return read if few is None else few


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    centres = staged(pairs.groupBy(F.col("v").alias("c")).agg(F.count(F.lit(1)).alias("n")), "near-stars")
    chunk = F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / F.lit(CHUNK)).cast("long"))
    dealt = join_keys(pairs, centres, {"v": "c"}).select("u", "v", chunk.alias("chunk"))
    wanted = staged(
        dealt.select(F.col("u").alias("id"), "v", "chunk", F.lit(1).alias("role"))
        .unionByName(dealt.select(F.col("v").alias("id"), "v", "chunk", F.lit(0).alias("role")).distinct()),
        "near-pairs",
    )
    read = _texts_of(wanted.select("id"), docs)
    rows = (
        wanted.join(read, F.col("id") == F.col("t_id"))
        .select("v", "chunk", "role", "id", "text")
        .repartition("v", "chunk").sortWithinPartitions("v", "chunk", "role", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, []
        for batch in batches:
            us, vs = [], []
            for v, chunk, role, u, text in zip(*(batch.column(i).to_pylist() for i in range(4)), texts(batch.column(4))):
                if at != (v, chunk):
                    at, centre = (v, chunk), []
                own = _shingles(text, shingle)
                if not role:
                    centre.append(own)
                elif any(_similar(own, other, percent) for other in centre):
                    us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


class _Union(dict):
    """Union-find over whatever is asked for."""

    def __missing__(self, x):
        self[x] = x
        return x

    def root(self, x):
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _blocks(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, block by block; a block's key is its first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_key] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_key], []
            rows.append(row[n_key:])
    if rows:
        yield key, rows


def _close(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Matrix: which sketches of a and b differ in at most ``limit`` bits."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32) <= limit


def _matrix(sketches: list) -> np.ndarray:
    return np.array(sketches, np.int64).view(np.uint64).reshape(len(sketches), -1)


def undecided(rows: DataFrame, sketches: DataFrame, limit: int, block: int = 512) -> DataFrame:
    """Members that may be similar to one of another component in their bucket.

    ``rows``: band, node, part, top (the bucket's largest part).  Members outside the
    largest part meet all members, block by block, as sketches only; what comes out is a
    row (node, part, root) per member and block, ``root`` joining the parts that met."""
    held = rows.join(sketches.select(F.col("node").alias("k"), "sketch"), F.col("node") == F.col("k")).drop("k")
    size = rows.groupBy("band").agg(
        F.ceil(F.count_if(F.col("part") != F.col("top")) / F.lit(block)).cast("int").alias("na"),
        F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("nb"),
    ).withColumnRenamed("band", "s_band")
    dealt = held.join(size, F.col("band") == F.col("s_band"))
    mine_a, mine_b = F.pmod(F.xxhash64("node"), F.col("na")).cast("int"), F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = dealt.where("part <> top").select("band", mine_a.alias("a"), every("nb").alias("b"), F.lit(0).alias("role"), "node", "part", "sketch")
    b = dealt.select("band", every("na").alias("a"), mine_b.alias("b"), F.lit(1).alias("role"), "node", "part", "sketch")
    blocks = a.unionByName(b).repartition("band", "a", "b").sortWithinPartitions("band", "a", "b", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _blocks(batches, 3):
            left, right = [r for r in found if r[0] == 0], [r for r in found if r[0] == 1]
            if not left or not right:
                continue
            parts_l, parts_r = np.array([r[2] for r in left]), np.array([r[2] for r in right])
            meet = _close(_matrix([r[3] for r in left]), _matrix([r[3] for r in right]), limit)
            meet &= parts_l[:, None] != parts_r[None, :]
            union, hit = _Union(), {}
            for i, j in zip(*np.nonzero(meet)):
                union.join(int(parts_l[i]), int(parts_r[j]))
                hit[left[i][1]], hit[right[j][1]] = int(parts_l[i]), int(parts_r[j])
            if hit:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(hit), pa.int64()), pa.array(list(hit.values()), pa.int64()), pa.array([union.root(p) for p in hit.values()], pa.int64())],
                    names=["node", "part", "root"],
                )

    return blocks.mapInArrow(run, "node long, part long, root long")


def settled(nodes: DataFrame, sketches: DataFrame, docs: DataFrame, limit: int, shingle: int, percent: int, block: int = CHUNK) -> DataFrame:
    """Links (u, v) that join the parts of each cluster, tested on full sets.

    ``nodes``: cluster, node, part.  A cluster's nodes meet in blocks of pairs of chunks;
    each block tests the pairs of different parts whose sketches allow it and skips
    parts that it has joined already.  Only links leave a block."""
    size = nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n")).withColumnRenamed("cluster", "s_cluster")
    dealt = nodes.join(size, F.col("cluster") == F.col("s_cluster")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.join(sketches.select(F.col("node").alias("k"), "sketch"), F.col("node") == F.col("k"))
    read = _texts_of(nodes.select(F.col("node").alias("id")), docs)
    held = dealt.join(read, F.col("node") == F.col("t_id"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    blocks = held.select("cluster", "c", other.alias("o"), "node", "part", "sketch", "text").select(
        "cluster", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "part", "sketch", "text"
    ).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "c", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), found in _blocks(batches, 3):
            parts = np.array([r[2] for r in found])
            chunk = np.array([r[0] for r in found])
            sketch = _matrix([r[3] for r in found])
            meet = np.triu(_close(sketch, sketch, limit), 1) & (parts[:, None] != parts[None, :])
            if i != j:  # pairs inside a chunk have a block of their own
                meet &= chunk[:, None] != chunk[None, :]
            sets: dict[int, set] = {}
            own = lambda k: sets[k] if k in sets else sets.setdefault(k, _shingles((found[k][4] or "").encode(), shingle))
            union, us, vs = _Union(), [], []
            for x, y in zip(*map(np.ndarray.tolist, np.nonzero(meet))):
                p, q = int(parts[x]), int(parts[y])
                if union.root(p) != union.root(q) and _similar(own(x), own(y), percent):
                    union.join(p, q)
                    us.append(found[x][1]), vs.append(found[y][1])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return blocks.mapInArrow(run, "u long, v long")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (u, v) whose ends are in different components; v may be in very many."""
    label = joined.select(F.col("node").alias("l"), "component")
    centres = pairs.groupBy(F.col("v").alias("c")).agg(F.count(F.lit(1)).alias("n")).join(label, F.col("c") == F.col("l"), "left")
    centres = staged(centres.select("c", "n", F.coalesce("component", "c").alias("c_v")), "near-ends")
    named = join_keys(pairs, centres, {"v": "c"}).join(label, F.col("u") == F.col("l"), "left")
    return named.where(F.coalesce("component", "u") != F.col("c_v")).select("u", "v")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document."""
    sig = staged(signatures(docs, shingle), "near-signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # bands and sketch follow from the word sequence
    classes = full.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = staged(classes.withColumnRenamed("digest", "c_digest"), "near-classes")
    nodes = classes.select("node", "bands", "sketch")
    sketches, limit = nodes.select("node", "sketch"), xor_limit(percent / 100)

    # buckets with more than one member, their centre beside each member
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(shared.withColumnRenamed("band", "b"), "near-shared")
    buckets = staged(join_keys(spread, shared, {"band": "b"}).select("band", "node", "centre", "n"), "near-buckets")
    star = buckets.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    star = staged(_sketched(star, sketches, limit), "near-star")
    # first one centre for each, then the others where they could still join something
    one = staged(star.groupBy("u").agg(F.min("v").alias("v")), "near-one")
    links = staged(confirmed(one, docs, shingle, percent), "near-links")
    joined = components(links)
    others = star.join(one.select(F.col("u").alias("o"), F.col("v").alias("p")), (F.col("u") == F.col("o")) & (F.col("v") == F.col("p")), "left_anti")
    more = staged(confirmed(staged(_apart(staged(others, "near-others"), joined), "near-apart"), docs, shingle, percent), "near-links2")
    if more.take(1):
        links = links.unionByName(more)
        joined = components(links)

    # what stars cannot see: members of a bucket that are still in different components
    label = joined.select(F.col("node").alias("l"), "component")
    placed = buckets.where("n > 2").join(label, F.col("node") == F.col("l"), "left").select(
        "band", "node", "centre", F.coalesce("component", "node").alias("part")
    )
    placed = staged(placed, "near-placed")
    sizes = placed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(
        F.max(F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("held")
    ).where("parts > 1")
    mixed = staged(mixed.select(F.col("band").alias("m"), F.col("top.part").alias("top"), "held"), "near-parts")
    rows = join_keys(placed, mixed, {"band": "m"}, n="held").where("node <> centre").select("band", "node", "part", "top")
    met = staged(undecided(staged(rows, "near-mixed"), sketches, limit), "near-undecided")
    clusters = components(met.select(F.col("part").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("l"), F.col("component").alias("cluster"))
    nodes = met.select("node", "part").distinct().join(clusters, F.col("part") == F.col("l"), "left").select(
        F.coalesce("cluster", "part").alias("cluster"), "node", "part"
    )
    last = staged(settled(staged(nodes, "near-clusters"), sketches, docs, limit, shingle, percent), "near-links3")
    if last.take(1):
        joined = components(links.unionByName(last))

    label = joined.select(F.col("node").alias("l"), "component")
    named = classes.join(label, F.col("node") == F.col("l"), "left").select("c_digest", "n", F.coalesce("component", "node").alias("class"))
    alone = sig.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = join_keys(full.select("doc_id", "n_shingles", "digest"), staged(named, "near-named"), {"digest": "c_digest"})
    return (
        found.select("doc_id", "n_shingles", F.col("class").alias("component_id")).unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
