"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (13 words, or the whole of a shorter item) are sets of k-word
shingles that a document must contain completely, so by the prefix-filter principle
one shingle of each window suffices to find all candidates, and the rarest is the
cheapest.  The scan emits, for every document position whose shingle occurs in some
window and whose run of such positions is long enough for one (length bound), the
shingle with its surrounding words.  Shingles are then ordered by their frequency over
all documents, each window keeps its rarest as prefix, and the join on prefix tokens
is followed by positional bounds and the exact comparison of the window's words.

The windows' shingles are shipped to the scan in blocks of at most ``SHIPPED``; a
benchmark beyond that is scanned block by block, so nothing shipped grows with it.

Defined results: null text has no words and is never contaminated; an item without
words has no window; items without id hit but are not named; equal windows of several
items name them all; repeated documents get equal results; empty tables give no hits;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, staged, table
from .wordhash import WordIds, alnum_words, grams, texts

WINDOW, SHINGLE = 13, 5
#: Shingle hashes shipped to a scan at once (16 MB).
SHIPPED = 2_000_000
#: A document is contaminated when this share of its words is hit.
SHARE_NUM, SHARE_DEN = 1, 20

_WINDOWS = "item_id string, w string, len int, grams array<struct<h: bigint, o: int>>"
_SCAN = "doc_id long, rid long, n_words long, hits array<struct<p: int, h: bigint, c: string, o: int>>"


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, w (the window's words), len, grams (shingle hash, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            items, ws, lens, gs = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                words = alnum_words(text)
                size = min(window, len(words))
                hashes = grams(ids.array(words), min(shingle, size)).view(np.int64) if size else []
                per = size - min(shingle, size) + 1
                for at in range(len(words) - size + 1 if size else 0):
                    items.append(item)
                    ws.append(b" ".join(words[at : at + size]).decode())
                    lens.append(size)
                    gs.append([{"h": int(hashes[at + o]), "o": o} for o in range(per)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(ws, pa.string()), pa.array(lens, pa.int32()),
                 pa.array(gs, pa.list_(pa.struct([("h", pa.int64()), ("o", pa.int32())])))],
                names=["item_id", "w", "len", "grams"],
            )

    return benchmark.select(benchmark["item_id"].cast("string"), benchmark["text"].cast("string")).mapInArrow(run, _WINDOWS)


def _long_runs(found: np.ndarray, least: int) -> np.ndarray:
    """Of sorted positions, those in runs of at least ``least`` consecutive ones."""
    if least <= 1 or not len(found):
        return found
    cut = np.flatnonzero(np.diff(found) != 1) + 1
    starts = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([starts, [len(found)]]))
    return found[np.repeat(sizes >= least, sizes)]


def scan(docs: DataFrame, wanted: dict[int, tuple[np.ndarray, int]], window: int = WINDOW) -> DataFrame:
    """Documents with the positions of wanted shingles.

    ``wanted``: shingle length -> (sorted hashes, least run of such positions)."""
    bits = 22
    tables = {}
    for k, (hashes, least) in wanted.items():
        seen = np.zeros(1 << bits, bool)
        seen[hashes >> np.uint64(64 - bits)] = True
        tables[k] = (hashes, least, np.packbits(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        ready = {k: (h, least, np.unpackbits(seen).astype(bool)) for k, (h, least, seen) in tables.items()}
        back = window - 1
        for batch in batches:
            n_words, hits = [], []
            for text in texts(batch.column(2)):
                words = alnum_words(text)
                n_words.append(len(words))
                own = []
                array = ids.array(words)
                for k, (hashes, least, seen) in ready.items():
                    g = grams(array, k)
                    if not len(g):
                        continue
                    at = np.flatnonzero(seen[g >> np.uint64(64 - bits)])
                    if len(at):
                        where = np.searchsorted(hashes, g[at])
                        where[where == len(hashes)] = 0
                        at = at[hashes[where] == g[at]]
                    for p in _long_runs(at, least).tolist():
                        first = max(0, p - back)
                        own.append({"p": p, "h": int(g[p].view(np.int64)), "c": b" ".join(words[first : p + window]).decode(), "o": p - first})
                hits.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([("p", pa.int32()), ("h", pa.int64()), ("c", pa.string()), ("o", pa.int32())])))],
                names=["doc_id", "rid", "n_words", "hits"],
            )

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("rid"), docs["text"].cast("string").alias("text"))
    return source.mapInArrow(run, _SCAN)


def _join_windows(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences: doc_id, rid, start, len, w."""
    seen = scanned.where(F.size("hits") > 0).select("doc_id", "rid", "n_words", F.explode("hits").alias("s"))
    seen = seen.select("doc_id", "rid", "n_words", "s.*")
    frequency = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # rarity order: each window's rarest shingle is its necessary prefix; a shingle that
    # no document has makes its window impossible, and such windows fall away
    tokens = windows.select("w", "len", F.explode("grams").alias("g")).select("w", "len", F.col("g.h").alias("h"), F.col("g.o").alias("at"))
    ranked = tokens.join(frequency, "h", "left").groupBy("w", "len").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("rarest")
    )
    prefix = ranked.where("rarest.n > 0").select("w", "len", F.col("rarest.h").alias("h"), F.col("rarest.at").alias("at"))
    met = seen.join(prefix, "h").where("p >= at AND o >= at AND p - at + len <= n_words")
    exact = F.array_join(F.expr("slice(split(c, ' '), o - at + 1, len)"), " ") == F.col("w")
    return met.where(exact).select("doc_id", "rid", (F.col("p") - F.col("at")).alias("start"), "len", "w")


def decontaminate(docs: DataFrame, benchmark: DataFrame, shipped: int = SHIPPED) -> DataFrame:
    """doc_id, rid, n_words, n_hit, n_items, items_sha256, contaminated: a row per document."""
    windows = staged(item_windows(benchmark), "leak-windows")
    distinct = windows.groupBy("w", "len").agg(F.first("grams").alias("grams"))
    total = distinct.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / shipped))
    found, base = [], None
    for block in range(blocks):
        part = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == block)
        # at most ``shipped`` hashes, more or less evenly dealt by hash
        rows = (
            part.select(F.least("len", F.lit(SHINGLE)).alias("k"), (F.size("grams")).alias("run"), F.explode("grams").alias("g"))
            .groupBy("k", F.col("g.h").alias("h")).agg(F.min("run").alias("run")).toPandas()
        )
        wanted = {
            int(k): (np.unique(g["h"].to_numpy(np.int64).view(np.uint64)), int(g["run"].min())) for k, g in rows.groupby("k")
        }
        scanned = staged(scan(docs, wanted), f"leak-scan{block}")
        base = scanned.select("doc_id", "rid", "n_words") if base is None else base
        found.append(_join_windows(scanned, part))
    exact = staged(reduce(DataFrame.unionByName, found), "leak-hits")

    spans = exact.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("s")).select(
        F.col("doc_id").alias("s_id"), F.col("rid").alias("s_rid"),
        F.expr(
            "aggregate(s, named_struct('n', 0L, 'end', 0), (a, x) -> named_struct("
            "'n', a.n + greatest(0, x.start + x.len - greatest(a.end, x.start)), 'end', greatest(a.end, x.start + x.len)), a -> a.n)"
        ).alias("n_hit"),
    )
    owners = windows.where("item_id IS NOT NULL").select(F.col("w").alias("i_w"), "item_id").distinct()
    items = (
        exact.select("doc_id", "rid", "w").distinct().join(owners, F.col("w") == F.col("i_w"))
        .groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(F.col("doc_id").alias("i_id"), F.col("rid").alias("i_rid"), "items")
    )
    joined = (
        base.join(spans, base["doc_id"].eqNullSafe(F.col("s_id")) & (base["rid"] == F.col("s_rid")), "left")
        .join(items, base["doc_id"].eqNullSafe(F.col("i_id")) & (base["rid"] == F.col("i_rid")), "left")
    )
    named = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        base["doc_id"], base["rid"], "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 AND {SHARE_DEN} * n_hit >= {SHARE_NUM} * n_words"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw USING (g, n)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
