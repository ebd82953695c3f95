"""Removal of repeated 200-byte strings by prefix-free parsing.

A rolling hash of 12 bytes marks, for each 200-byte string, one trigger inside it: the
leftmost smallest hash among the string's first ``REACH`` places.  It depends on the string
alone, so equal strings share their trigger at the same offset.  The text is thereby parsed
into phrases: runs of string starts with one trigger, about 60 bytes apart.  A phrase holds
all bytes of its strings, so neighbours overlap and no string leaves its phrase; its core
are the bytes that all its strings contain.

- The parse is a row per phrase.  A core that occurs once has no repeated string.
- The dictionary are the distinct phrases with their numbers of occurrences in the parse.
  Where a phrase occurs twice, all its strings do.
- Only where one core has several phrases, some of which occur once, are strings
  compared.  The dictionary's suffixes from the trigger on are sorted (a suffix array with
  common prefix lengths), and so are the bytes before the trigger, read backwards.  A
  string that starts j bytes before its trigger is then a pair of ranks, of depth j on one
  side and 200 - j on the other; equal pairs are equal strings, by their bytes.  The parse
  says how often and where each occurs.  The suffix array of the parse itself would only
  order strings beyond the ends of their phrases, which 200 bytes never reach.

Cores are dealt to tasks; a core with more than ``GROUP`` phrases is compared by an aggregate
over 128-bit digests of its strings instead, which no hot core can overload.  Hot cores
and phrases meet broadcast keys of a bounded number.

Defined results: null text is empty; texts below 200 bytes keep everything; very long
texts are parsed segment by segment, with equal results; repeated rows count as
occurrences of each other; null ids are kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import having, join_keys, row_key, staged, table
from .wordhash import finish, texts

LENGTH = 200
GRAM, REACH = 12, 121
CORE = LENGTH - REACH + 1
#: Phrases of one core that a task compares in memory; more are compared by aggregates.
GROUP = 16_384
#: Phrases compared at once, but for those of one core, and pieces or strings handed on in a batch.
HELD, HANDED = 4_096, 16_384
#: String starts handled at once, for bounded memory on very long texts.
SEGMENT = 1 << 19

_PLACE = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _setup() -> dict[str, np.ndarray]:
    if not _tables:
        rng = np.random.default_rng(3)
        with np.errstate(over="ignore"):
            _tables["byte"] = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
            _tables["power"] = _powers(_BASE, SEGMENT + 2 * LENGTH)
            _tables["inverse"] = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + 2 * LENGTH)
    return _tables


def _sliding_min(x: np.ndarray, reach: int) -> np.ndarray:
    size = 1
    while 2 * size <= reach:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = reach - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrases(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, last start, core hash, extent hash, trigger from the first start) of the
    phrases, segment-wise."""
    t = _setup()
    byte, power, inverse = t["byte"], t["power"], t["inverse"]
    data = np.frombuffer(text, np.uint8)
    n = len(data) - LENGTH + 1
    p = np.uint64(_BASE)
    with np.errstate(over="ignore"):
        p2, p4 = p * p, p * p * p * p
        for at in range(0, n, SEGMENT):
            starts = min(SEGMENT, n - at)
            v = byte[data[at : at + starts + LENGTH - 1]]
            h = v[:-1] * p + v[1:]
            h = h[:-2] * p2 + h[2:]
            h = h[:-4] * p4 + h[4:]  # 8 bytes
            q = v[:-1] * p + v[1:]
            q = q[:-2] * p2 + q[2:]
            h = finish(h[:-4] * p4 + q[8 : 8 + len(h) - 4])  # and 4 more
            h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            trigger = (_sliding_min(h, REACH)[:starts] & _PLACE).astype(np.int64)
            first = np.flatnonzero(np.diff(trigger, prepend=-1))
            last = np.append(first[1:], starts) - 1
            mark = trigger[first]
            total = np.zeros(len(v) + 1, np.uint64)
            np.cumsum(v * power[: len(v)], out=total[1:])
            core = finish((total[mark + CORE] - total[mark]) * inverse[mark])
            extent = (total[last + LENGTH] - total[first]) * inverse[first]
            extent = finish(extent + ((mark - first) * 4096 + last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            yield at + first, at + last, core.view(np.int64), extent.view(np.int64), mark - first


def parse(docs: DataFrame) -> DataFrame:
    """A row per phrase: d (row key), lo, hi (first and last start), core, extent (hashes) and
    at (the trigger, from lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, parts = [], ([], [], [], [], [])
            for text in texts(batch.column(1)):
                size = 0
                if len(text) >= LENGTH:
                    for piece in phrases(text):
                        size += len(piece[0])
                        for held, x in zip(parts, piece):
                            held.append(x)
                sizes.append(size)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            kinds = (np.int32, np.int32, np.int64, np.int64, np.int16)
            columns = [np.concatenate(x).astype(k) if x else np.empty(0, k) for x, k in zip(parts, kinds)]
            values = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["lo", "hi", "core", "extent", "at"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], names=["d", "p"])

    keyed = docs.select(row_key(docs).alias("d"), docs["text"].cast("string").alias("text"))
    found = keyed.mapInArrow(run, "d long, p array<struct<lo: int, hi: int, core: bigint, extent: bigint, at: smallint>>")
    return found.select("d", F.explode("p").alias("p")).select("d", "p.*")


def _asked_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """d, asked (the wanted ranges of a text), text: a row per text that has any."""
    fields = [c for c in wanted.columns if c != "d"]
    asked = staged(wanted.groupBy("d").agg(F.collect_set(F.struct(*fields)).alias("asked")).withColumnRenamed("d", "a_d"), "span-asked")
    read = docs.select(row_key(docs).alias("d"), docs["text"].cast("string").alias("text"))
    few = having(read, F.col("d"), asked, "a_d")
    return asked.join(read if few is None else few, F.col("a_d") == F.col("d")).select("d", "asked", "text")


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and how many bytes each shares with the row before it there."""
    wide = np.ascontiguousarray(rows).view(">u8")
    order = np.lexsort(wide.T[::-1])
    differs = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], shared]).astype(np.int16)


def _ranks(order: np.ndarray, shared: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Matrix row x depth: rank of each row's first ``depth`` bytes."""
    found = np.empty((len(order), len(depth)), np.int32)
    found[order] = np.cumsum(shared[:, None] < depth, axis=0, dtype=np.int32)
    return found


def _repeated_runs(n: list, at: list, pieces: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): runs of string starts in pieces that occur once as phrases and
    whose strings occur elsewhere among the pieces.  ``at``: the trigger's place in a piece."""
    k, before = len(pieces), np.array(at, np.int64)
    left, right = np.zeros((k, REACH + 7 & ~7), np.uint8), np.zeros((k, LENGTH), np.uint8)
    for i, (mark, piece) in enumerate(zip(at, pieces)):
        left[i, :mark] = np.frombuffer(piece, np.uint8, mark)[::-1]
        right[i, : len(piece) - mark] = np.frombuffer(piece, np.uint8, -1, mark)
    after = np.fromiter(map(len, pieces), np.int64, k) - before
    back = np.arange(REACH, dtype=np.int16)  # a string's start, in bytes before the trigger
    there = (back <= before[:, None]) & (LENGTH - back <= after[:, None])
    key = _ranks(*_order(left), back).astype(np.int64)
    key *= k + 1
    key += _ranks(*_order(right), LENGTH - back)
    key *= REACH
    key += back
    times = np.array(n, np.float64)
    _, group = np.unique(key[there], return_inverse=True)
    often = np.bincount(group, np.repeat(times, there.sum(axis=1)))[group] > 1
    hit = np.zeros_like(there)
    hit[there] = often
    hit &= (times == 1)[:, None]
    hit = hit[:, ::-1]  # in the order of starts
    edge = np.zeros((k, 1), bool)
    row, first = np.nonzero(hit & ~np.hstack([edge, hit[:, :-1]]))
    _, last = np.nonzero(hit & ~np.hstack([hit[:, 1:], edge]))
    move = before[row] - (REACH - 1)
    return row, first + move, last + move


def _compared(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """d, a, b: bytes covered by repeated strings of the wanted phrases (core, n, at, d, lo, hi),
    found core by core among the phrases' bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [], [])

        def handed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int16(), pa.binary())
            found = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["core", "d", "lo", "n", "at", "piece"])
            for held in out:
                held.clear()
            return found

        for batch in batches:
            for d, asked, text in zip(batch.column(0).to_pylist(), batch.column(1), texts(batch.column(2))):
                for a in asked.as_py():
                    for held, x in zip(out, (a["core"], d, a["lo"], a["n"], a["at"], text[a["lo"] : a["hi"] + LENGTH])):
                        held.append(x)
                if len(out[0]) >= HANDED:
                    yield handed()
        yield handed()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            _, d, lo, n, at, piece = zip(*held)
            row, first, last = _repeated_runs(n, at, piece)
            d, lo = np.array(d, np.int64)[row], np.array(lo, np.int64)[row]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(d), pa.array((lo + first).astype(np.int32)), pa.array((lo + last + LENGTH).astype(np.int32))], names=["d", "a", "b"]
            )

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= HELD and held[-1][0] != r[0]:
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    pieces = _asked_texts(wanted, docs).mapInArrow(cut, "core long, d long, lo int, n long, at short, piece binary")
    return pieces.repartition("core").sortWithinPartitions("core").mapInArrow(compare, "d long, a int, b int")


def _strings(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """d, s, k1, k2 (128-bit digest of the string), n (occurrences of its extent): a row per
    string start.  Repeated rows of a text double only strings with n > 1, which are
    known to be repeated anyway."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ds, ss, keys, ns = [], [], [], []

        def handed() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            found = pa.RecordBatch.from_arrays(
                [pa.array(ds, pa.int64()), pa.array(ss, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ns, pa.int64())],
                names=["d", "s", "k1", "k2", "n"],
            )
            for held in (ds, ss, keys, ns):
                held.clear()
            return found

        for batch in batches:
            for d, asked_of, text in zip(batch.column(0).to_pylist(), batch.column(1), texts(batch.column(2))):
                for a in asked_of.as_py():
                    for s in range(a["lo"], a["hi"] + 1):
                        ds.append(d), ss.append(s), ns.append(a["n"])
                        keys.append(hashlib.blake2b(text[s : s + LENGTH], digest_size=16).digest())
                    if len(ds) >= HANDED:
                        yield handed()
        yield handed()

    return _asked_texts(wanted, docs).mapInArrow(run, "d long, s int, k1 long, k2 long, n long")


def repeated_pieces(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """d and ``pieces``: ranges [a, b) of bytes covered by repeated strings, in order."""
    parsed = staged(parse(docs), "span-parse")
    cores = parsed.groupBy(F.col("core").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = join_keys(parsed, staged(cores, "span-cores"), {"core": "c"}).select("d", "lo", "hi", "core", "extent", "at")
    held = staged(held, "span-phrases")
    dictionary = held.groupBy("core", "extent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "lo", "hi", "at")).alias("one"))
    dictionary = staged(dictionary, "span-dictionary")
    twice = dictionary.where("n > 1").select(F.col("core").alias("c"), F.col("extent").alias("e"), "n")
    whole = join_keys(held, twice, {"core": "c", "extent": "e"}).select("d", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b"))

    open_cores = dictionary.groupBy(F.col("core").alias("c")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1")
    asked = join_keys(dictionary, staged(open_cores, "span-cores2"), {"core": "c"}, n="k").select("core", "n", "k", "one.*")
    asked = staged(asked, "span-open")
    few, many = asked.where(F.col("k") <= group).drop("k"), asked.where(F.col("k") > group).drop("k", "core", "at")
    near = staged(_compared(few, docs), "span-near")
    strings = staged(_strings(many, docs), "span-strings")
    twice = strings.groupBy("k1", "k2").agg(F.sum("n").alias("total")).where("total > 1").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    single = strings.where("n = 1").join(twice, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left_semi")
    single = single.select("d", F.col("s").alias("a"), (F.col("s") + LENGTH).alias("b"))
    return whole.unionByName(near).unionByName(single).groupBy("d").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("pieces"))


def _runs(pieces: list | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted pieces; pieces that touch are one."""
    found: list[tuple[int, int]] = []
    for x in pieces or ():
        if found and x["a"] <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], x["b"]))
        else:
            found.append((x["a"], x["b"]))
    return found


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spans = staged(repeated_pieces(docs, group).withColumnRenamed("d", "s_d"), "span-runs")
    wide = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("d"), docs["text"].cast("string").alias("text"))
    touched, whole = having(wide, F.col("d"), spans, "s_d"), having(wide, F.col("d"), spans, "s_d", anti=True)
    if touched is None or whole is None:
        joined = wide.join(spans, F.col("d") == F.col("s_d"), "left").select("doc_id", "text", "pieces")
    else:  # texts without a span need not be shuffled
        joined = touched.join(spans, F.col("d") == F.col("s_d")).select("doc_id", "text", "pieces")
        joined = joined.unionByName(whole.select("doc_id", "text", F.lit(None).cast(spans.schema["pieces"].dataType).alias("pieces")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, pieces in zip(texts(batch.column(1)), batch.column(2)):
                kept, at, runs = [], 0, _runs(pieces.as_py())
                for first, last in runs:
                    kept.append(text[at:first])
                    at = last
                left = b"".join([*kept, text[at:]])
                for held, value in zip(out, (len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left)):
                    held.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
