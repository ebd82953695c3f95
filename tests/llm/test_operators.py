"""Each operator against brute force over a small corpus with every odd case: null and
empty texts, null ids and sources, repeated rows, very long texts, clashing columns."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlight.llm import (
    decontaminate, host_rules, license_scan, near_dedup, quality_model, sharding, source_mix, substring_dedup, token_prefix, warc,
)
from gridlight.llm.wordhash import alnum_words, space_words

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, size string, rid string, "
    "d string, spans int, key string, label string, part string, band string, n_words string, host string, score string, block string, copies string"
)


def _corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeghiklmnoprst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts: list[str | None] = [None, "", " \t\n ", "one", "Two words", base, base, base.upper(), base]
    for k in range(12):  # near copies, of falling similarity
        w = base.split()
        for j in rng.sample(range(len(w)), k):
            w[j] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(6)]
    texts += [prose(rng.randint(5, 200)) for _ in range(30)]
    texts += ["a" * 700, "ab" * 400, prose(60) + "\n" + "same line here\n" * 6, "x y z " * 40, prose(9000), "# | $ % " * 30]
    texts += [prose(20) + ". All rights reserved. " + prose(5), "Licensed under CC BY-NC 4.0. " + prose(30), "Released under the MIT License.\n" + prose(9), "the GNU General Public License, GENERAL public license"]
    texts += ["don't stop ÄÖÜ é 中文 😀 <|endoftext|> 12345\r\n\r\n  end  ", "\x1c\x85 odd ​ spaces\x0b"]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "en", "s1"), (None, None, None, None), (None, prose(80), "en", "s2")]
    return [(*r, len(r[1] or ""), *range(0, 1), *(["x"] * 3), "x", 1, *(["x"] * 9)) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents"
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(r) -> tuple:
    return (r is None, r or 0)


def _same(got, want) -> None:
    order = lambda rows_: sorted(rows_, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order(map(tuple, got)) == order(want)


def test_license_scan(docs, rows, empty):
    want = []
    for doc, text, *_ in rows:
        words = [w.decode() for w in alnum_words((text or "").encode())]
        starts, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        want.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    found = license_scan.scan(docs)
    _same(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), want)
    labels = {r.doc_id: r.labels for r in found.collect()}
    assert "mit" in labels.values() and "cc-by,cc-by-nc" in labels.values()
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert license_scan.scan(empty).count() == 0


def test_license_spans(spark):
    """The method's own labels against a plain alignment, over edited license texts."""
    rng, texts = random.Random(5), []
    longest = {k: max(v, key=len).split() for k, v in license_scan.LICENSES.items()}
    for label, words in longest.items():
        if len(words) < 20:
            continue
        mid = len(words) // 2
        noise = [f"n{rng.randint(0, 999)}" for _ in range(30)]
        texts += [
            (label, True, noise + words + noise), (label, True, noise + words[:mid] + ["x", "y", "z"] + words[mid:]),
            (label, True, words[: mid - 1] + words[mid + 1 :] + noise), (label, False, noise + words[:mid] + noise),
            (label, False, words[: mid // 2] + noise * 9 + words[mid:]), (label, False, rng.sample(words, len(words))),
        ]
    found = license_scan.scan(spark.createDataFrame([(i, " ".join(t)) for i, (*_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in found}
    for i, (label, whole, _) in enumerate(texts):
        assert (label in got[i].labels.split(",")) == whole, (i, label, got[i])
        assert got[i].score >= 0.75 if whole else got[i].score < 1 or got[i].base_labels


def test_source_mix(docs, rows, empty):
    found = source_mix.mix(docs, block=8)
    got = [tuple(r) for r in found.select("doc_id", "source", "size", "source_size", "target", "taken", "copies").collect()]
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    assert sorted(Counter((r[0], r[2]) for r in got).items(), key=str) == sorted(Counter((r[0], len((r[1] or "").encode().split())) for r in rows).items(), key=str)
    # the targets by iterated resharing
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
            open_.remove(s)
    largest = max(r[2] for r in got)
    for s in order:
        own = [r for r in got if r[1] == s]
        assert all(r[3] == sizes[s] and abs(r[4] - target[s]) < 1e-6 for r in own)
        assert abs(sum(r[5] for r in own) - target[s]) <= largest
    assert all(r[5] in (0, r[2], 2 * r[2]) for r in got)
    assert sorted(got, key=str) == sorted((tuple(r) for r in source_mix.mix(docs, block=8).select("doc_id", "source", "size", "source_size", "target", "taken", "copies").collect()), key=str)
    again = source_mix.mixed_documents(docs, block=8)
    assert again.columns == docs.columns and again.count() == sum(r[6] for r in got)
    assert source_mix.mix(empty).count() == 0


def test_quality_model(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=_key) == sorted((r[0] for r in rows), key=_key)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert {r.score for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(empty, labels).count() == 0


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality_model.op3_quality_model(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) >= 0.95 * len(labels)


def test_isotonic():
    knots, values = quality_model._isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 0.6, 0.4, 1.0]), np.array([1, 1, 1, 1]))
    assert list(knots) == [1.0, 2.5, 4.0] and list(values) == [0.0, 0.5, 1.0]
    rng = np.random.default_rng(2)
    y, w = rng.random(60), rng.integers(1, 5, 60)
    knots, values = quality_model._isotonic(np.arange(60.0), y, w)
    mean = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
    want = [max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]  # the minimax formula
    assert np.allclose(values, sorted(set(np.round(want, 12))))
    assert all(a < b for a, b in zip(knots, knots[1:]))


def test_quality_equations(spark):
    """Ridge and calibration against a direct solution over all learning rows in memory."""
    sf, q = "/root/testdata/sf0.001", quality_model
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = q.document_statistics(docs).withColumn("spare", F.pmod(F.xxhash64("x"), F.lit(q.FOLDS)) == 0)
    rows = stats.join(labels, "doc_id").where(~q.held_out(stats)).collect()
    x, y, spare = np.array([r.x for r in rows]), np.array([r.quality for r in rows], float), np.array([r.spare for r in rows])
    assert q.FOLDS <= spare.sum() < len(rows)
    mean, scale = x[~spare].mean(0), x[~spare].std(0)
    scale[scale < 1e-9] = 1.0
    f = q.fourier(x, mean, scale)
    own = f[~spare]
    weights = np.linalg.solve(own.T @ own + q.RIDGE * len(own) / f.shape[1] * np.eye(f.shape[1]), own.T @ y[~spare])
    model = q.fit(stats.join(labels.withColumn("y", F.col("quality").cast("double")), "doc_id").where(~q.held_out(stats)).select("x", "y").repartition(40))
    assert np.allclose(model.raw(x), f @ weights, atol=1e-6)
    raw = f[spare] @ weights
    bins = np.clip(((raw + 0.5) / 2 * q.BINS).astype(int), 0, q.BINS - 1)
    held = sorted(set(bins))
    n = np.array([(bins == b).sum() for b in held])
    knots, values = q._isotonic(np.array([raw[bins == b].mean() for b in held]), np.array([(y[spare][bins == b].sum() + 0.5) / (k + 1) for b, k in zip(held, n)]), n + 1)
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.values, values)
    order = np.argsort(model.raw(x), kind="stable")
    assert (np.diff(model.score(x)[order]) >= 0).all() and len(set(model.score(x).tolist())) > 10
    # nothing but the text enters a score
    score = {(r.doc_id, r.rid): r.score for r in q.classify(docs, labels).collect()}
    other = docs.withColumn("lang", F.lit("x")).withColumn("source", F.col("doc_id").cast("string")).withColumn("quality", F.col("doc_id") % 2).repartition(7)
    assert score == pytest.approx({(r.doc_id, r.rid): r.score for r in q.classify(other, labels).collect()})
    flipped = labels.withColumn("quality", F.when(q.held_out(labels), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert score == pytest.approx({(r.doc_id, r.rid): r.score for r in q.classify(docs, flipped).collect()})


@pytest.mark.parametrize("payload", [("doc_id",), tuple(SCHEMA.split()[0::2])])
def test_sharding(docs, rows, empty, payload):
    found = sharding.shard(docs, payload=payload, bucket_rows=10, bucket_bytes=20_000)
    got = found.collect()
    facts = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], *facts(r[1])) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(40))
    assert sharding.shard(empty, payload=payload).count() == 0


def test_sharding_writes_records(spark, rows, tmp_path, monkeypatch):
    kept, written, write = ["doc_id", "text", "lang", "source", "n_chars"], [], sharding.write_shards

    def changed(placed, path):
        written.append(path)
        write(placed.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!"))), path)

    monkeypatch.setattr(sharding, "write_shards", changed)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sharding.op4_sharding(spark, f"file://{tmp_path}").collect()
    # the result is that of the records in the shards
    facts = lambda t: (len((t or "").encode()) + 17, zlib.crc32((t or "").encode() + b"!"))
    assert len(written) == 1 and Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], *facts(r[1])) for r in rows)
    stored = spark.read.parquet(written[0]).collect()
    assert Counter(tuple(r[c] for c in kept if c != "text") for r in stored) == Counter((r[0], *r[2:5]) for r in rows)
    assert Counter((r.doc_id, r.shard, r.slot) for r in stored) == Counter((r.doc_id, r.shard, r.slot) for r in got)

    monkeypatch.setattr(sharding, "write_shards", lambda placed, path: (written.append(path), write(placed, path, 3)))
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    got = sharding.stored(docs, n_shards=7, bucket_bytes=20_000).collect()
    files = defaultdict(list)
    for r in spark.read.parquet(written[1]).withColumn("file", F.input_file_name()).collect():
        files[r.shard, r.file].append(r)
    assert all(len(f) <= 3 and [r.slot for r in f] == sorted(r.slot for r in f) for f in files.values())
    assert Counter(tuple(r[c] for c in kept) for f in files.values() for r in f) == Counter(r[:5] for r in rows)
    assert Counter((r.doc_id, r.shard, r.slot) for f in files.values() for r in f) == Counter((r.doc_id, r.shard, r.slot) for r in got)
    assert sharding.stored(docs.limit(0)).count() == 0


def test_host_rules(docs, rows, empty):
    facts = []
    for doc, text, _, source, *_ in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        seen = Counter(zip(words, words[1:], words[2:]))
        hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        facts.append((doc, source, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed))
    found = host_rules.apply_host_rules(docs)
    cols = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    _same(found.select(*cols).collect(), facts)
    for r in found.collect():
        assert r.kept == (not r.base_failed and not r.host_failed)
    assert host_rules.apply_host_rules(docs, limit=1.0).where("kept = base_failed").count() == 0
    assert host_rules.apply_host_rules(empty).count() == 0


def test_substring_dedup(docs, rows, empty):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for (doc, *_), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        want.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    _same(substring_dedup.remove_repeats(docs).drop("kept").collect(), want)
    _same(substring_dedup.remove_repeats(docs, group=2).drop("kept").collect(), want)  # by aggregates
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_segments(monkeypatch):
    text = bytes(random.Random(1).choices(b"abc ", k=5000))
    whole = [tuple(map(int, x)) for p in substring_dedup.phrases(text) for x in zip(*p)]
    monkeypatch.setattr(substring_dedup, "SEGMENT", 700)
    parts = [tuple(map(int, x)) for p in substring_dedup.phrases(text) for x in zip(*p)]
    assert {x[2] for x in whole} == {x[2] for x in parts}  # same cores
    assert sorted(s for lo, hi, *_ in parts for s in range(lo, hi + 1)) == list(range(len(text) - 199))
    assert all(0 <= x[4] <= 120 and x[0] + x[4] >= x[1] for x in parts)


def _components(sets: dict, percent: int = 80) -> dict:
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def _pieces(texts: list[bytes]) -> tuple[list, list, list]:
    """core, trigger and bytes of all phrases."""
    found = [(int(c), int(m), t[lo : hi + 200]) for t in texts for p in substring_dedup.phrases(t) for lo, hi, c, _, m in zip(*p)]
    core, at, pieces = zip(*sorted(found))
    return list(core), list(at), list(pieces)


def test_repeated_runs_memory():
    rng = random.Random(8)
    shared = rng.randbytes(260)
    core, at, pieces = _pieces([rng.randbytes(30) + shared[k % 40 : k % 40 + 205] + rng.randbytes(20) for k in range(9000)])
    tracemalloc.start()
    row, first, last = substring_dedup._repeated_runs([1] * len(pieces), at, pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    places = Counter(p[i : i + 200] for p in pieces for i in range(len(p) - 199))
    want = [[i for i in range(len(p) - 199) if places[p[i : i + 200]] > 1] for p in pieces]
    got = [[] for _ in pieces]
    for r, a, b in zip(row.tolist(), first.tolist(), last.tolist()):
        got[r] += range(a, b + 1)
    assert got == want and sum(map(len, want)) > 30_000
    assert peak < 200e6


@pytest.mark.parametrize("alphabet", [b"ab", b"\0a", b"abcdefgh"])
def test_repeated_strings_of_phrases(alphabet):
    """Phrases that differ near their ends, at zero bytes, and cut short by the text's ends."""
    rng = random.Random(alphabet[1])
    base = bytes(rng.choices(alphabet, k=500))
    texts = [base[rng.randint(0, 200) : rng.randint(380, 500)] for _ in range(30)]
    texts += [bytes(rng.choices(alphabet, k=k % 4)) + base[k : k + 203 + k % 7] + b"\0" * (k % 3) for k in range(120)]
    core, at, pieces = _pieces(texts)
    n = [1] * len(pieces)
    places = Counter(p[i : i + 200] for p in pieces for i in range(len(p) - 199))
    got = {(r, i) for r, a, b in zip(*map(np.ndarray.tolist, substring_dedup._repeated_runs(n, at, pieces))) for i in range(a, b + 1)}
    assert got == {(r, i) for r, p in enumerate(pieces) for i in range(len(p) - 199) if places[p[i : i + 200]] > 1}


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(docs, rows, empty, shingle):
    size, sets = {}, {}
    for doc, text, *_ in rows:
        sets_of = near_dedup._shingles((text or "").encode(), shingle)
        if doc is not None:
            sets[doc] = sets_of
    comp = _components(sets)
    for r in near_dedup.near_duplicates(docs, shingle=shingle).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(docs, shingle=shingle).count() == len(rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_recall(spark):
    sf = "/root/testdata/sf0.01"
    sets = {r.doc_id: near_dedup._shingles((r.text or "").encode(), 4) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.component_id for r in near_dedup.op7_near_dedup(spark, sf).collect()}
    assert got == _components(sets)


def test_near_duplicates_equal_sets(spark):
    """Equal sets of different word sequences, and ids that several texts share."""
    loop = "a b c d e f g h i j".split()
    texts = [(k, " ".join(loop * (3 + k % 4))) for k in range(12)] + [(20, "other words stand here now"), (20, "and not the same at all"), (21, "and not the same at all")]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=4).collect()
    assert [r.component_id for r in sorted(got) if r.doc_id < 12] == [0] * 12 and {r.n_shingles for r in got if r.doc_id < 12} == {10}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id > 12} == {(20, 20), (21, 20)} and len(got) == len(texts)


def test_near_duplicates_chain(spark):
    """A chain whose ends differ, and a crowd of near copies: links beyond the stars."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for k in range(40):  # a sliding window: neighbours agree, ends do not
        texts.append([f"c{j}" for j in range(k * 6, k * 6 + 200)])
    for _ in range(60):
        w = list(base)
        for j in rng.sample(range(200), rng.randint(0, 9)):
            w[j] = rng.choice(words)
        texts.append(w)
    rng.shuffle(texts)
    sets = {i: near_dedup._shingles(" ".join(t).encode(), 4) for i, t in enumerate(texts)}
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), shingle=4)
    assert {r.doc_id: r.component_id for r in got.collect()} == _components(sets)


def test_odd_sketch_limit():
    assert near_dedup.xor_limit(1.0) < near_dedup.xor_limit(0.9) < near_dedup.xor_limit(0.8) < near_dedup.BITS // 2


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(docs, rows, empty, library):
    path, theirs = library
    count = lambda t: len(theirs.encode(t, add_special_tokens=False).ids)
    want = [(r[0], len((r[1] or "").encode()), n := count(r[1] or ""), n > 512) for r in rows]
    _same(token_prefix.token_counts(docs, path).drop("fit_chars").collect(), want)
    assert token_prefix.token_counts(empty, path).count() == 0


def test_token_prefixes(library):
    path, theirs = library
    own, rng = token_prefix.tokenizer(path), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "é", "1", "23", "!", "'s", "'ll", "'", "<|endoftext|>", "<|end", "\x1c", "\x85", "中", "😀", "the", "ing", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        table = [len(theirs.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        mine = token_prefix.PrefixCounts(own, text)
        assert [mine.at(p) for p in range(len(text) + 1)] == table
        for budget in (0, 1, 3, 6):
            assert mine.fit(budget) == max(p for p, n in enumerate(table) if n <= budget)


def test_token_prefix_tables(library, monkeypatch):
    path, theirs = library
    own, built = token_prefix.PrefixTokenizer(path), []
    table = own.table
    monkeypatch.setattr(own, "table", lambda word: built.append(word) or table(word))
    for part, tail in (("=", ""), ("=-", " end"), (" ", "x"), ("\n", ""), (" \t", " y"), ("中é", "."), ("ab", "'ll"), ("\x1c", "a")):
        text = "start" + part * (400 // len(part)) + tail
        want = [len(theirs.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        built.clear()
        mine = token_prefix.PrefixCounts(own, text)
        for budget in (1, 2, 4, 9, 50):
            assert mine.fit(budget) == max(p for p, n in enumerate(want) if n <= budget)
        assert [mine.at(p) for p in range(len(text) + 1)] == want
        assert len(built) <= 16, "a table for each pre-token, not for each cut"
    assert own.totals.chars == sum(map(len, own.totals)) - sum(map(len, own.special)) < 5000
    few = token_prefix._Totals(own, 100, max_chars=50)
    assert [few["b" * n] for n in range(1, 60)] == [own.total(b"b" * n) for n in range(1, 60)]
    assert sum(map(len, few)) <= 50 + sum(map(len, own.special))


def test_token_long_runs(library):
    path, theirs = library
    own = token_prefix.PrefixTokenizer(path)
    for text in ("a" * 30_000, "=" * 30_000 + " end"):
        mine = token_prefix.PrefixCounts(own, text)
        assert mine.total == len(theirs.encode(text, add_special_tokens=False).ids)
        cut = mine.fit(99)
        fits = lambda n: len(theirs.encode(text[:n], add_special_tokens=False).ids) <= 99
        assert fits(cut) and not fits(cut + 1)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}])
def test_token_files_refused(library, change):
    import json

    with pytest.raises(ValueError):
        token_prefix._check(json.load(open(library[0])) | change)


def test_decontaminate(spark, docs, rows, empty):
    passage = next(r[1] for r in rows if r[1] and len(r[1].split()) == 120 and r[0] == 21)
    items = [(1, " ".join(passage.split()[30:70])), (2, "Two, WORDS"), (3, None), (4, "..."), (10, " ".join(passage.split()[40:58])), (None, "one"), (5, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for item, text in items:
        w = alnum_words((text or "").encode())
        n = min(13, len(w))
        windows += [(tuple(w[i : i + n]), item) for i in range(len(w) - n + 1 if n else 0)]
    want = []
    for doc, text, *_ in rows:
        w, hit, found = alnum_words((text or "").encode()), set(), set()
        places = defaultdict(list)
        for n in {len(x) for x, _ in windows}:
            for i in range(len(w) - n + 1):
                places[tuple(w[i : i + n])].append(i)
        for x, item in windows:
            for i in places.get(x, ()):
                hit |= set(range(i, i + len(x)))
                found |= {str(item)} - {"None"}
        want.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    _same(decontaminate.decontaminate(docs, bench).drop("rid").collect(), want)
    _same(decontaminate.decontaminate(docs, bench, shipped=7).drop("rid").collect(), want)  # in blocks
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "ü" * 200_000
    pages = [(1, "http://a/x y", "<b>" * 60), (2, None, "<b>" * 60), (3, "http://b", "short"), (4, "u", "short"), (5, "u", None), (6, "u\r\nX: y", big), (None, "n", "<b>" * 60), (1, "again", "<b>" * 60), (7, "", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(df, folder, archive_bytes=2000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages)
    want = []
    for page, _, html in pages:
        body = (html or "").encode()
        first = min((p for p, _, h in pages if h == html and p is not None), default=None)
        revisit = len(body) >= 100 and first is not None and page != first
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    _same(warc.read_archives(spark, folder).collect(), want)
    none = f"file://{tmp_path}/e"
    warc.write_archives(df.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_warc_detects_damage():
    import gzip

    body = b"x" * 300
    good = warc.record(1, "u", body, hashlib.sha256(body).hexdigest(), None)
    pack = lambda raw: memoryview(gzip.compress(raw))
    assert [(h["WARC-Type"], n) for h, n, _ in warc.read_records(pack(good))] == [("response", 300)]
    for bad in (good.replace(b"xxx", b"xyx", 1), good.replace(b"Content-Length: 3", b"Content-Length: 2", 1), good[:-3]):
        with pytest.raises(ValueError):
            list(warc.read_records(pack(bad)))
    with pytest.raises(ValueError):
        list(warc.read_records(pack(good)[:-20]))


def test_word_splits():
    import re

    text = "Ab\x0bC\x1cd É-ß_9 x\n"
    low = text.translate({c: c + 32 for c in range(65, 91)})
    assert [w.decode() for w in space_words(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", low)
    assert [w.decode() for w in alnum_words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
