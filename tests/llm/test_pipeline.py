import corpus_pipeline
from gridlight.llm.common import row_key
from gridlight.llm.quality_model import classify


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), f"test-{k}")
        if k < 4:
            assert docs.columns == columns, name
        if k < 3:
            assert 0 < docs.count() <= before, name
            assert docs.select("doc_id").distinct().count() == docs.count()
            before = docs.count()
    rows = docs.select("shard", "slot").collect()
    assert len(set(map(tuple, rows))) == len(rows) > 0


def test_near_dedup_of_odd_ids(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [
        (1, text(1), "en"), (1, text(2), "en"), (1, text(2), "en"),  # one id, two texts, one twice
        (5, text(3), "en"), (2, text(3), "en"), (2, text(4), "en"),  # the smallest id of text 3 is a shared one
        (None, text(5), "en"), (None, text(5), "en"), (None, text(6), "en"), (7, text(6), "en"),
        (None, None, "en"), (9, text(8), "en"), (8, text(8) + " end", "en"), ((1 << 63) - 1, text(9), "en"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    want = [
        (1, text(1)), (1, text(2)), (2, text(3)), (2, text(4)), (None, text(5)), (7, text(6)), (None, None),
        (8, text(8) + " end"), ((1 << 63) - 1, text(9)),
    ]
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_benchmark_windows_in_long_documents(spark, tmp_path):
    prose = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    item = prose(99, 30)
    rows = [(1, prose(1, 4000)), (2, f"{prose(2, 3000)} {item} {prose(3, 3000)}"), (3, item), (4, None), (None, f"{prose(4, 900)} {prose(99, 13)}"), (None, prose(99, 12))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/d")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    got = corpus_pipeline.benchmark_free(spark, docs, f"file://{tmp_path}")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[5]], key=str)


def _odd_tables(spark, root, docs, labels, items):
    clash = "rid long, size long, source_size long, target double, score double, predicted int, kept boolean, k long, copies long, rec string, n_hit long, bucket long, word string"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {clash}"
    blank = (None,) * (len(clash.split(",")) - 1)
    rows = [(*d, "en", None if d[0] is None else f"src{d[0] % 3}", None, *blank, "w") for d in docs]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{root}/benchmark.parquet")
    return f"file://{root}"


def test_odd_rows_through_all_stages(spark, tmp_path):
    prose = lambda k, n=80: " ".join(f"{'abcdefgh'[(k * 7 + i * i) % 8]}word{k}x{i}" for i in range(n)).capitalize() + "."
    junk = lambda k: "### $$$ !!! ||| " * 10 + f"<<{k}>>"
    item = prose(900, 30)
    good, bad = [(k, prose(k)) for k in range(100, 160)], [(k, junk(k)) for k in range(200, 260)]
    odd = [
        (None, None), (None, ""), (None, prose(1)), (None, prose(1)), (300, None), (301, ""), (302, " \n\t "),
        (100, prose(100)), (400, prose(100)), (401, prose(100) + " More."),  # a repeated row, a copy, a near copy
        (402, f"{prose(402)} {item} {prose(403)}"), (403, prose(404, 60_000)), (404, "ü\U0001f600 " * 50),
    ]
    labels = [(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(None, 1, 0), (300, None, None), (100, 1, 0)]
    root = _odd_tables(spark, tmp_path, good + bad + odd, labels, [(1, item), (None, None), (2, ""), (3, item)])
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, root), f"odd-{k}")
        assert k == 4 or docs.columns == columns, name
        seen[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)

    # the classifier's verdicts, and every row of an accepted text
    verdict = {(r.doc_id, r.rid): r.predicted for r in classify(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")).collect()}
    every = spark.read.parquet(f"{root}/documents.parquet")
    keyed = [(r.doc_id, r.text, r.key) for r in every.select("doc_id", "text", row_key(every).alias("key")).collect()]
    assert seen["quality classifier"] == sorted(((i, t) for i, t, key in keyed if verdict[i, key] == 1), key=str)
    assert set(good) <= set(seen["quality classifier"]) and not set(bad) & set(seen["quality classifier"])

    # one of each group, the smallest id; by brute force on sets of five words
    def shingles(text):
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    left = seen["quality classifier"]
    nodes = sorted(set(left), key=lambda d: (d[0] is None, d[0] or 0, str(d[1])))
    sets, group = [shingles(t) for _, t in nodes], list(range(len(nodes)))
    for a in range(len(nodes)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert seen["near-duplicates"] == sorted((nodes[g] for g in set(group)), key=str)
    assert seen["benchmark decontamination"] == [d for d in seen["near-duplicates"] if d[0] != 402]
    assert {402} <= {i for i, _ in seen["near-duplicates"]}

    clean, mixed = seen["benchmark decontamination"], seen["source mixing"]
    assert set(mixed) <= set(clean) and all(mixed.count(d) <= 2 and (t or "").split() for d in set(mixed) for t in [d[1]])
    assert seen["sharding"] == mixed
    slots = [(r.shard, r.slot) for r in docs.select("shard", "slot").collect()]
    assert all(0 <= s < 40 for s, _ in slots) and len(set(slots)) == len(slots)
    assert all({b for a, b in slots if a == s} == set(range(sum(a == s for a, _ in slots))) for s in {a for a, _ in slots})


def test_empty_tables(spark, tmp_path):
    docs = corpus_pipeline.run(spark, _odd_tables(spark, tmp_path, [], [], []))
    assert docs.count() == 0 and {"doc_id", "text", "shard", "slot"} <= set(docs.columns)
