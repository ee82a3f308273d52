"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    import random


    words = ["stone", "river", "cloud", "forest", "meadow", "harbour", "winter", "lantern", "garden", "thunder"]
    text = lambda k: " ".join(random.Random(k).choices(words, k=90)) + "."
    rows = [(k, text(k), "en", f"s{k % 3 if k % 2 else 0}", 1) for k in range(80)]
    rows += [(100 + k, text(k), "en", "s0", 1) for k in range(5)]  # copies
    rows += [(200 + k, text(k) + " tail", "en", "s1", 1) for k in range(5)]  # near copies
    bad = [(300 + k, text(k + 500).upper().replace(" ", "!! "), "en", "s2", 1) for k in range(30)]
    docs = spark.createDataFrame([*rows, *bad], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", (F.col("doc_id") < 300).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now)
        if k < 4:
            assert set(now.columns) == set(corpus_pipeline.COLUMNS)
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    assert ids[0] == sorted(r[0] for r in rows)
    assert ids[1] == sorted([*range(80), *range(200, 205)])
    assert set(ids[2]) <= set(ids[1]) and set(range(5)) <= set(ids[2]) and len(ids[2]) < len(ids[1])
    assert set(ids[3]) == set(ids[2]) and len(ids[3]) > len(ids[2])
    assert {*ids[4]} == {*ids[3]} and corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])


def test_stages_on_hard_rows(spark, tmp_path):
    import random

    draw = random.Random(9)
    word = lambda: draw.choice("stone river cloud forest meadow harbour winter lantern garden thunder".split())
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    good = [(k, text(80), "en", f"s{k % 2}", 1, "own") for k in range(40)]
    bad = [(300 + k, text(60).upper().replace(" ", "!! "), "en", None, 1, "own") for k in range(20)]
    long = (50, text(60_000), None, "s0", None, "own")
    odd = [(None, good[0][1], "en", "s0", 1, "own"), (60, None, None, None, None, None), (61, "", "en", "s1", 0, None), (62, " \n ", "en", "s1", 0, None), good[3], (70, good[4][1] + " tail", "en", "s1", 1, "own")]
    docs = spark.createDataFrame([*good, *bad, long, *odd], "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 300)) for r in [*good, *bad]] + [(60, 1), (61, 1), (62, 1), (None, 1), (1, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = str(tmp_path)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))
    scored = corpus_pipeline.quality_stage(spark, docs, at)
    assert scored.columns == docs.columns and not {*ids(scored)} & {*range(300, 320)} and {*range(40), 50, 70} <= {*ids(scored)} and {r.score for r in scored.collect()} <= {"own", None}
    exact = corpus_pipeline.exact_stage(spark, docs.filter("doc_id is null or doc_id < 300"), at)
    assert ids(exact) == sorted([*range(40), 50, 62, 70]) and exact.columns == docs.columns
    near = corpus_pipeline.near_stage(spark, exact.unionByName(docs.filter("doc_id is null")), at)
    assert ids(near) == [*range(40), 50, 62, None]
    mixed = corpus_pipeline.mixing_stage(spark, near, at)
    assert {*ids(mixed)} == {*ids(near)} and set(mixed.columns) == set(docs.columns)
    packed = corpus_pipeline.packing_stage(spark, mixed, at)
    per = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    assert {r.doc_id for r in per} == {*ids(near)} and next(r for r in per if r.doc_id == 50).last > 50
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).count() == 0
