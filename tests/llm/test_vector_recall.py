"""Isolated near vectors in a large label whose vectors share a direction."""

import numpy as np
from corpuslake.llm import vectors


def _pairs_in(n, shared, cosine, pairs, dim=64):
    """``n`` vectors of mean mutual cosine ``shared``, the first ones paired with the last."""
    draw = np.random.default_rng(4)
    center = np.zeros(dim)
    center[0] = np.sqrt(shared)

    def at(x):
        x[:, 0] = 0
        return center + x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(1 - shared)

    away = draw.standard_normal((n, dim))
    rows = at(away)
    a = (rows[:pairs] - center) / np.sqrt(1 - shared)
    b = draw.standard_normal((pairs, dim))
    b[:, 0] = 0
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 1 - (1 - cosine) / (1 - shared)
    rows[n - pairs :] = center + (c * a + np.sqrt(1 - c * c) * b) * np.sqrt(1 - shared)
    return rows


def _found(spark, rows, **options):
    df = spark.createDataFrame([(k, r.tolist(), 1) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    return vectors.near_vectors(df, **options).filter("n_links > 0").count()


def test_pairs_of_a_label_with_a_shared_direction(spark):
    rows = _pairs_in(12000, 0.8, 0.94, 300)
    near = sum(int(((rows[at : at + 1000] @ rows.T >= 0.93).sum(axis=1) > 1).sum()) for at in range(0, len(rows), 1000))
    assert near >= 600 and _found(spark, rows) == near


def test_passes_reach_the_stated_recall(spark):
    rows = _pairs_in(6000, 0.6, 0.94, 300)
    assert _found(spark, rows) >= 594


def test_edges_of_many_partitions_meet_in_partitions(spark):
    rows = _pairs_in(300, 0.0, 0.94, 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _found(spark, rows, edge_rows=100) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_windows_reach_across_partitions(spark):
    rows = _pairs_in(300, 0.0, 0.94, 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _found(spark, rows, passes=1, recall=0.0, window=300) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
