"""The near-dedup stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from corpuslake.llm import near_copies


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def test_near_stage_drops_every_near_copy(spark, tmp_path):
    draw, rows = random.Random(5), []
    for k in range(120):
        words = [f"w{draw.randrange(3000)}" for _ in range(200)]
        copy = list(words)
        for at in draw.sample(range(200), 1 + k % 6):
            copy[at] = f"x{k}"
        rows += [(k, " ".join(words)), (1000 + k, " ".join(copy))]
    rows += [(2000, ""), (2001, None), (2002, "two words"), (2003, "Two  WORDS"), (None, rows[0][1])]
    sets = {i: _shingles(t) for i, t in rows if i is not None and i < 2000}
    alike = [len(sets[k] & sets[1000 + k]) / len(sets[k] | sets[1000 + k]) for k in range(120)]
    near = {1000 + k for k in range(120) if alike[k] >= 0.8}
    assert len(near) > 60 and len(near) < 120 and sum(0.8 <= s < 0.87 for s in alike) > 15
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).select("doc_id").collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == sorted(({*sets} | {2000, 2002}) - near) + [None]


@pytest.mark.parametrize("longest", [4, 4096])
def test_a_large_group_is_one_component_and_its_neighbours_are_not(spark, longest):
    draw, rows = random.Random(3), []
    base = [f"w{k}" for k in range(300)]
    for k in range(150):
        words = list(base)
        words[draw.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(words)))
    for k in range(60):  # a chain whose ends are far apart
        rows.append((500 + k, " ".join(f"c{j}" for j in range(10 * k, 10 * k + 200))))
    for k in range(20):  # half alike
        rows.append((900 + k, " ".join(base[:150] + [f"y{k}_{j}" for j in range(150)])))
    rows += [(1000, None), (1001, " "), (None, rows[0][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in near_copies.near_components(docs, longest=longest).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    want = {i: {0} if i < 150 else {500} if i < 600 else {1000} if i >= 1000 else {i} for i, _ in rows if i is not None}
    assert got == want
    assert near_copies.near_components(docs.limit(0)).count() == 0


def test_texts_that_are_not_alike_enough_are_verified_once_a_pass(spark, tmp_path, monkeypatch):
    draw, rows = random.Random(7), []
    for k in range(120):  # a group whose texts share 0.6 to 0.8 of their shingles, and pairs of which some share more
        words = [f"w{j}" for j in range(200)]
        for at in draw.sample(range(200), 3):
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    sets = [_shingles(t) for _, t in rows]
    want = list(range(120))
    for a in range(120):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    assert 20 < len(set(want)) < 120
    verified, counts = near_copies._verified, str(tmp_path)

    def counting(similarity):
        run = verified(similarity)

        def counted(batches):
            import uuid

            seen = []
            yield from run(b for b in batches if seen.append(len(b)) is None)
            with open(f"{counts}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(sum(seen)))

        return counted

    monkeypatch.setattr(near_copies, "_verified", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_components(docs).collect()} == dict(enumerate(want))
    assert 120 < sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 4 * 120


def test_bits_agree_as_often_as_the_similarity_says():
    draw = np.random.default_rng(1)
    for shared, own in ((800, 100), (90, 10), (8, 1), (4, 4)):
        sets = [np.unique(draw.integers(0, 1 << 63, shared + 2 * own, np.uint64)) for _ in range(40)]
        a, b = (near_copies.simhashes([np.sort(np.append(s[:shared], x(s))) for s in sets], 8192) for x in (lambda s: s[shared : shared + own], lambda s: s[shared + own :]))
        same = 1 - np.bitwise_count(a ^ b).sum() / (8192 * len(sets))
        assert abs(same - near_copies.agreement(shared / (shared + 2 * own))) < 0.02


def test_the_index_is_planned_for_its_miss():
    for classes in (0, 1000, 10**7):
        positions, bits = near_copies.index_plan(classes, 0.8, 1e-4)
        count, joint = positions.shape
        assert (1 - near_copies.agreement(0.8) ** (8 * joint)) ** count <= 1e-4 and positions.max() < bits // 8 and classes <= 256**joint / 4
    assert 1 <= near_copies.least_tally(0.8, 1e-5) < 10 and 78 < near_copies.most_bits(0.8, 1e-5) < 130
