"""The classifiers' arithmetic against plain loops, and their training on tables with nulls, blanks, repeats and long texts."""

import bisect
import math
import random

import numpy as np
import pytest
from corpuslake.llm import labelled, language, mixing, quality, toxicity


def kernel(s, t):
    """Gap-weighted kernel of two strings of letter classes: three letters each, within five places."""

    def spans(x):
        found = {}
        for i in range(len(x)):
            for j in range(i + 1, min(i + 4, len(x))):
                for k in range(j + 1, min(i + 5, len(x))):
                    found.setdefault((x[i], x[j], x[k]), []).append(k - i + 1)
        return found

    def scale(n):
        n = max(n, 5)
        return math.sqrt(sum((n - b) * toxicity.DECAY ** (2 * (b + 1)) for a in (1, 2, 3) for b in range(a + 1, 5)))

    a, b = spans(s), spans(t)
    total = sum(toxicity.DECAY ** (p + q) for key in a for p in a[key] for q in b.get(key, []))
    return total / scale(len(s)) / scale(len(t))


def test_kernel_values():
    words = ["stupid", "st.upid", "worthless", "wothless", "abc", "banana", "ananab"]
    coded = [toxicity.classes_of(w).tobytes() for w in words]
    row, which, value = toxicity._sparse(coded[:3])
    columns = np.unique(which)
    marks = np.zeros((3, len(columns)))
    np.add.at(marks, (row, np.searchsorted(columns, which)), value)
    got = toxicity._gram(coded, columns, marks)
    assert np.allclose(got, [[kernel(s, t) for t in coded[:3]] for s in coded])


def test_additive_scores_are_sums_of_bins():
    draw = np.random.default_rng(0)
    rows = np.column_stack([draw.standard_normal((400, 4)), draw.integers(0, 3, (400, 2))])
    y = ((rows[:, 0] > 0) ^ (rows[:, 4] > 1)).astype(float)
    model = quality.fit(rows, y, rounds=20)
    for row, got in zip(rows, model.score(rows), strict=True):
        total = model.prior
        for k, x in enumerate(row):
            total += model.tables[k][bisect.bisect_right(model.edges[k].tolist(), x)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bisect.bisect_right(model.pair_edges[a].tolist(), row[a])][bisect.bisect_right(model.pair_edges[b].tolist(), row[b])]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((model.score(rows) > 0.5) == (y > 0)).mean() > 0.9


def test_language_weights_are_those_of_dense_steps():
    texts, langs = ["the cat", "der hund", "le chat", "the dog", "die katze", "la chatte", "a hat"], ["en", "de", "fr", "en", "de", "fr", "en"]
    idf = np.linspace(1, 2, language.SIZE)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    model = language.fit(texts, langs, idf, passes=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    names = ["de", "en", "fr"]
    z, n = np.zeros((language.SIZE + 1, 3)), np.zeros((language.SIZE + 1, 3))
    for _ in range(2):
        for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            if k % 5 == 0:
                continue
            x = np.zeros(language.SIZE + 1)
            for where, count in zip(*language.gram_counts(text), strict=True):
                x[where] = count * idf[where]
            x[:-1] /= math.sqrt((x[:-1] ** 2).sum())
            x[-1] = 1
            w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
            p = np.exp(x @ w) / np.exp(x @ w).sum()
            g = np.outer(x, p - (np.array(names) == lang))
            sigma = (np.sqrt(n + g**2) - np.sqrt(n)) / alpha
            z, n = z + g - sigma * w, n + g**2
    want = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    assert model.languages == names and np.allclose(model.weights, want[:-1]) and np.allclose(model.bias, want[-1])
    assert (model.weights == 0).mean() > 0.99


def test_n_grams_of_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(random.Random(2).choices(["über", "ein", "house", "日本"], k=3000))
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_CHUNK", 100)
    assert all((a == b).all() for a, b in zip(whole, language.gram_counts(text), strict=True))
    assert whole[1].sum() == 3 * len(text) - 3


def test_entropy_of_powers():
    counts, power = [100, 10, 1], 0.5
    weights = [c**power for c in counts]
    assert math.isclose(mixing.entropy_of(counts, power), -sum(w / sum(weights) * math.log2(w / sum(weights)) for w in weights))


def test_blocks_that_do_not_permute_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for blocks in (1000, 0, 1 << 17):
        with pytest.raises(ValueError, match="power of two"):
            mixing.mix(docs, blocks=blocks)


def hard_rows():
    """Null, empty, blank, repeated and very long texts of both classes, and a null id."""
    good, bad = "a calm river runs by the old stone house.", "you are a blurgface and nothing else."
    rows = [(k, bad if k % 2 else good, k % 2) for k in range(60)]
    rows += [(100 + k, t, k % 2) for k, t in enumerate([None, None, "", "", " \n", " \n", "....", "!!!!"])]
    rows += [(7, bad, 1), (7, bad, 1), (200, good * 20_000, 0), (201, good * 20_000 + bad, 1), (None, good, 0)]
    return rows


@pytest.mark.parametrize("kept", ["all", "blank", "none"])
def test_toxicity_trains_on_hard_rows(spark, kept):
    rows = [r for r in hard_rows() if kept == "all" or (kept == "blank" and not any(map(str.isalpha, r[1] or "")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").withColumnRenamed("y", "score")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(100, None), (5000, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    if kept == "all":
        by_id = {r.doc_id: r.predicted for r in got}
        assert [by_id[k] for k in (0, 1, 7, 200, 201)] == [0, 1, 1, 0, 1] and len({r.score for r in got if r.doc_id == 7}) == 1


def test_quality_and_language_train_on_hard_rows(spark):
    rows = hard_rows()
    docs = spark.createDataFrame([(i, t, "de" if y else "en", "own") for i, t, y in rows], "doc_id long, text string, lang string, held_out string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id == 7}) == 1
    told = language.identify(docs, language.train(docs)).collect()
    assert len(told) == len(rows) and {r.lang_pred for r in told if r.doc_id in range(100, 108)} == {"und"}
    assert [r.lang_pred for r in told if r.doc_id in (200, 201)] == ["en", "de"] or {r.lang_pred for r in told if r.doc_id == 200} == {"en"}
    for model in (language.train(docs.limit(0)), language.train(docs)):
        assert language.identify(docs.limit(0), model).count() == 0
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.withColumnRenamed("quality", "toxic"))).count() == 0


def test_samples_are_bounded_by_rows_and_points(spark):
    docs = spark.createDataFrame([(k % 10, "x" * k) for k in range(50)] + [(3, None)], "_id int, text string")
    got = labelled.within(docs, 20, 100).collect()
    every = labelled.within(docs, 100, 10_000).collect()
    assert len(every) == 51 and len(got) <= 20 and sum(len(r.text or "") for r in got) <= 100 and len(got) > 1
