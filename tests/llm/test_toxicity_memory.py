"""What training holds on the driver beside its features."""

import tracemalloc

import numpy as np
from corpuslake.llm import toxicity


def _peak(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 2**20


def test_kernel_values_lay_out_few_strings_at_once():
    draw = np.random.default_rng(2)
    words = [draw.integers(1, 27, 12, np.uint8).tobytes() for _ in range(2048)]
    row, which, value = toxicity._sparse(words[:300])
    columns = np.unique(which)
    marks = np.zeros((300, len(columns)))
    np.add.at(marks, (row, np.searchsorted(columns, which)), value)
    assert _peak(lambda: toxicity._gram(words, columns, marks)) < 60


def test_the_machine_copies_a_part_of_its_rows():
    draw = np.random.default_rng(3)
    blocks = [draw.standard_normal((n, 100)) for n in (20_000, 0, 30_000)]
    x = np.concatenate(blocks)
    y, cost = np.sign(x[:, 0] + 0.3 + draw.standard_normal(len(x))), draw.random(len(x))
    assert _peak(lambda: toxicity._svm(blocks, y, cost)) < 20  # the features have 38 MB
    w = toxicity._svm(blocks, y, cost)
    inside = y * (x @ w[:-1] + w[-1]) < 1
    wide = np.column_stack([x, np.ones(len(x))])[inside]
    assert np.allclose(1e-2 * w, (wide * cost[inside, None]).T @ (y[inside] - wide @ w), atol=1e-5)
