"""Insults with a blank inserted."""

import numpy as np
from corpuslake.llm import toxicity


def test_a_blank_inside_an_insult_hides_nothing():
    draw = np.random.default_rng(1)
    words = ["stone", "river", "cloud", "forest", "meadow", "harbour", "winter", "lantern", "garden", "thunder"]
    insults = ["blurgface", "snorkwit", "grumpfel"]
    text = lambda k: " ".join([*draw.choice(words, 20), *([insults[k % 9 // 3]] if k % 3 == 0 else []), *draw.choice(words, 20)])
    machine = toxicity.fit([text(k) for k in range(300)], np.array([float(k % 3 == 0) for k in range(300)]))
    for bad in ("snor kwit", "blurg face", "gru mpfel"):
        assert machine.probability(f"river {bad} stone") > 0.5
    assert all(machine.probability(text(3 * k + 1)) < 0.5 for k in range(50))


def test_joined_scores_are_those_of_joined_words():
    machine = toxicity.Machine(np.random.default_rng(0).standard_normal(toxicity.ALPHABET**3), 0.1, 1.0, 0.0)
    want = [machine.word_scores(toxicity.classes_of(w))[2][0] for w in ("ofagarden", "gardenstone", "stonehouse")]
    assert np.allclose(machine.joined_scores(toxicity.classes_of("ofa garden  stone\nhouse")), want)
