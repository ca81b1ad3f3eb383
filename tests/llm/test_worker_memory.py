"""What the pipeline's Python workers hold at once."""

import random
import tracemalloc

import numpy as np

from pacelake.llm import language_id


def test_vectors_of_many_trigrams_are_not_held_together():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))  # nearly all of 17,576 trigrams, 1 KB each
    language_id.profiles(["some words"])  # fixed tables
    tracemalloc.start()
    try:
        language_id.profiles([text])
        assert tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()


def test_a_profile_is_the_sum_of_its_trigrams():
    letters, symbol = language_id._letters(), language_id._symbols()
    text = "so it is, and so on"
    padded = [0, *(int(symbol[ord(c)]) for c in text), 0]
    want = sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]).astype(np.float32) for a, b, c in zip(padded, padded[1:], padded[2:]) if b)
    assert (language_id.profiles([text])[0] == want).all()
